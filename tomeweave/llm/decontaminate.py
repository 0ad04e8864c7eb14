"""Benchmark decontamination with an FM-index per training shard.

The phrases are the windows of ``window`` words of the benchmark's items.  A shard is a run of
whole documents of one task.  Its words are written as codes of the benchmark's vocabulary; other
words end a run, and runs shorter than the shortest phrase cannot hold one and are left out.
Over the runs a suffix array gives the Burrows-Wheeler transform; a wavelet matrix over it answers
the ranks of backward search and of the walk to the next sampled suffix position.

The benchmark is the query set: it is read in blocks of bounded size, and each block is sent to
all tasks and searched in all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeweave.llm._words import MARKS, Words, pieces

SHARD = 1 << 19
BLOCK_BYTES = 16 << 20
SAMPLE = 8
ROWS = 500


class Phrases:
    """Phrases of one block of items, by length, as codes over the block's vocabulary."""

    def __init__(self, items: list, texts: list, window: int) -> None:
        hashes, bounds = [np.zeros(0, np.uint64)], [0]
        for _, _, data, offsets in pieces(pa.array(texts, pa.string())):
            words = Words(data, offsets, MARKS, True)
            hashes.append(words.hash)
            bounds.extend((words.bounds[1:] + bounds[-1] - words.bounds[0]).tolist())
        words = np.concatenate(hashes)
        self.vocabulary = np.unique(words)
        codes = np.searchsorted(self.vocabulary, words).astype(np.int32) + 1
        self.items = items
        found: dict[bytes, list[int]] = {}
        for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
            for j in range(a, max(a + 1, b - window + 1) if b > a else a):
                found.setdefault(codes[j:min(j + window, b)].tobytes(), []).append(i)
        self.by_length: dict[int, np.ndarray] = {}
        self.owners: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for length in sorted({len(p) // 4 for p in found}):
            mine = {p: sorted(set(o)) for p, o in found.items() if len(p) == 4 * length}
            self.by_length[length] = np.frombuffer(b"".join(mine), np.int32).reshape(-1, length)
            self.owners[length] = (np.concatenate([[0], np.cumsum([len(o) for o in mine.values()])]), np.concatenate(list(mine.values())))
        self.shortest = min(self.by_length, default=0)

    def encode(self, hashes: np.ndarray) -> np.ndarray:
        """Codes of words; 0 for a word of no item."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int32)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0).astype(np.int32)


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; every 0 ends a run and differs from every other 0."""
    n = len(symbols)
    ends = np.flatnonzero(symbols == 0)
    rank = symbols.astype(np.int64) + len(ends)
    rank[ends] = np.arange(len(ends))
    step = 1
    while True:
        later = np.zeros(n, np.int64)
        later[:-step] = rank[step:] + 1
        key = rank * np.int64(n + len(ends) + int(symbols.max(initial=0)) + 2) + later
        order = np.argsort(key)
        ordered = key[order]
        new = np.zeros(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        if n == 0 or new[order[-1]] == n - 1:
            return order
        rank, step = new, 2 * step
        if step >= n:
            return order


class FMIndex:
    """Backward search and location over one sequence of symbols, 0 after each run."""

    def __init__(self, symbols: np.ndarray) -> None:
        order = suffix_array(symbols)
        self.transform = symbols[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=int(symbols.max()) + 1))])
        self.depth = max(1, int(symbols.max()).bit_length())
        self.ones, self.zeros, level = [], [], self.transform
        for bit in reversed(range(self.depth)):
            set_ = (level >> bit) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(set_, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(len(level) - int(self.ones[-1][-1]))
            level = np.concatenate([level[set_ == 0], level[set_ == 1]])
        # positions at run starts and at every SAMPLE-th place are kept
        start = np.ones(len(symbols), bool)
        start[1:] = symbols[:-1] == 0
        kept = start | (np.arange(len(symbols)) % SAMPLE == 0)
        self.sampled = kept[order]
        self.sample_rank = np.cumsum(self.sampled) - 1
        self.samples = order[self.sampled]

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before a row, by the wavelet matrix."""
        low, high = np.zeros_like(at), at
        for level, bit in enumerate(reversed(range(self.depth))):
            one = ((symbol >> bit) & 1).astype(bool)
            ones, zeros = self.ones[level], self.zeros[level]
            low = np.where(one, zeros + ones[low], low - ones[low])
            high = np.where(one, zeros + ones[high], high - ones[high])
        return high - low

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, first row, end row) of the phrases that occur."""
        which = np.flatnonzero((phrases < len(self.first) - 1).all(axis=1))
        last = phrases[which, -1]
        low, high = self.first[last], self.first[last + 1]
        for column in range(phrases.shape[1] - 2, -1, -1):
            alive = low < high
            which, low, high = which[alive], low[alive], high[alive]
            symbol = phrases[which, column]
            low, high = self.first[symbol] + self.rank(symbol, low), self.first[symbol] + self.rank(symbol, high)
        alive = low < high
        return which[alive], low[alive], high[alive]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: walk back to the next sampled position."""
        out, walked = np.zeros(len(rows), np.int64), 0
        open_ = np.arange(len(rows))
        while len(open_):
            done = self.sampled[rows]
            out[open_[done]] = self.samples[self.sample_rank[rows[done]]] + walked
            open_, rows = open_[~done], rows[~done]
            symbol = self.transform[rows]
            rows = self.first[symbol] + self.rank(symbol, rows)
            walked += 1
        return out


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one after another."""
    size = end - start
    return np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else size, size) + np.arange(int(size.sum()))


def without_spans(text: str | None, starts: np.ndarray, ends: np.ndarray) -> str | None:
    """A text without the bytes from the first to the last word of each span of words."""
    if not len(starts):
        return text
    data = np.frombuffer(text.encode(), np.uint8)
    words = Words(data, np.array([0, len(data)]), MARKS, True)
    parts, at = [], 0
    for start, end in zip(starts, ends):
        parts.append(data[at:words.start[start]].tobytes())
        at = words.end[end - 1]
    return b"".join([*parts, data[at:].tobytes()]).decode()


class _Shard:
    """Documents gathered for one index, and their hits."""

    def __init__(self, phrases: Phrases, names: list[str], cut: bool) -> None:
        self.phrases, self.names, self.cut = phrases, names, cut
        self.columns: list[tuple] = []
        self.sizes: list[np.ndarray] = []
        self.symbols: list[np.ndarray] = []
        self.places: list[np.ndarray] = []
        self.documents = self.weight = self.bytes = 0

    def add(self, words: Words, columns: tuple) -> None:
        codes = self.phrases.encode(words.hash)
        text = words.text
        known = codes > 0
        new = np.ones(len(codes), bool)
        new[1:] = (text[1:] != text[:-1]) | (known[1:] != known[:-1])
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(codes)))
        take = known[head] & (size >= max(1, self.phrases.shortest))
        head, size = head[take], size[take]
        at = _ranges(head, head + size)
        gap = np.cumsum(size)
        self.symbols.append(np.insert(codes[at], gap, 0))
        self.places.append(np.insert(np.stack([text[at] + self.documents, at - words.bounds[text[at]]]), gap, -1, axis=1))
        self.sizes.append(np.diff(words.bounds))
        self.columns.append(columns)
        self.documents += len(words.bounds) - 1
        self.weight += len(self.symbols[-1])

    def hits(self) -> tuple[np.ndarray, ...]:
        """(document, start, end) of occurrences and (document, item) pairs."""
        symbols, places = np.concatenate(self.symbols), np.concatenate(self.places, axis=1)
        spans, items = [np.zeros((3, 0), np.int64)], [np.zeros((2, 0), np.int64)]
        if len(symbols):
            index = FMIndex(symbols)
            for length, phrases in self.phrases.by_length.items():
                which, low, high = index.search(phrases)
                document, start = places[:, index.locate(_ranges(low, high))]
                which = np.repeat(which, high - low)
                spans.append(np.stack([document, start, start + length]))
                pair = np.unique(np.stack([document, which]), axis=1)
                bounds, owners = self.phrases.owners[length]
                a, b = bounds[pair[1]], bounds[pair[1] + 1]
                items.append(np.stack([np.repeat(pair[0], b - a), owners[_ranges(a, b)]]))
        return np.concatenate(spans, axis=1), np.unique(np.concatenate(items, axis=1), axis=1)

    def result(self) -> pa.RecordBatch:
        (document, start, end), pairs = self.hits()
        order = np.lexsort((start, document))
        document, start, end = document[order], start[order], end[order]
        # ranges of one document that touch or overlap become one
        stretch = np.maximum.accumulate(end + document * (1 << 40)) - document * (1 << 40) if len(end) else end
        new = np.ones(len(end), bool)
        new[1:] = (document[1:] != document[:-1]) | (start[1:] > stretch[:-1])
        head = np.flatnonzero(new)
        last = np.append(head[1:], len(end))[:len(head)] - 1
        n = self.documents
        cut = lambda who: pa.array(np.searchsorted(who, np.arange(n + 1)).astype(np.int32))
        span = pa.StructArray.from_arrays([pa.array(start[head]), pa.array(stretch[last])], ["start", "end"])
        hit = np.bincount(document[head], stretch[last] - start[head], minlength=n).astype(np.int64)
        names = [self.phrases.items[i] for i in pairs[1]]
        known = np.array([x is not None for x in names], bool)
        item = pa.array([x for x in names if x is not None], pa.string())
        columns = [pa.concat_arrays([c[i] for c in self.columns]) for i in range(len(self.names))]
        if self.cut:
            at = self.names.index("text")
            bounds = np.searchsorted(document[head], np.arange(n + 1))
            columns[at] = pa.array([without_spans(value.as_py(), start[head[a:b]], stretch[last[a:b]]) for value, a, b in zip(columns[at], bounds, bounds[1:])], pa.string())
        return pa.record_batch([
            *columns, pa.array(np.concatenate(self.sizes)),
            pa.array(hit), pa.ListArray.from_arrays(cut(document[head]), span), pa.ListArray.from_arrays(cut(pairs[0][known]), item)],
            [*self.names, "n_words", "n_hit", "spans", "items"])


def _search(shared, names: list[str], all_rows: bool, cut: bool):
    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases, shard = shared.value, None

        def ready():
            out = shard.result()
            return out if all_rows else out.filter(pa.compute.greater(out.column("n_hit"), 0))

        for batch in batches:
            for low, high, data, offsets in pieces(batch.column("text")):
                shard = shard or _Shard(phrases, names, cut)
                shard.add(Words(data, offsets, MARKS, True), tuple(batch.column(c).slice(low, high - low) for c in names))
                shard.bytes += len(data)
                if shard.weight >= SHARD or shard.bytes >= 8 << 20:
                    yield ready()
                    shard = None
        if shard:
            yield ready()
    return body


def _blocks(benchmark: DataFrame, item_col: str, text: str, limit: int) -> Iterator[tuple[list, list]]:
    items, texts, size = [], [], 0
    for item, words in benchmark.select(F.col(item_col).cast("string"), text).toLocalIterator(prefetchPartitions=True):
        items.append(item)
        texts.append(words)
        size += len(words or "")
        if size >= limit:
            yield items, texts
            items, texts, size = [], [], 0
    yield items, texts


FOUND = "{kind}, n_words bigint, n_hit bigint, spans array<struct<start: bigint, end: bigint>>, items array<string>"
MERGED = """aggregate(array_sort(flatten(all_spans)), CAST(array() AS array<struct<start: bigint, end: bigint>>), (done, s) ->
    CASE WHEN size(done) > 0 AND element_at(done, -1).end >= s.start
         THEN concat(slice(done, 1, size(done) - 1), array(named_struct('start', element_at(done, -1).start, 'end', greatest(element_at(done, -1).end, s.end))))
         ELSE concat(done, array(s)) END)"""


def _found(rows: DataFrame, benchmark: DataFrame, window: int, item_col: str, item_text: str, block_bytes: int, names: list[str], cut: bool = False) -> DataFrame:
    """The columns ``names`` of ``rows(row, id, ..., text)`` with ``n_words``, ``n_hit``, ``spans`` and ``items``.

    With ``cut`` the column ``text`` has its hits cut out: by the search itself if the benchmark is
    one block, else after the blocks' spans are merged.
    """
    spark, found, more = rows.sparkSession, None, None
    blocks = _blocks(benchmark, item_col, item_text, block_bytes)
    ahead = [next(blocks), *islice(blocks, 1)]
    alone = len(ahead) == 1
    for items, texts in chain(ahead, blocks):
        shared = spark.sparkContext.broadcast(Phrases(items, texts, window))
        part, wanted = (rows, names) if found is None else (rows.select("row", "text"), ["row"])
        kind = ", ".join(f"{c} {part.schema[c].dataType.simpleString()}" for c in wanted)
        part = part.mapInArrow(_search(shared, wanted, found is None, cut and alone), FOUND.format(kind=kind))
        if found is None:
            found = part
        else:
            more = part if more is None else more.unionByName(part)
    if more is not None:
        # a row that stands twice has its hits twice; merging them changes nothing
        gathered = more.groupBy("row").agg(F.collect_list("spans").alias("more_spans"), F.flatten(F.collect_list("items")).alias("more_items"))
        none = F.array().cast("array<string>")
        found = (found.join(gathered, "row", "left")
                 .withColumn("all_spans", F.concat(F.array("spans"), F.coalesce("more_spans", F.array(F.col("spans")))))
                 .withColumn("spans", F.expr(MERGED))
                 .withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"]))
                 .withColumn("items", F.concat("items", F.coalesce("more_items", none))))
    found = found.withColumn("items", F.array_sort(F.array_distinct("items")))
    if not cut or alone:
        return found
    rest = [c for c in found.columns if c != "text"]
    kinds = ", ".join(f"{c} {found.schema[c].dataType.simpleString()}" for c in rest)
    return found.select(*rest, "text").mapInArrow(_without, f"{kinds}, text string")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", id_col: str = "doc_id",
                  item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Where the words of benchmark items stand in documents.

    Words are runs of ASCII letters (capitals as small ones), digits and all that is not ASCII.  A
    phrase is ``window`` consecutive words of an item, or the whole of a shorter item.  Returns
    ``id_col``, ``n_words``, ``n_hit``, ``spans`` (merged ranges of hit words) and ``items`` (ids
    of the items with a phrase there, as strings, in order).

    * Null and empty texts have no words, on either side; an item without words is never found.
    * Items with one id count once; a null item id hits words but is not listed.
    * Repeated rows come back as often as they stand; ids may be null or repeated.
    * Other columns are left out, so their names cannot clash.
    * An empty table gives an empty table; an empty benchmark finds nothing.
    """
    rows = docs.select(F.xxhash64(F.col(id_col), F.col(text)).alias("row"), F.col(id_col).alias("id"), F.col(text).alias("text"))
    found = _found(rows, benchmark, window, item_col, item_text, block_bytes, ["row", "id"])
    return found.select(F.col("id").alias(id_col), "n_words", "n_hit", "spans", "items")


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
        spans = [(np.array([s["start"] for s in x]), np.array([s["end"] for s in x])) for x in batch.column("spans").to_pylist()]
        texts = [without_spans(value.as_py(), *span) for value, span in zip(batch.column("text"), spans)]
        rest = [i for i, name in enumerate(batch.schema.names) if name != "text"]
        yield pa.record_batch([*[batch.column(i) for i in rest], pa.array(texts, pa.string())], [*[batch.schema.names[i] for i in rest], "text"])


def remove_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", id_col: str = "doc_id", item_col: str = "item_id",
                         item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``rest`` (a struct of the other columns), ``n_words``, ``n_hit`` and the text with its hits cut out.

    From the first to the last word of each hit span all bytes go.  Same rules as
    ``contamination``; a null text stays null, and a text without hits stays as it is.
    """
    rest = [c for c in docs.columns if c != text]
    rows = docs.select(F.xxhash64(F.col(id_col), F.col(text)).alias("row"), F.struct(*rest).alias("rest"), F.col(text).alias("text"))
    found = _found(rows, benchmark, window, item_col, item_text, block_bytes, ["row", "rest", "text"], cut=True)
    return found.select("rest", "n_words", "n_hit", "text")
