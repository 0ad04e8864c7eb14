"""The best collocations of each language, by best-first branch and bound over phrases.

A phrase's score is its worst cut: ``floor(2000000 * a / (l + r))`` for the counts of the phrase and
of its two parts.  Phrases grow to the right, word by word.  All extensions of a prefix ``u`` have
``a <= f(u)`` and a cut behind the first word, whose score grows with ``a``; so none scores above
``bound(u) = floor(2000000 * f(u) / (f(first word) + f(u)))``, and no longer prefix has a greater
bound than a shorter one.

*Frontier.*  Pairs of frequent words are counted once.  Each language has a *floor*: a score that
some thousand pairs reach.  A round expands every prefix whose bound reaches the floor, and looks
for the extensions, left and right, of every phrase that reaches it (a longer candidate of nearly
its count removes a phrase, and if any does, one that is a word longer does).  So all phrases with
a score at or above the floor are known, ties included, and whether they survive.  A language is
settled when enough survive, or its floor is 0; the others go on with a lower floor.

*Counting.*  Texts become arrays of word names (64 bits, of language and word), rare words and
piece borders being 0, and are written once.  A round's counts are map-side sums per Arrow batch,
then per task, then a shuffle by the phrase's names.  Which phrases to count is told by a Bloom
filter, of at most ``FILTER_BITS`` bits however many there are: a false hit costs a count that the
join behind it drops, never a wrong one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tomeweave.llm._store import Scratch
from tomeweave.llm._words import Words, mixed, pieces

FILTER_BITS, BLOCKS = 1 << 28, 256
#: Tokens whose phrases are counted at once; a worker holds some 20 arrays of them.
STRETCH = 1 << 19
#: Scores are in parts of this; a round's floor is reached by some ``MARGIN`` x ``top`` pairs, and ``WIDER`` x as many in the next.
WHOLE, MARGIN, WIDER = 2_000_000, 2, 4
_ALIVE, _GROWN, _HELD, _WANTED = (np.uint64(x) for x in (0x9E37, 0x85EB, 0xC2B2, 0x27D4))
_FOLD = np.uint64(0xD6E8FEB86659FD93)

#: Bytes that end a word, and those among them that also end a piece.
_BREAKS = np.zeros(256, bool)
_BREAKS[list(b".,;:!?\n\x0b\x0c\r")] = True
_SPACES = _BREAKS.copy()
_SPACES[[9, 32]] = True


def _folded(columns: list[np.ndarray], tag: np.uint64) -> np.ndarray:
    """One number for each phrase, given its words' names; other tags give other numbers."""
    out = np.full(len(columns[0]), tag)
    for names in columns:
        out = mixed(out * _FOLD + names)
    return out


# ------------------------------------------------------------------ Bloom filter
def _bits(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    """Three places of each key, all in one block."""
    block = bits // BLOCKS
    base = (keys >> np.uint64(56)) * np.uint64(block)
    spread = mixed(keys.copy())
    return [base + ((spread >> np.uint64(shift)) & np.uint64(block - 1)) for shift in (0, 21, 42)]


class Filter:
    """Keys of tagged phrases; ``has`` may err towards yes only."""

    def __init__(self, blocks: dict[int, bytes], bits: int) -> None:
        self.bits = bits
        self.cells = np.zeros(bits // 8, np.uint8)
        size = bits // BLOCKS // 8
        for block, raw in blocks.items():
            self.cells[block * size:(block + 1) * size] = np.frombuffer(raw, np.uint8)

    def has(self, columns: list[np.ndarray], tag: np.uint64) -> np.ndarray:
        out = np.ones(len(columns[0]), bool)
        for place in _bits(_folded(columns, tag), self.bits):
            out &= (self.cells[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return out


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Folded keys of rows ``(tag, w1, w2, w3)``, where a null word ends the phrase."""
    for batch in batches:
        tags = batch.column("tag").to_numpy().astype(np.uint64)
        sizes = 3 - sum(batch.column(c).is_null().to_numpy(zero_copy_only=False).astype(int) for c in ("w1", "w2", "w3"))
        names = [batch.column(c).fill_null(0).to_numpy().view(np.uint64) for c in ("w1", "w2", "w3")]
        keys = np.zeros(len(tags), np.uint64)
        for tag in np.unique(tags):
            for size in range(1, 4):
                mine = (tags == tag) & (sizes == size)
                keys[mine] = _folded([n[mine] for n in names[:size]], tag)
        yield pa.record_batch([pa.array((keys >> np.uint64(56)).astype(np.int32)), pa.array(keys.view(np.int64))], ["block", "key"])


def _blocks(bits: int):
    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = bits // BLOCKS
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            keys = batch.column("key").to_numpy().view(np.uint64)
            for block in np.unique(keys >> np.uint64(56)).tolist():
                mine = keys[keys >> np.uint64(56) == block]
                if block not in made:
                    made[block] = np.zeros(size // 8, np.uint8)
                for place in _bits(mine, bits):
                    place = place - np.uint64(block * size)
                    np.bitwise_or.at(made[block], place >> np.uint64(3), np.uint8(1) << (place & np.uint64(7)).astype(np.uint8))
        yield pa.record_batch([pa.array(list(made), pa.int32()), pa.array([c.tobytes() for c in made.values()], pa.binary())],
                              ["block", "cells"])
    return body


def _filter(rows: DataFrame, bits: int):
    """A broadcast filter over rows ``(tag, w1, w2, w3)``: eight bits and more a row up to ``bits`` in all."""
    n = rows.count()
    bits = min(bits, max(1 << 20, 1 << (8 * n).bit_length()))
    built = (rows.mapInArrow(_keys, "block int, key bigint").repartition("block")
             .mapInArrow(_blocks(bits), "block int, cells binary").collect())
    return rows.sparkSession.sparkContext.broadcast(Filter({r["block"]: bytes(r["cells"]) for r in built}, bits))


def _tagged(rows: DataFrame, tag: np.uint64, *words: str) -> DataFrame:
    names = [F.col(w) if w else F.lit(None).cast("bigint") for w in (*words, "", "", "")[:3]]
    return rows.select(F.lit(int(tag)).cast("bigint").alias("tag"), *[n.alias(f"w{i}") for i, n in enumerate(names, 1)])


# ------------------------------------------------------------------ texts to names
class _Named:
    """Words of a run of texts: names that hold language and word, and where a piece ends before a word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray) -> None:
        self.words = Words(data, offsets, _SPACES, True)
        broken = np.concatenate([[0], np.cumsum(_BREAKS[data])])
        start = self.words.start
        self.fresh = np.ones(len(start), bool)
        self.fresh[1:] = broken[start[1:]] > broken[self.words.end[:-1]]
        first = self.words.bounds[:-1]
        self.fresh[first[first < len(start)]] = True
        self.text = self.words.text
        self.names = mixed(self.words.hash + langs[self.text]) | np.uint64(1)


def _languages(batch: pa.RecordBatch) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The languages of a batch, each row's number among them, and a number for each language that is the same everywhere."""
    coded = batch.column("lang").fill_null("und").dictionary_encode()
    names = coded.dictionary.to_pylist()
    raw = [np.frombuffer(x.encode(), np.uint8) for x in names]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    whole = Words(np.concatenate(raw) if raw else np.zeros(0, np.uint8), offsets, np.zeros(256, bool), False)
    codes = np.zeros(len(names), np.uint64)
    codes[whole.text] = mixed(whole.hash * _FOLD)
    return names, coded.indices.to_numpy(), codes


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Different words of each run of texts with their counts."""
    for batch in batches:
        langs, which, codes = _languages(batch)
        for low, high, data, offsets in pieces(batch.column("text")):
            named = _Named(data, offsets, codes[which[low:high]])
            names, first, n = np.unique(named.names, return_index=True, return_counts=True)
            raw = data.tobytes().lower()
            start, end = named.words.start[first].tolist(), named.words.end[first].tolist()
            lang = which[low:high][named.text[first]]
            yield pa.record_batch([pa.array(names.view(np.int64)), pa.DictionaryArray.from_arrays(pa.array(lang), pa.array(langs, pa.string())).cast(pa.string()),
                                   pa.array([raw[a:b].decode() for a, b in zip(start, end)], pa.string()), pa.array(n)], ["w", "lang", "word", "n"])


def _tokens(shared):
    """Texts as names; 0 parts pieces and stands for stretches of rare words."""
    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, which, codes = _languages(batch)
            for low, high, data, offsets in pieces(batch.column("text")):
                named = _Named(data, offsets, codes[which[low:high]])
                names = np.where(shared.value.has([named.names], _ALIVE), named.names, np.uint64(0))
                names = np.insert(names, np.flatnonzero(named.fresh), 0)
                kept = np.ones(len(names), bool)
                kept[1:] = (names[1:] != 0) | (names[:-1] != 0)
                yield pa.record_batch([pa.array([names[kept].tobytes()], pa.binary())], ["tokens"])
    return body


# ------------------------------------------------------------------ counts of phrases
def _stretches(column: pa.Array) -> Iterator[np.ndarray]:
    """Token rows in stretches of about ``STRETCH`` tokens: an Arrow batch may hold a whole task's."""
    held, n = [], 0
    for row in column:
        held.append(np.frombuffer(row.as_buffer(), np.uint64))
        n += len(held[-1])
        if n >= STRETCH:
            yield np.concatenate(held)
            held, n = [], 0
    if held:
        yield np.concatenate(held)


def _grams(size: int, chosen: Callable[[Filter, list[np.ndarray]], np.ndarray] | None, shared):
    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens in (part for batch in batches for part in _stretches(batch.column("tokens"))):
            n = max(0, len(tokens) - size + 1)
            at = np.flatnonzero(np.logical_and.reduce([tokens[i:n + i] != 0 for i in range(size)]))
            columns = [tokens[at + i] for i in range(size)]
            if chosen:
                take = chosen(shared.value, columns)
                columns = [c[take] for c in columns]
            order = np.argsort(_folded(columns, _WANTED), kind="stable")
            columns = [c[order] for c in columns]
            fresh = np.ones(len(order), bool)
            fresh[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
            first = np.flatnonzero(fresh)
            yield pa.record_batch([*[pa.array(c[first].view(np.int64)) for c in columns], pa.array(np.diff(np.append(first, len(order))))],
                                  [*[f"w{i}" for i in range(1, size + 1)], "n"])
    return body


def _counted(tokens: DataFrame, size: int, chosen=None, shared=None) -> DataFrame:
    names = [f"w{i}" for i in range(1, size + 1)]
    rows = tokens.mapInArrow(_grams(size, chosen, shared), ", ".join(f"{w} bigint" for w in names) + ", n bigint")
    return rows.groupBy(*names).agg(F.sum("n").alias("a"))


def _triples(f: Filter, w: list[np.ndarray]) -> np.ndarray:
    both = f.has(w[:2], _ALIVE) & f.has(w[1:], _ALIVE)
    return both & (f.has(w[:2], _GROWN) | f.has(w[1:], _HELD))


def _quads(f: Filter, w: list[np.ndarray]) -> np.ndarray:
    return f.has(w[:2], _ALIVE) & f.has(w[2:], _ALIVE) & (f.has(w[:3], _GROWN) | f.has(w[1:], _HELD))


def _wanted(f: Filter, w: list[np.ndarray]) -> np.ndarray:
    return f.has(w, _WANTED)


def _score(a: Column, l: Column, r: Column) -> Column:
    """Exact, as the product may pass 64 bits."""
    wide = lambda x: x.cast("decimal(20,0)")
    return F.call_function("div", wide(a) * F.lit(WHOLE), wide(l) + wide(r)).cast("bigint")


def _worst(*cuts: tuple[Column, Column]) -> Column:
    """The lowest-scoring cut, ties to the first: (score, number, l, r)."""
    return F.array_min(F.array(*[F.struct(_score(F.col("a"), l, r).alias("score"), F.lit(i).alias("cut"), l.alias("l"), r.alias("r"))
                                 for i, (l, r) in enumerate(cuts, 1)]))


def _floors(pairs: DataFrame, langs: DataFrame, reach: int) -> DataFrame:
    """For each language a score that about ``reach`` pairs reach; 0 where there are fewer.

    Any floor gives right results.  It comes from counts per band of scores, so no language's
    pairs meet in one task.
    """
    bands = pairs.groupBy("lang", F.floor(F.log2(F.col("score") + 1) * 16).alias("band")).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
    above = F.sum("n").over(W.partitionBy("lang").orderBy(F.desc("band")))
    reached = bands.withColumn("above", above).where(F.col("above") >= reach).groupBy("lang").agg(F.max("least").alias("floor"))
    return langs.join(reached, "lang", "left").select("lang", F.coalesce("floor", F.lit(0).cast("bigint")).alias("floor"))


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, covered: int = 80, text: str = "text", lang: str = "lang",
                 filter_bits: int = FILTER_BITS, margin: int = MARGIN, scratch: Scratch | None = None) -> DataFrame:
    """The ``top`` collocations of each language: ``lang, rank, phrase, a, l, r, n, score``.

    A-Z are lower-cased; pieces end at ``. , ; : ! ?`` and line ends, words at spaces and tabs.  A
    candidate is a phrase of two to four words with ``a >= least``.  Its lowest-scoring cut counts,
    ties to the earliest.  It is dropped if a longer candidate that holds it has ``covered`` per cent of
    its count or more.  Order: score, count, then the phrase's bytes.  ``n`` are the language's words.

    * Null and empty texts have no words; a null language is ``und`` and meets texts marked so.
    * Texts are read whole at any length.  Each row counts, also one that stands twice.
    * A language without candidates gives no row.  An empty table gives an empty table.
    * Other columns of ``docs`` are left out, so their names cannot clash.
    * Words are told apart by 64-bit names, phrases by the names of all their words.

    The working tables are deleted at the end, unless they lie in the caller's ``scratch``; the
    result is a table of at most ``top`` rows a language.
    """
    if filter_bits < 1 << 20 or filter_bits & (filter_bits - 1):
        raise ValueError("filter_bits must be a power of two, 2^20 or more")
    spark = docs.sparkSession
    if not scratch:
        work = Scratch(spark, "collocations-work")
        out = collocations(docs, least, top, covered, text, lang, filter_bits, margin, work)
        out = Scratch(spark, "collocations").table(out, "best")
        work.drop()
        return out
    texts = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    words = scratch.table(texts.mapInArrow(_count_words, "w bigint, lang string, word string, n bigint")
                          .groupBy("w", "lang", "word").agg(F.sum("n").alias("n")), "words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    frequent = words.where(F.col("n") >= least)
    tokens = scratch.table(texts.mapInArrow(_tokens(_filter(_tagged(frequent, _ALIVE, "w"), filter_bits)), "tokens binary"), "tokens")
    alive = scratch.table(_counted(tokens, 2).where(F.col("a") >= least), "alive")
    first, second = (frequent.select(F.col("w").alias(f"w{i}"), F.col("n").alias(f"f{i}"), *(["lang"] if i == 1 else [])) for i in (1, 2))
    pairs = alive.join(first, "w1").join(second, "w2")
    pairs = scratch.table(pairs.select("lang", "w1", "w2", "a", F.col("f1").alias("l"), F.col("f2").alias("r"),
                                       _score(F.col("a"), F.col("f1"), F.col("f2")).alias("score"),
                                       _score(F.col("a"), F.col("f1"), F.col("a")).alias("bound")), "pairs")
    open_, reach, settled = scratch.table(pairs.select("lang").distinct(), "languages"), margin * top, []
    while not open_.isEmpty():
        floors = scratch.table(_floors(pairs, open_, reach), "floors")
        found = _round(tokens, pairs, floors, least, covered, filter_bits, scratch)
        enough = found.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
        done = floors.join(enough, "lang", "left").where((F.col("floor") == 0) | (F.col("n") >= top)).select("lang")
        done = scratch.table(done, "settled")
        settled.append(found.join(done, "lang", "left_semi"))
        open_, reach = scratch.table(open_.join(done, "lang", "left_anti"), "open"), reach * WIDER
    none = spark.createDataFrame([], "lang string, w1 bigint, w2 bigint, w3 bigint, w4 bigint, a bigint, l bigint, r bigint, score bigint")
    out = none
    for rows in settled:
        out = out.unionByName(rows)
    spelled = frequent.select(F.col("w"), F.col("word"))
    for i in range(1, 5):
        out = out.join(spelled.select(F.col("w").alias(f"w{i}"), F.col("word").alias(f"word{i}")), f"w{i}", "left")
    out = out.withColumn("phrase", F.concat_ws(" ", *[f"word{i}" for i in range(1, 5)]))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    out = out.withColumn("rank", rank).where(F.col("rank") <= top).join(totals, "lang")
    return out.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def _round(tokens: DataFrame, pairs: DataFrame, floors: DataFrame, least: int, covered: int, filter_bits: int, scratch: Scratch) -> DataFrame:
    """All surviving phrases at or above the floors of the languages that are open."""
    reached = F.col("score") >= F.col("floor")
    grown = F.col("bound") >= F.col("floor")
    mine = pairs.join(floors, "lang")
    keys = _tagged(mine, _ALIVE, "w1", "w2").unionByName(_tagged(mine.where(grown), _GROWN, "w1", "w2")).unionByName(
        _tagged(mine.where(reached), _HELD, "w1", "w2"))
    shared = _filter(keys, filter_bits)
    counted = scratch.table(_counted(tokens, 3, _triples, shared).where(F.col("a") >= least), "triple-counts")
    head = mine.select("lang", "floor", "w1", "w2", F.col("a").alias("f12"), F.col("l").alias("f1"))
    tail = pairs.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("f23"), F.col("r").alias("f3"))
    triples = (counted.join(head, ["w1", "w2"]).join(tail, ["w2", "w3"])
               .withColumn("worst", _worst((F.col("f1"), F.col("f23")), (F.col("f12"), F.col("f3"))))
               .select("lang", "floor", "w1", "w2", "w3", "a", "worst.l", "worst.r", "worst.score", _score(F.col("a"), F.col("f1"), F.col("a")).alias("bound")))
    triples = scratch.table(triples, "triples")
    keys = _tagged(mine, _ALIVE, "w1", "w2").unionByName(_tagged(triples.where(grown), _GROWN, "w1", "w2", "w3")).unionByName(
        _tagged(triples.where(reached), _HELD, "w1", "w2", "w3"))
    shared = _filter(keys, filter_bits)
    counted = scratch.table(_counted(tokens, 4, _quads, shared).where(F.col("a") >= least), "quad-counts")
    tail = pairs.select(F.col("w1").alias("w3"), F.col("w2").alias("w4"), F.col("a").alias("f34"), F.col("r").alias("f4"))
    known = triples.select("w1", "w2", "w3", F.col("a").alias("f123"))
    quads = counted.join(head, ["w1", "w2"]).join(tail, ["w3", "w4"]).join(known, ["w1", "w2", "w3"], "left")
    # a phrase whose prefix was not counted is below the floor; it only covers others
    quads = scratch.table(quads.withColumn("bound", F.when(F.col("f123").isNotNull(), F.least(
        _score(F.col("a"), F.col("f1"), F.col("a")), _score(F.col("a"), F.col("f12"), F.col("f34")), _score(F.col("a"), F.col("f123"), F.col("f4"))))), "quads")
    asked = scratch.table(quads.where(grown).select("w2", "w3", "w4").distinct(), "asked")
    shared = _filter(_tagged(asked, _WANTED, "w2", "w3", "w4"), filter_bits)
    answers = (_counted(tokens, 3, _wanted, shared)
               .select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("w3").alias("w4"), F.col("a").alias("f234")))
    answers = scratch.table(answers.join(asked, ["w2", "w3", "w4"], "left_semi"), "answers")
    scored = (quads.where(grown).join(answers, ["w2", "w3", "w4"])
              .withColumn("worst", _worst((F.col("f1"), F.col("f234")), (F.col("f12"), F.col("f34")), (F.col("f123"), F.col("f4"))))
              .select("lang", "floor", "w1", "w2", "w3", "w4", "a", "worst.l", "worst.r", "worst.score"))

    def longer(rows: DataFrame, names: list[str]) -> DataFrame:
        """The greatest count of what is one word longer, on either side."""
        ends = [rows.select(*[F.col(f"w{i + shift}").alias(w) for i, w in enumerate(names, 1)], "a") for shift in (0, 1)]
        return ends[0].unionByName(ends[1]).groupBy(*names).agg(F.max("a").alias("longer"))

    def survivors(rows: DataFrame, longer_rows: DataFrame | None, names: list[str]) -> DataFrame:
        rows = rows.where(reached)
        if longer_rows is not None:
            wide = lambda c: F.col(c).cast("decimal(20,0)")
            rows = rows.join(longer(longer_rows, names), names, "left").where(
                F.col("longer").isNull() | (wide("longer") * 100 < wide("a") * covered))
        blank = [F.lit(None).cast("bigint").alias(f"w{i}") for i in range(len(names) + 1, 5)]
        return rows.select("lang", *names, *blank, "a", "l", "r", "score")

    found = survivors(mine, triples, ["w1", "w2"]).unionByName(survivors(triples, quads, ["w1", "w2", "w3"])).unionByName(
        survivors(scored, None, ["w1", "w2", "w3", "w4"]))
    return scratch.table(found, "found")
