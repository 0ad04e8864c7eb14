"""Substring de-duplication by seed and extend.

Seeds are winnowed anchors: of the ``anchor_words``-grams of every window of ``min_words`` words,
the one with the least hash (the first of equals).  Equal windows choose equal anchors, so every
repeat of ``min_words`` words meets at one.  Neighbouring windows that choose the same anchor form
a *run*, which reaches as far to both sides of the anchor as the choice holds.

1. One row per run: document, place, hash of the anchor, hash of the whole stretch of words.
2. Runs join on anchors that occur more than once; all other text is out.
3. An anchor whose runs all have one stretch extends both ways over the whole of it, for every
   copy, in one step: a group of copies is never expanded to pairs.
4. Where stretches differ (the edges of a repeat), each different stretch is extended word by word:
   the hashes of its windows are counted over one representative per stretch.

A window's identity is the pair (anchor hash, window or stretch hash), 128 bits.  The union of the
repeated windows of a document gives its maximal repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeweave.llm._store import Scratch
from tomeweave.llm._words import SPACES, Words, between, binaries, pieces, running, windows

ANCHOR_WORDS = 6
ROWS = 500
RUNS = "row bigint, start int, length int, anchor bigint, stretch bigint"
OPENED = "anchor bigint, stretch bigint, window bigint, row bigint, start int"


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _first_least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of ``values[i:i + width]``, the first of equals."""
    at, have = np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        a, b = at[:-step], at[step:]
        at = np.where(values[a] <= values[b], a, b)
        have += step
    return at


def _runs_of(words: Words, min_words: int, anchor_words: int):
    """Runs of windows with one anchor: first window, number of windows, anchor's hash, stretch's hash."""
    starts, grams = windows(words, anchor_words)
    full = np.full(len(words), np.iinfo(np.uint64).max, np.uint64)
    full[starts] = grams
    whole = words.left >= min_words
    width = min_words - anchor_words + 1
    at = np.flatnonzero(whole)
    if not len(at):
        return at, at, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    chosen = _first_least(full, width)[at]
    new = np.ones(len(at), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (at[1:] != at[:-1] + 1)
    head = np.flatnonzero(new)
    length = np.diff(np.append(head, len(at)))
    first = at[head]
    sums = running(words.hash ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    return first, length, full[chosen[head]], between(sums, first, first + length + min_words - 1)


def _find_runs(min_words: int, anchor_words: int):
    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("row").to_numpy()
            for low, _, data, offsets in pieces(batch.column("text")):
                words = Words(data, offsets, SPACES, False)
                first, length, anchor, stretch = _runs_of(words, min_words, anchor_words)
                if len(first):
                    text = np.searchsorted(words.bounds, first, "right") - 1
                    yield pa.record_batch([
                        pa.array(rows[low + text]), pa.array((first - words.bounds[text]).astype(np.int32)),
                        pa.array(length.astype(np.int32)), pa.array(_signed(anchor)), pa.array(_signed(stretch))],
                        ["row", "start", "length", "anchor", "stretch"])
    return body


def _open_runs(min_words: int, anchor_words: int):
    """The windows of the named runs of a document, one row each."""
    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked, bounds = batch.column("starts").flatten().to_numpy(), batch.column("starts").offsets.to_numpy()
            bounds = bounds - bounds[0]
            rows = batch.column("row").to_numpy()
            for low, high, data, offsets in pieces(batch.column("text")):
                words = Words(data, offsets, SPACES, False)
                first, length, anchor, stretch = _runs_of(words, min_words, anchor_words)
                wanted = asked[bounds[low]:bounds[high]] + np.repeat(words.bounds[:-1], np.diff(bounds[low:high + 1]))
                named = np.isin(first, wanted)
                first, length, anchor, stretch = first[named], length[named], anchor[named], stretch[named]
                if not len(first):
                    continue
                run = np.repeat(np.arange(len(first)), length)
                at = first[run] + np.arange(len(run)) - np.repeat(np.cumsum(length) - length, length)
                sums = running(words.hash ^ np.uint64(0x5A5A5A5A5A5A5A5A))
                text = np.searchsorted(words.bounds, at, "right") - 1
                yield pa.record_batch([
                    pa.array(_signed(anchor)[run]), pa.array(_signed(stretch)[run]),
                    pa.array(_signed(between(sums, at, at + min_words))), pa.array(rows[low + text]),
                    pa.array((at - words.bounds[text]).astype(np.int32))],
                    ["anchor", "stretch", "window", "row", "start"])
    return body


def repeated_windows(docs: DataFrame, scratch: Scratch, min_words: int = 35, anchor_words: int = ANCHOR_WORDS) -> DataFrame:
    """Ranges of start words of repeated windows: ``row, start, length`` for ``docs(row, text)``."""
    runs = scratch.table(docs.mapInArrow(_find_runs(min_words, anchor_words), RUNS), "runs")
    # an aggregate that a join reads is stored first: a join straight over it could not split a hot key
    shared = scratch.table(
        runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("stretch").alias("low"), F.max("stretch").alias("high"))
        .where("n > 1").select("anchor", (F.col("low") != F.col("high")).alias("mixed")), "shared")
    met = scratch.table(runs.join(shared, "anchor"), "met")
    every = scratch.table(met.groupBy("anchor", "stretch").agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct("row", "start")).alias("one"), F.first("mixed").alias("mixed")), "stretches")
    stretches = every.where("mixed")
    opened = (stretches.select("one.*").groupBy("row").agg(F.collect_list("start").alias("starts"))
              .join(docs, "row").mapInArrow(_open_runs(min_words, anchor_words), OPENED))
    opened = scratch.table(opened.join(stretches.select("anchor", "stretch", "copies"), ["anchor", "stretch"]), "opened")
    again = scratch.table(opened.groupBy("anchor", "window").agg(F.sum("copies").alias("n")).where("n > 1").select("anchor", "window"), "again")
    edges = (opened.where("copies = 1").join(again, ["anchor", "window"], "left_semi")
             .select("row", "start", F.lit(1).alias("length")))
    # one join for all: a run passes at most once, whatever other stretches its anchor has
    several = every.where("copies > 1").select("anchor", "stretch")
    whole = met.join(several, ["anchor", "stretch"], "left_semi")
    return whole.select("row", "start", "length").unionByName(edges)


def _cover(start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, start, 1)
    np.add.at(steps, end, -1)
    return np.cumsum(steps[:-1]) > 0


def _cut(min_words: int, rejoin: bool):
    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a few rows at a time keep a worker's memory small
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            out = {"n_words": [], "n_removed": [], "kept_text": [], "repeats": []}
            for text, found in zip(batch.column("text"), batch.column("found")):
                words = (text.as_py() or "").encode().split()
                hit = np.zeros(len(words), bool)
                if found.is_valid and len(found):
                    # a row that stands twice has its ranges twice; that changes nothing
                    start = found.values.field("start").to_numpy()
                    hit = _cover(start, start + found.values.field("length").to_numpy() + min_words - 1, len(words))
                    words = [words[i] for i in np.flatnonzero(~hit)]
                edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
                out["n_words"].append(len(hit))
                out["n_removed"].append(int(hit.sum()))
                out["kept_text"].append(b" ".join(words).decode() if rejoin or hit.any() else text.as_py())
                out["repeats"].append([{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])])
            kept = [i for i, name in enumerate(batch.schema.names) if name not in ("text", "found", "row")]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.record_batch([*[batch.column(i) for i in kept], pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()),
                                   pa.array(out["kept_text"], pa.string()), pa.array(out["repeats"], kind)],
                                  [*[batch.schema.names[i] for i in kept], *out])
    return body


def substring_dedup(docs: DataFrame, min_words: int = 35, anchor_words: int = ANCHOR_WORDS, text: str = "text",
                    id_col: str = "doc_id", keep: tuple[str, ...] = (), rejoin: bool = True, scratch: Scratch | None = None) -> DataFrame:
    """Remove every word that a window of ``min_words`` words covers whose words stand anywhere else.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged.  Windows are judged on the input, so all copies
    of a repeat go.  Returns ``id_col`` and ``n_words``, ``n_removed``, ``kept_text`` (the words
    left, joined by one space; without ``rejoin`` a text that loses nothing stays as it is) and
    ``repeats`` (the maximal repeats as ranges of words).

    * Null and empty texts have no words: 0, 0 and an empty ``kept_text``.
    * A row that stands twice is its own copy: its windows are repeats.
    * Null or repeated ids are allowed; a row is known by a hash of its id and its text.
    * Columns that ``keep`` names come along in a struct ``kept``; all others are left out.
    * An empty table gives an empty table.
    """
    if not 1 <= anchor_words <= min_words:
        raise ValueError("anchor_words must lie between 1 and min_words")
    scratch = scratch or Scratch(docs.sparkSession, "substring-dedup")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.xxhash64(F.col(id_col), F.col(text)).alias("row"),
                       *([F.struct(*keep).alias("kept")] if keep else []))
    found = (repeated_windows(rows.select("row", "text"), scratch, min_words, anchor_words)
             .groupBy("row").agg(F.collect_list(F.struct("start", "length")).alias("found")))
    names = [c for c in rows.columns if c not in ("text", "row")]
    kind = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names)
    out = (rows.join(found, "row", "left").select(*names, "row", "text", "found")
           .mapInArrow(_cut(min_words, rejoin), f"{kind}, n_words bigint, n_removed bigint, kept_text string, "
                                        "repeats array<struct<start: bigint, end: bigint>>"))
    return out.withColumnRenamed("id", id_col)
