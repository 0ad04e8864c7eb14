"""Best-fit packing of token sequences with large-item matching.

The plan needs only how many pieces there are of each length, at most ``capacity`` numbers:

* pieces above a third of the capacity: at most two fit one bin.  From the longest on, each is
  matched with the longest other one that still fits;
* smaller pieces, from the longest on, go to the bins with the least gap that holds them.

Equal bins are handled as one group with a count, so a plan has some thousand groups however many
bins it stands for.  Each group and length takes a range of the ranks that pieces have among those
of their length; a piece finds its bin and place from its rank.  Ranks are counted in two phases:
within the task that made the pieces, and over the tasks' totals.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tomeweave.llm._store import Scratch
from tomeweave.llm.token_counts import encoded

CAPACITY = 4096


class Plan:
    """Groups of equal bins: how many, and the lengths in each with their ranks.

    ``take[length]`` lists (first rank, bins, first bin, items per bin, offset): rank ``r`` of that
    range stands in bin ``first bin + (r - first rank) // items``.
    """

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.capacity, self.bins = capacity, 0
        self.take: dict[int, list[tuple[int, int, int, int, int]]] = {length: [] for length in counts}
        self.left = dict(counts)
        self.used = dict.fromkeys(counts, 0)
        self._gaps: list[int] = []
        self._open: dict[int, list[tuple[int, int]]] = {}
        third = capacity // 3
        self._match(sorted(x for x in counts if x > third and counts[x]))
        for length in sorted((x for x in counts if 0 < x <= third and counts[x]), reverse=True):
            self._fit(length)

    def _new(self, bins: int) -> int:
        first, self.bins = self.bins, self.bins + bins
        return first

    def _place(self, length: int, bins: int, first: int, each: int, offset: int) -> None:
        n = bins * each
        self.take[length].append((self.used[length], bins, first, each, offset))
        self.used[length] += n
        self.left[length] -= n

    def _keep(self, gap: int, first: int, bins: int) -> None:
        if gap and bins:
            if gap not in self._open:
                insort(self._gaps, gap)
                self._open[gap] = []
            self._open[gap].append((first, bins))

    def _match(self, lengths: list[int]) -> None:
        while lengths:
            big = lengths[-1]
            n = self.left[big]
            at = bisect_right(lengths, self.capacity - big) - 1
            if at < 0:
                first = self._new(n)
                self._place(big, n, first, 1, 0)
                self._keep(self.capacity - big, first, n)
                lengths.pop()
                continue
            other = lengths[at]
            if other == big:
                bins = n // 2
                if bins:
                    first = self._new(bins)
                    self._place(big, bins, first, 2, 0)
                    self._keep(self.capacity - 2 * big, first, bins)
                if self.left[big]:
                    # the odd one looks for the next smaller partner
                    at -= 1
                    if at < 0:
                        first = self._new(1)
                        self._place(big, 1, first, 1, 0)
                        self._keep(self.capacity - big, first, 1)
                        lengths.pop()
                        continue
                    other = lengths[at]
                else:
                    lengths.pop()
                    continue
            bins = min(self.left[big], self.left[other])
            first = self._new(bins)
            self._place(big, bins, first, 1, 0)
            self._place(other, bins, first, 1, big)
            self._keep(self.capacity - big - other, first, bins)
            for x in {big, other}:
                if not self.left[x]:
                    lengths.remove(x)

    def _fit(self, length: int) -> None:
        while n := self.left[length]:
            at = bisect_left(self._gaps, length)
            if at == len(self._gaps):
                bins = -(-n // (self.capacity // length))
                gap, (first, bins) = self.capacity, (self._new(bins), bins)
            else:
                gap = self._gaps[at]
                first, bins = self._open[gap].pop()
                if not self._open[gap]:
                    del self._open[gap]
                    del self._gaps[at]
            each = gap // length
            whole = min(bins, n // each)
            if whole:
                self._place(length, whole, first, each, self.capacity - gap)
                self._keep(gap - each * length, first, whole)
                first, bins = first + whole, bins - whole
            rest = self.left[length] if bins else 0
            if rest and rest < each:
                self._place(length, 1, first, rest, self.capacity - gap)
                self._keep(gap - rest * length, first, 1)
                first, bins = first + 1, bins - 1
            self._keep(gap, first, bins)


def _cut(path: str, end_id: int, capacity: int):
    """Pieces of every document, numbered per length within the task."""
    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for low, ids, bounds in encoded(path, batch.column("text")):
                n = len(bounds) - 1
                tokens = np.insert(ids, bounds[1:], end_id).astype("<u4")
                bounds = bounds + np.arange(n + 1)
                parts = -(-np.diff(bounds) // capacity)
                row = np.repeat(np.arange(n), parts)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
                start = piece * capacity
                length = np.minimum(capacity, np.diff(bounds)[row] - start)
                raw = memoryview(np.ascontiguousarray(tokens)).cast("B")
                begin = 4 * (bounds[row] + start)
                crc = [zlib.crc32(raw[a:a + 4 * k]) for a, k in zip(begin.tolist(), length.tolist())]
                order = np.argsort(length, kind="stable")
                ordered = length[order]
                head = np.searchsorted(ordered, ordered)
                within = np.empty(len(order), np.int64)
                within[order] = np.arange(len(order)) - head + seen[ordered]
                seen += np.bincount(length, minlength=capacity + 1)
                yield pa.record_batch([
                    batch.column("id").slice(low, n).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length),
                    pa.array(crc, pa.int64()), pa.array(np.full(len(row), task, np.int32)), pa.array(within)],
                    ["id", "piece", "start", "length", "ids_crc32", "task", "within"])
    return body


def _assign(shared):
    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take = shared.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            for size in np.unique(ordered):
                mine = order[np.searchsorted(ordered, size):np.searchsorted(ordered, size, "right")]
                ranges = take[int(size)]
                at = np.searchsorted(ranges[:, 0], rank[mine], "right") - 1
                begin, first, each, place = ranges[at, 0], ranges[at, 2], ranges[at, 3], ranges[at, 4]
                sequence[mine] = first + (rank[mine] - begin) // each
                offset[mine] = place + (rank[mine] - begin) % each * size
            names = ["id", "piece", "start", "length", "ids_crc32"]
            yield pa.record_batch([*[batch.column(c) for c in names], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])
    return body


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 1, text: str = "text", id_col: str = "doc_id",
         scratch: Scratch | None = None) -> DataFrame:
    """Whole documents packed into sequences of at most ``capacity`` tokens.

    A document is its ids and ``end_id``; only a longer one is cut, into pieces of ``capacity``.
    Returns per piece ``id_col``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``
    and ``offset``; a sequence is filled from 0 without gaps.

    * Null and empty texts are one piece that holds ``end_id`` alone.
    * Each row is packed, also one that stands twice or has a null id.
    * Other columns of ``docs`` are left out, so their names cannot clash.
    * An empty table gives an empty table.
    """
    if not 0 < capacity <= 1 << 16:
        raise ValueError("capacity must lie between 1 and 65536: the plan keeps a count for each length")
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    scratch = scratch or Scratch(spark, "pack")
    cut = scratch.table(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(
        _cut(path, end_id, capacity), f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, task int, within bigint"), "pieces")
    totals = scratch.table(cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "totals")
    # at most ``capacity`` rows reach the driver
    counts = {r["length"]: r["n"] for r in totals.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = Plan(counts, capacity)
    shared = spark.sparkContext.broadcast({length: np.array(rows, np.int64).reshape(-1, 5) for length, rows in plan.take.items()})
    before = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    placed = (cut.join(offsets, ["length", "task"]).withColumn("rank", F.col("before") + F.col("within"))
              .select("id", "piece", "start", "length", "ids_crc32", "rank")
              .mapInArrow(_assign(shared), f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"))
    return placed.withColumnRenamed("id", id_col)
