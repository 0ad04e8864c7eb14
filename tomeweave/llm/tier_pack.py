"""Packing of token sequences into several context sizes.

*Route.*  A document is its ids and an end id.  What fills the longest context whole becomes
sequences of its own; the rest goes to the tier of the smallest context that holds it.

*Pack.*  Tiers go from the longest context to the shortest.  A document of the tier opens a
sequence; its gap takes the longest documents of shorter tiers that fit, and when none fits, the
head of the longest one there (else of the shortest of its own tier).  The rest of a cut document
is routed anew.  So a sequence is exactly as long as its context, and at most one cut closes it.

*Rest.*  When a tier has fewer tokens left than its context, they wait for the next batch.  What a
task has left at its end, less than one longest context, is cut at powers of two, so nothing at
all is padded: a sequence's length is a context or, in that rest, a smaller power of two.

*Step groups.*  Sequences are dealt to groups of equal tokens, each group from the longest
sequences to the shortest.  All sizes are powers of two, so a group is filled exactly; a task
leaves at most one group open.

A task packs what it reads, batch by batch, and holds one batch and a rest.  Nothing is shuffled
and no plan of the whole table is made: a sequence's number is the task's and its own.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeweave.llm.token_counts import encoded

TIERS = (512, 1024, 2048, 4096)
GROUP_TOKENS = 1 << 16


class Item:
    """A stretch of one document's tokens that no sequence holds yet."""

    __slots__ = ("owner", "start", "tokens")

    def __init__(self, owner: int, start: int, tokens: np.ndarray) -> None:
        self.owner, self.start, self.tokens = owner, start, tokens

    def __len__(self) -> int:
        return len(self.tokens)

    def head(self, n: int) -> tuple[Item, Item]:
        return Item(self.owner, self.start, self.tokens[:n]), Item(self.owner, self.start + n, self.tokens[n:])


class Shelf:
    """Items by length; the longest that fits is found by bisection."""

    def __init__(self) -> None:
        self.lengths: list[int] = []
        self.items: dict[int, list[Item]] = {}
        self.tokens = 0

    def put(self, item: Item) -> None:
        if len(item) not in self.items:
            insort(self.lengths, len(item))
            self.items[len(item)] = []
        self.items[len(item)].append(item)
        self.tokens += len(item)

    def take(self, at: int) -> Item:
        length = self.lengths[at]
        item = self.items[length].pop()
        if not self.items[length]:
            del self.items[length], self.lengths[at]
        self.tokens -= length
        return item

    def at_most(self, n: int) -> int:
        """Place of the longest length up to ``n``; -1 for none."""
        return bisect_right(self.lengths, n) - 1


class Packer:
    """Sequences of one task; ``sequences`` lists those that are closed since it was last emptied."""

    def __init__(self, tiers: tuple[int, ...] = TIERS) -> None:
        if list(tiers) != sorted(set(tiers)) or any(t < 1 or t & (t - 1) for t in tiers):
            raise ValueError("context sizes must be ascending powers of two")
        self.tiers, self.longest = tiers, tiers[-1]
        self.shelf = Shelf()
        self.sequences: list[list[Item]] = []

    def add(self, item: Item) -> None:
        whole = len(item) // self.longest * self.longest
        for low in range(0, whole, self.longest):
            self.sequences.append([Item(item.owner, item.start + low, item.tokens[low:low + self.longest])])
        if len(item) > whole:
            self.shelf.put(item.head(whole)[1] if whole else item)

    def _fill(self, size: int, at: int, shorter: int) -> None:
        """One sequence of ``size`` tokens: the document at ``at`` opens it, those up to ``shorter`` fill its gap."""
        sequence, gap = [], size
        while gap:
            item = self.shelf.take(at)
            if len(item) > gap:
                item, rest = item.head(gap)
                self.shelf.put(rest)
            sequence.append(item)
            gap -= len(item)
            if gap:
                at = self.shelf.at_most(min(gap, shorter))
                if at < 0:
                    at = max(self.shelf.at_most(shorter), 0)
        self.sequences.append(sequence)

    def pack(self) -> None:
        """Close all sequences of every tier that its tokens and those of shorter tiers can fill."""
        for size, shorter in zip(self.tiers[::-1], (*self.tiers[-2::-1], 0)):
            while self.shelf.tokens >= size and (at := self.shelf.at_most(size)) >= 0 and self.shelf.lengths[at] > shorter:
                self._fill(size, at, shorter or size)

    def finish(self) -> None:
        """Close the rest at powers of two, the longest first."""
        while self.shelf.tokens:
            size = min(self.longest, 1 << (self.shelf.tokens.bit_length() - 1))
            self._fill_any(size)

    def _fill_any(self, size: int) -> None:
        sequence, gap = [], size
        while gap:
            item = self.shelf.take(max(self.shelf.at_most(gap), 0))
            if len(item) > gap:
                item, rest = item.head(gap)
                self.shelf.put(rest)
            sequence.append(item)
            gap -= len(item)
        self.sequences.append(sequence)


class Groups:
    """Step groups of equal tokens: sequences in descending length go to the group with the least room that holds them."""

    def __init__(self, tokens: int) -> None:
        if tokens < 1 or tokens & (tokens - 1):
            raise ValueError("a group's tokens must be a power of two")
        self.tokens, self.count = tokens, 0
        self.rooms: list[int] = []
        self.open: dict[int, list[int]] = {}

    def place(self, sizes: list[int]) -> list[int]:
        out = [0] * len(sizes)
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            at = bisect_left(self.rooms, sizes[i])
            if at == len(self.rooms):
                room, group, self.count = self.tokens, self.count, self.count + 1
            else:
                room = self.rooms[at]
                group = self.open[room].pop()
                if not self.open[room]:
                    del self.open[room], self.rooms[at]
            out[i] = group
            if left := room - sizes[i]:
                if left not in self.open:
                    insort(self.rooms, left)
                    self.open[left] = []
                self.open[left].append(group)
        return out


_COLUMNS = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "context", "step_group"]


def _packed(path: str, end_id: int, tiers: tuple[int, ...], group_tokens: int, with_ids: bool):
    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        packer, groups, made = Packer(tiers), Groups(group_tokens), 0
        owners: dict[int, tuple] = {}
        number, kind = 0, None

        def closed() -> pa.RecordBatch:
            nonlocal made, owners
            rows: list[tuple] = []
            sizes = [sum(map(len, s)) for s in packer.sequences]
            for sequence, size, group in zip(packer.sequences, sizes, groups.place(sizes)):
                offset = 0
                for item in sequence:
                    raw = item.tokens.tobytes()
                    row = (*owners[item.owner], item.start, len(item), zlib.crc32(raw), base + made, offset, size, base + group)
                    rows.append((*row, raw) if with_ids else row)
                    offset += len(item)
                made += 1
            packer.sequences.clear()
            # the rest keeps its own tokens, not the batch's
            left: dict[int, tuple] = {}
            for items in packer.shelf.items.values():
                for item in items:
                    left[item.owner], item.tokens = owners[item.owner], item.tokens.copy()
            owners = left
            ids, total, start, length, crc, sequence_id, offset, context, group, *raw = list(zip(*rows)) or [()] * (9 + with_ids)
            long = lambda x: pa.array(list(x), pa.int64())
            columns = [pa.array(list(ids), kind), *map(long, (start, length, crc, total, sequence_id, offset)), pa.array(list(context), pa.int32()), long(group)]
            return pa.record_batch([*columns, *[pa.array(list(x), pa.binary()) for x in raw]], [*_COLUMNS, *(["ids"] if with_ids else [])])

        for batch in batches:
            kind = batch.column("id").type
            ids = batch.column("id").to_pylist()
            for low, tokens, bounds in encoded(path, batch.column("text")):
                tokens = np.insert(tokens, bounds[1:], end_id).astype("<u4")
                bounds = (bounds + np.arange(len(bounds))).tolist()
                for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    owners[number] = (ids[low + k], b - a)
                    packer.add(Item(number, 0, tokens[a:b]))
                    number += 1
                packer.pack()
                yield closed()
        packer.finish()
        if packer.sequences:
            yield closed()
    return body


def tier_pack(docs: DataFrame, path: str, tiers: tuple[int, ...] = TIERS, end_id: int = 2, group_tokens: int = GROUP_TOKENS, with_ids: bool = True,
              text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Whole documents packed into sequences of several context sizes, without padding.

    Returns per piece ``id_col``, ``start`` (the document's tokens before it), ``length``,
    ``ids_crc32``, ``doc_tokens`` (with the end id), ``sequence_id``, ``offset``, ``context`` (the
    sequence's tokens: one of ``tiers``, or a smaller power of two in a task's last rest),
    ``step_group``, and with ``with_ids`` the ``ids`` as little-endian unsigned 32-bit numbers.

    * Null and empty texts are one piece that holds ``end_id`` alone.
    * A text longer than the longest context is cut there; any length is packed.
    * Each row is packed, also one that stands twice or has a null id.  Among documents of equal
      length the one read last goes first.
    * Other columns of ``docs`` are left out, so their names cannot clash.
    * An empty table gives an empty table.
    """
    Packer(tiers), Groups(group_tokens)
    if group_tokens < tiers[-1]:
        raise ValueError("a step group must hold the longest context")
    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(
        _packed(path, end_id, tuple(tiers), group_tokens, with_ids),
        f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, context int, "
        f"step_group bigint{', ids binary' if with_ids else ''}")
    return found.withColumnRenamed("id", id_col)
