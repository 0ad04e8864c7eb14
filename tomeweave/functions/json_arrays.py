"""Arrays of JSON cut into their elements by the tasks that read them, piece by piece in file order.

A piece ends at a closing brace.  Of its text a task needs only the brackets and commas that stand
outside strings, read from outside and from inside of one; no task has to see another's pieces.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import cloudpickle

# executors need no copy of this package: the helpers travel with the task
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPLIT = ("file string, _block bigint, _size bigint, _pieces bigint, _octets bigint, _starts boolean, "
         "_ways array<struct<inside: int, deep: bigint, ends: map<bigint, bigint>, commas: map<bigint, bigint>>>")
ENTRY = ("file string, _block bigint, _entry struct<inside: int, deep: bigint, element: bigint, commas: bigint, pieces: bigint, "
         "first: boolean, final: boolean, closed: boolean, lone: boolean>")
ELEMENT = "file string, _block bigint, _element bigint, _before bigint, _whole boolean, _end boolean, _depth bigint, text binary"

_COUNTS = pa.map_(pa.int64(), pa.int64())
_WAY = pa.struct([("inside", pa.int32()), ("deep", pa.int64()), ("ends", _COUNTS), ("commas", _COUNTS)])
_SPLIT = pa.schema([("file", pa.string()), ("_block", pa.int64()), ("_size", pa.int64()), ("_pieces", pa.int64()), ("_octets", pa.int64()),
                    ("_starts", pa.bool_()), ("_ways", pa.list_(_WAY))])
_AT = pa.struct([("inside", pa.int32()), ("deep", pa.int64()), ("element", pa.int64()), ("commas", pa.int64()), ("pieces", pa.int64()),
                 ("first", pa.bool_()), ("final", pa.bool_()), ("closed", pa.bool_()), ("lone", pa.bool_())])
_ENTRY = pa.schema([("file", pa.string()), ("_block", pa.int64()), ("_entry", _AT)])
_ELEMENT = pa.schema([("file", pa.string()), ("_block", pa.int64()), ("_element", pa.int64()), ("_before", pa.int64()), ("_whole", pa.bool_()),
                      ("_end", pa.bool_()), ("_depth", pa.int64()), ("text", pa.binary())])
#: Rows and bytes of elements that are handed over at once.
_ROWS, _BYTES = 4096, 1 << 22
#: Pieces repeat their marks, so most are read by one look.
_KNOWN: dict[str, tuple] = {}
_KNOWN_MARKS, _KNOWN_CHARS = 4096, 200


def _shape(marks: str) -> tuple[int, dict[int, int]]:
    """How much deeper the marks of a piece lead, and how many commas stand at each depth, counted from its start."""
    known = _KNOWN.get(marks)
    if known is None:
        deep, commas = 0, Counter()
        for mark in marks:
            if mark == ",":
                commas[deep] += 1
            else:
                deep += -1 if mark == "]" else 1
        known = deep, commas
        if len(marks) <= _KNOWN_CHARS:
            if len(_KNOWN) >= _KNOWN_MARKS:
                _KNOWN.clear()
            _KNOWN[marks] = known
    return known


class _Way:
    """What a split's pieces do to a reader that enters it outside (0) or inside (1) of a string; depths count from there."""

    def __init__(self, inside: int) -> None:
        self.inside, self.deep, self.ends, self.commas = inside, 0, Counter(), Counter()

    def read(self, marks: tuple[str, str], leads: tuple[int, int]) -> None:
        more, commas = _shape(marks[self.inside])
        for depth, n in commas.items():
            self.commas[self.deep + depth] += n
        self.deep += more
        self.inside = leads[self.inside]
        # the brace behind the piece counts where it stands outside strings
        if not self.inside:
            self.deep -= 1
            self.ends[self.deep] += 1

    def row(self) -> dict:
        return {"inside": self.inside, "deep": self.deep, "ends": list(self.ends.items()), "commas": list(self.commas.items())}


def _columns(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*(batch.column(name).to_pylist() for name in names))


def summaries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces to one row for each split of a file."""
    split, ways = None, ()

    def packed():
        return pa.RecordBatch.from_pylist([split | {"_ways": [way.row() for way in ways]}], _SPLIT)

    for batch in batches:
        for file, block, size, octets, starts, out, inn, marks_out, marks_in in _columns(
                batch, "file", "_block", "_size", "_octets", "_starts", "_from_0", "_from_1", "_marks_0", "_marks_1"):
            if split is None or block != split["_block"] or file != split["file"]:
                if split:
                    yield packed()
                split, ways = {"file": file, "_block": block, "_size": size, "_pieces": 0, "_octets": 0, "_starts": starts}, (_Way(0), _Way(1))
            split["_pieces"] += 1
            split["_octets"] += octets
            for way in ways:
                way.read((marks_out, marks_in), (out, inn))
    if split:
        yield packed()


def entries(splits: pa.Table) -> pa.Table:
    """One file's splits to the state, depth, element and number of commas in which each of them is entered."""
    rows = sorted(splits.to_pylist(), key=lambda row: row["_block"])
    lone = rows[0]["_starts"]
    # a file that ends with a brace has one behind its last piece, too: its size tells (a byte order mark is not read)
    closed = rows[0]["_size"] - sum(row["_octets"] for row in rows) in (0, 3)
    inside = deep = element = commas = 0
    found = []
    for row in rows:
        at = {"inside": inside, "deep": deep, "element": element, "commas": commas, "pieces": row["_pieces"], "first": row is rows[0],
              "final": row is rows[-1], "closed": closed, "lone": lone}
        found.append({"file": row["file"], "_block": row["_block"], "_entry": at})
        way = row["_ways"][inside]
        element += 0 if lone else dict(way["ends"]).get(1 - deep, 0)
        commas += dict(way["commas"]).get(1 - deep, 0)
        deep += way["deep"]
        inside = way["inside"]
    return pa.Table.from_pylist(found, _ENTRY)


def elements(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces to the texts of elements, ``_whole`` ones and parts of those that splits share.

    ``_before`` counts the items in front of an element: between items stand the commas one level deep.
    """
    rows, held_bytes, at, block = [], 0, None, None
    for batch in batches:
        found = batch.column("_entry")
        for i, (file, start, out, inn, marks_out, marks_in, value) in enumerate(
                _columns(batch, "file", "_block", "_from_0", "_from_1", "_marks_0", "_marks_1", "value")):
            if start != block or file != at:
                at, block, entry = file, start, found[i].as_py()
                inside, deep, element, commas, left = (entry[name] for name in ("inside", "deep", "element", "commas", "pieces"))
                # a split before this one may have begun its first element
                shared, parts, before = not entry["first"], [], commas
            left -= 1
            last = entry["final"] and not left
            braced = entry["closed"] or not last
            more, ahead = _shape(marks_in if inside else marks_out)
            commas += ahead.get(1 - deep, 0)
            deep += more
            inside = inn if inside else out
            parts.append(value + b"}" if braced else value)
            ends = False
            if braced and not inside:
                deep -= 1
                ends = deep == 1 and not entry["lone"]
            if ends or not left:
                text = b"".join(parts)
                rows.append({"file": file, "_block": block, "_element": element, "_before": before + 1 if element else 0,
                             "_whole": not shared and (ends or last), "_end": last, "_depth": deep, "text": text})
                held_bytes += len(text)
                element, before, shared, parts = element + ends, commas, False, []
                if len(rows) >= _ROWS or held_bytes >= _BYTES:
                    yield pa.RecordBatch.from_pylist(rows, _ELEMENT)
                    rows, held_bytes = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, _ELEMENT)
