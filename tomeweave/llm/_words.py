"""Words, hashes and windows of many texts at once, in numpy over Arrow buffers.

A word's hash is a sum over its bytes, each numbered by letter and place; a window's hash is a polynomial
over the hashes of its words.  Both come from a running sum, so their cost does not depend on the
window's length.  Windows of the operators have at most some 50 words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD1342543DE82EF95)
_LETTERS = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWERED = _LETTERS.copy()
_LOWERED[65:91] = _LETTERS[97:123]
#: A number for each letter at each of ``_PLACES`` places of a word, as written and lower-cased.
_PLACES, _BLOCK = 64, 1 << 15
_PLACED = np.random.default_rng(20240301).integers(1, 1 << 63, (_PLACES, 256), dtype=np.uint64)
_PLACED_LOWERED = _PLACED.copy()
_PLACED_LOWERED[:, 65:91] = _PLACED[:, 97:123]

#: Separators as a table over bytes: white space, and all ASCII but digits and small letters.
SPACES = np.zeros(256, bool)
SPACES[[32, *range(9, 14)]] = True
MARKS = np.zeros(256, bool)
MARKS[:128] = True
MARKS[48:58] = MARKS[97:123] = MARKS[65:91] = False


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over the word."""
    x = x ^ (x >> np.uint64(32))
    x *= _ODD
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)
        self.inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = (n // 65536 + 2) * 65536
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE)]), dtype=np.uint64)
                self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, self.inverse)]), dtype=np.uint64)
        return self.up[:n], self.down[:n]


_powers = _Powers()


def running(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values times powers; ``between`` reads hashes of ranges off them."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers.upto(len(values) + 1)[0][:len(values)], out=out[1:])
    return out


def between(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of ``values[start:end]`` for each pair."""
    return mixed((sums[end] - sums[start]) * _powers.upto(len(sums))[1][start] + end.astype(np.uint64) - start.astype(np.uint64))


def _letter_sums(data: np.ndarray, start: np.ndarray, lower: bool) -> np.ndarray:
    """Prefix sums of letters, each letter at each place of a word being a number of its own.

    Behind the last place of the table the places begin again, times a mixed number.  A polynomial
    modulo 2^64 would not do for long words: it gives one hash to words whose letters differ in a
    pattern that its powers of two cancel.
    """
    table = (_PLACED_LOWERED if lower else _PLACED).ravel()
    sums, begin = np.zeros(len(data) + 1, np.uint64), 0
    for low in range(0, len(data), _BLOCK):
        part = data[low:low + _BLOCK]
        mine = start[np.searchsorted(start, low):np.searchsorted(start, low + len(part))] - low
        place = np.full(len(part), begin - low, np.int64)
        place[mine] = mine
        np.maximum.accumulate(place, out=place)
        begin = int(place[-1]) + low
        np.subtract(np.arange(len(part)), place, out=place)
        letters = table[((place & (_PLACES - 1)) << 8) | part]
        if place.max() >= _PLACES:
            far = place >= _PLACES
            letters[far] *= mixed((place[far] // _PLACES).astype(np.uint64)) | np.uint64(1)
        out = sums[low + 1:low + 1 + len(part)]
        np.cumsum(letters, out=out)
        out += sums[low]
    return sums


class Words:
    """Words of consecutive texts: byte ranges, hashes, and each text's range of words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray, lower: bool,
                 cut: np.ndarray | None = None) -> None:
        inside = ~separators[data]
        fresh = np.zeros(len(data) + 1, bool)
        fresh[offsets] = True
        if cut is not None:
            fresh[:-1] |= cut
        before = np.empty(len(data), bool)
        before[:1] = True
        np.logical_not(inside[:-1], out=before[1:])
        self.start = np.flatnonzero(inside & (before | fresh[:-1]))
        after = np.empty(len(data), bool)
        after[-1:] = True
        np.logical_not(inside[1:], out=after[:-1])
        self.end = np.flatnonzero(inside & (after | fresh[1:])) + 1
        self.data, self.offsets = data, offsets
        self.bounds = np.searchsorted(self.start, offsets)
        sums = _letter_sums(data, self.start, lower)
        self.hash = mixed(sums[self.end] - sums[self.start] + (self.end - self.start).astype(np.uint64))

    def __len__(self) -> int:
        return len(self.start)

    @property
    def text(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.bounds))

    @property
    def left(self) -> np.ndarray:
        """How many words of its text stand from each word on."""
        return np.repeat(self.bounds[1:], np.diff(self.bounds)) - np.arange(len(self))


def pieces(column: pa.Array, size: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """A text column in runs of rows of about ``size`` bytes: (first row, end row, bytes, offsets).

    A null counts as an empty text.  A text longer than ``size`` is a run of its own.
    """
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, where, raw = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, end, data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end
    pa.default_memory_pool().release_unused()


def windows(words: Words, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Start words of all runs of ``k`` words within a text, and their hashes."""
    at = np.flatnonzero(words.left >= k)
    return at, between(running(words.hash ^ np.uint64(seed)), at, at + k)


def binaries(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """One binary cell per range of a numeric array."""
    width = values.dtype.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [
        None, pa.py_buffer(np.ascontiguousarray(bounds, np.int64) * width), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())
