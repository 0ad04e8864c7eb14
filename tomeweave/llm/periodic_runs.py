"""Runs of one repeated pattern of words in whole texts, by string synchronising sets.

A run is a stretch with smallest period ``q``, at least ``powers`` periods long, that no
neighbouring word extends.  Texts are read as arrays of word names, many at once, with a separator
of its own behind each, so nothing matches across texts.

*Scales.*  At scale ``t`` = 4, 8, 16, ... every window of ``t`` words has a name (names of two
halves, mixed), which also is its random rank.  Position ``i`` is *synchronising* if the least rank
among the windows that start in ``i .. i+t`` stands at either end.  That depends on the ``2t`` words
from ``i`` on alone, so equal contexts have equal marks.

*Proposals.*  Two synchronising positions with equal contexts of ``2t`` words, ``q`` apart with
``1.5t <= q < 3t``, propose period ``q``.  In a run of at least ``3q`` words the last start that has
both contexts inside lies ``2q - 2t >= t - 1`` behind the first, and the run holds no smaller period
over that stretch, so the set has a position there: every such run is proposed.

*Highly periodic regions.*  Windows with a period of at most ``t/3`` would all be synchronising;
they have no rank.  They are the runs that smaller scales found.  Periods below the first scale's
are found by comparing the text with itself, shifted.

A proposal is a stretch on which the text equals itself ``q`` words on.  Stretches of one ``q``
that touch are merged, and both ends move until a word differs.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeweave.llm._words import SPACES, Words, mixed, pieces

FIRST_SCALE = 4
PAIRS, CELLS = 1 << 20, 1 << 22
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_SEPARATORS = np.uint64(0x5851F42D4C957F2D)
_HALF = np.uint64(0x2545F4914F6CDD1D)

Runs = tuple[np.ndarray, np.ndarray, np.ndarray]


def _small_periods(names: np.ndarray, upto: int) -> Iterator[Runs]:
    """Stretches of periods below the first scale's, by comparison with the shifted text."""
    for q in range(1, upto):
        if len(names) <= q:
            return
        same = np.zeros(len(names) - q + 2, np.int8)
        same[1:-1] = names[q:] == names[:-q]
        step = np.diff(same)
        start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        long = end - start >= 2 * q
        yield start[long], end[long] + q, np.full(long.sum(), q, np.int64)


def _least(ranks: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` ranks in a row: running minima of blocks from both sides."""
    n = len(ranks)
    padded = np.full(-(-n // width) * width, _NONE)
    padded[:n] = ranks
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n - width + 1], ahead[width - 1:n])


def synchronising(names: np.ndarray, scale: int, runs: Runs) -> np.ndarray:
    """Synchronising positions, given the names of windows of ``scale`` words and the runs found so far."""
    start, end, period = runs
    ranks = names.copy()
    flat = (3 * period <= scale) & (end - start >= scale)
    if flat.any():
        edge = np.zeros(len(ranks) + 1, np.int64)
        np.add.at(edge, start[flat], 1)
        np.add.at(edge, end[flat] - scale + 1, -1)
        ranks[np.cumsum(edge[:-1]) > 0] = _NONE
    least = _least(ranks, scale + 1)
    n = len(least)
    return np.flatnonzero((least != _NONE) & ((ranks[:n] == least) | (ranks[scale:scale + n] == least)))


def _proposals(at: np.ndarray, contexts: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions with equal contexts at a distance of this scale: (position, distance)."""
    at = at[at < len(contexts)]
    low, high = np.searchsorted(at, at + scale + scale // 2), np.searchsorted(at, at + 3 * scale)
    found = []
    many = np.cumsum(high - low)
    first = 0
    while first < len(at):
        last = max(first + 1, int(np.searchsorted(many, (many[first - 1] if first else 0) + PAIRS, "right")))
        size = (high - low)[first:last]
        mine = np.repeat(np.arange(first, last), size)
        other = np.arange(len(mine)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low[first:last], size)
        same = contexts[at[mine]] == contexts[at[other]]
        found.append(np.stack([at[mine[same]], at[other[same]] - at[mine[same]]]))
        first = last
    both = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    return both[0], both[1]


def _merged(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of one period that touch become one."""
    order = np.lexsort((low, q))
    q, low, high = q[order], low[order], high[order]
    # ends grow within a period: shift each period's numbers past those of the one before
    span = int(high.max()) + 2
    group = np.cumsum(np.concatenate([[False], q[1:] != q[:-1]])) * span
    reach = np.maximum.accumulate(high + group)
    fresh = np.concatenate([[True], (low + group)[1:] > reach[:-1]])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(q)) - 1
    return q[first], low[first], reach[last] - group[last]


def _moved(names: np.ndarray, q: np.ndarray, edge: np.ndarray, step: int, width: int) -> np.ndarray:
    """How many of the next ``width`` words off each edge equal the word ``q`` on, before the first that does not."""
    out = np.zeros(len(q), np.int64)
    rows = max(1, CELLS // width)
    reach = np.arange(width) * step
    for i in range(0, len(q), rows):
        x = edge[i:i + rows, None] + reach
        y = x + q[i:i + rows, None]
        inside = (x >= 0) & (y < len(names))
        same = inside & (names[np.where(inside, x, 0)] == names[np.where(inside, y, 0)])
        out[i:i + rows] = np.where(same.all(axis=1), width, same.argmin(axis=1))
    return out


def _settled(names: np.ndarray, at: np.ndarray, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Proposed stretches, grown to both ends: (period, first, end) of where the text equals itself ``q`` on."""
    q, low, high = _merged(q, at, at + width)
    while True:
        left, right = _moved(names, q, low - 1, -1, width), _moved(names, q, high, 1, width)
        open_ = (left == width) | (right == width)
        q, low, high = _merged(q, low - left, high + right)
        if not open_.any():
            return q, low, high


def find_runs(names: np.ndarray, longest: int, min_words: int = 24, powers: int = 3) -> Runs:
    """Starts, ends and smallest periods of all runs; ``longest`` bounds the words of one text.

    ``names`` ends with a name that stands nowhere else, and so does each text in it.
    """
    if powers < 3:
        raise ValueError("the scales propose every run only from three periods on")
    found = list(_small_periods(names, FIRST_SCALE + FIRST_SCALE // 2))
    windows, scale = names, 1
    while 3 * (scale + scale // 2) <= longest:
        doubled = mixed(windows[:-scale] * _HALF + mixed(windows[scale:].copy()))
        if scale >= FIRST_SCALE:
            runs = tuple(np.concatenate(x) for x in zip(*found))
            at, q = _proposals(synchronising(windows, scale, runs), doubled, scale)
            if len(at):
                q, low, high = _settled(names, at, q, 2 * scale)
                long = high - low >= 2 * q
                found.append((low[long], (high + q)[long], q[long]))
        windows, scale = doubled, 2 * scale
    start, end, period = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found) if found else ((),) * 3))
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    least = np.concatenate([[True], (start[1:] != start[:-1]) | (end[1:] != end[:-1])])[:len(start)]
    kept = least & (end - start >= np.maximum(min_words, powers * period))
    return start[kept], end[kept], period[kept]


def respelled(doc_id: object, n: int) -> np.ndarray | None:
    """The planted change of the query's contract: which original word stands at each place; null for none."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 0
    if h % 10 or not n or doc_id is None:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def _best(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest exact exponent; ties go to the smallest start, then period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def _scan(min_words: int, powers: int, rule: Callable[[object, int], np.ndarray | None] | None, spans: bool):
    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_pylist()
            out: list[tuple] = []
            for first, end, data, offsets in pieces(batch.column("text")):
                words, raw = Words(data, offsets, SPACES, False), data.tobytes()
                orders = [rule(ids[first + k], int(n)) if rule else None for k, n in enumerate(np.diff(words.bounds))]
                parts = []
                for k, order in enumerate(orders):
                    mine = words.hash[words.bounds[k]:words.bounds[k + 1]]
                    parts += [mine if order is None else mine[order], mixed(np.array([k], np.uint64) ^ _SEPARATORS)]
                bounds = np.concatenate([[0], np.cumsum(np.diff(words.bounds) + 1)])
                starts, ends, periods = find_runs(np.concatenate(parts), int(np.diff(words.bounds).max(initial=0)), min_words, powers)
                order = np.lexsort((periods, starts))
                starts, ends, periods = starts[order], ends[order], periods[order]
                cut = np.searchsorted(starts, bounds)
                for k in range(end - first):
                    place = slice(cut[k], cut[k + 1])
                    runs = list(zip((starts[place] - bounds[k]).tolist(), (ends[place] - starts[place]).tolist(), periods[place].tolist()))
                    tokens = raw[offsets[k]:offsets[k + 1]].split()
                    if orders[k] is not None:
                        tokens = [tokens[i] for i in orders[k].tolist()]
                    if runs:
                        gone = np.zeros(len(tokens) + 1, np.int64)
                        for s, length, q in runs:
                            gone[s + q] += 1
                            gone[s + length] -= 1
                        tokens = [w for w, out_ in zip(tokens, np.cumsum(gone).tolist()) if not out_]
                    best = _best(runs)
                    collapsed = b" ".join(tokens)
                    row = (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
                           hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
                           hashlib.sha256(collapsed).hexdigest())
                    out.append((*row, collapsed.decode(), [dict(zip(("start", "length", "period"), r)) for r in runs]) if spans else row)
            columns = list(zip(*out)) or [()] * (len(_DIGESTS) + 2 * spans)
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.string(), _RUNS]
            yield pa.record_batch([batch.column("id"), *[pa.array(list(c), kinds[i]) for i, c in enumerate(columns)]],
                                  ["id", *_DIGESTS, *(["collapsed", "runs"] if spans else [])])
    return body


_DIGESTS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(docs: DataFrame, min_words: int = 24, powers: int = 3, rule: Callable[[object, int], np.ndarray | None] | None = None,
                  spans: bool = True, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Runs of every whole text, and the text with each run cut to its first period.

    Returns per row ``id_col``, ``n_runs``, the run with the greatest exponent (``start``, ``length``,
    ``period``, ``exponent_milli``; ties: smallest start, then period), ``runs_sha256`` and
    ``collapsed_sha256``; with ``spans`` also ``collapsed`` and the list ``runs``.  ``rule`` may give
    another order of a text's words, as planted tests do.

    * Null and empty texts, and texts without a run, have 0 runs and null for the best one.
    * A text is searched in one task; its work is near linear in its words, at any length, since
      highly periodic stretches are left out of the sets.  Nothing is shuffled.
    * Ids are passed on as they are, null or repeated; each row gives one row.  ``rule`` sees them.
    * Other columns of ``docs`` are left out, so their names cannot clash.
    * An empty table gives an empty table.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    more = ", collapsed string, runs array<struct<start: bigint, length: bigint, period: bigint>>" if spans else ""
    found = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(
        _scan(min_words, powers, rule, spans), f"id {kind}, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
        f"runs_sha256 string, collapsed_sha256 string{more}")
    return found.withColumnRenamed("id", id_col)
