"""Token counts and ids of whole texts by a public tokenizer.

*Ordinary texts.*  For a tokenizer whose pre-tokenizer drops white space, white space is a border
that no token, merge or normalisation crosses.  Texts are cut there (and between an ASCII letter
and ASCII punctuation, another such border), each different piece is encoded once by the library
and looked up by its hash from then on.

*Huge texts* go by overlap resynchronisation: chunks with an overlap are encoded with offsets as a
black box, anywhere in the text.  Two neighbours are spliced at a *stable* border in the overlap:
both have the same ``STABLE`` tokens, with equal ids and places, on each side of it, and it stands
``GUARD`` characters or more off either chunk's edge.  If there is none, both the overlap and the
guard are widened, up to encoding the two chunks as one.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeweave.llm._words import SPACES, Words, pieces

CHUNK, OVERLAP, STABLE, GUARD = 1 << 16, 1 << 10, 8, 256
HUGE = 1 << 20
CACHED = 1_000_000
#: ASCII punctuation that may be split off the letter before it; no part of a contraction or of a special token.
_SPLIT = np.zeros(256, bool)
_SPLIT[list(b".,!?;:*$%&#()")] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def load(path: str):
    """The library's tokenizer of a ``.json`` file."""
    from tokenizers import Tokenizer
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Tokenizer.from_file(path)


def splits_at_space(tokenizer) -> bool:
    """Whether white space parts a text for this tokenizer: neither kept nor crossed by anything."""
    samples = ["ab cd", "ab  cd", "ab\ncd", " ab \t\r\n cd ", "a' s", "a. ...b", "é ́x", "<| endoftext |>", "1 2\x0b3\x0c4"]
    one = lambda x: tokenizer.encode(x, add_special_tokens=False).ids
    joined = all(one(x) == [i for part in x.split() for i in one(part)] for x in samples)
    cut = all(one(a + b) == one(a) + one(b) for a, b in [("ab", ".cd"), ("ab", ",."), ("ab", "...'s"), ("Ab", "(*)"), ("ab", "#1"), ("ab", ";é")])
    return joined and cut


class PieceEncoder:
    """Ids of many texts at once, each different piece encoded once."""

    def __init__(self, path: str) -> None:
        self.tokenizer = load(path)
        self.exact = splits_at_space(self.tokenizer)
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.bounds = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.slots = np.zeros(0, np.int64)

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        """Add pieces with ascending keys.  They are encoded in lines parted by spaces; offsets tell the pieces apart."""
        ids, owners = [self.ids], []
        for low in range(0, len(texts), 64):
            line = texts[low:low + 64]
            coded = self.tokenizer.encode(" ".join(line), add_special_tokens=False)
            ends = np.cumsum([len(x) + 1 for x in line])
            ids.append(np.array(coded.ids, np.uint32))
            owners.append(low + np.searchsorted(ends, [a for a, _ in coded.offsets], "right"))
        size = np.bincount(np.concatenate(owners).astype(np.int64), minlength=len(texts))
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.slots = np.insert(self.slots, at, len(self.bounds) - 1 + np.arange(len(size)))
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(size)])
        self.ids = np.concatenate(ids)

    def _slots(self, words: Words) -> np.ndarray:
        keys, first, back = np.unique(words.hash, return_index=True, return_inverse=True)
        if len(self.keys) > CACHED:
            self._clear()
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        new = self.keys[at] != keys if len(self.keys) else np.ones(len(keys), bool)
        if new.any():
            raw = words.data.tobytes()
            self._learn(keys[new], [raw[words.start[i]:words.end[i]].decode() for i in first[new]])
            at = np.searchsorted(self.keys, keys)
        return self.slots[at][back]

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        words, slots = self._split(data, offsets)
        sums = np.concatenate([[0], np.cumsum(np.diff(self.bounds)[slots])])
        return sums[words.bounds[1:]] - sums[words.bounds[:-1]]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and each text's bounds."""
        words, slots = self._split(data, offsets)
        size = np.diff(self.bounds)[slots]
        sums = np.concatenate([[0], np.cumsum(size)])
        take = np.repeat(self.bounds[slots] - sums[:-1], size) + np.arange(sums[-1])
        return self.ids[take], sums[words.bounds]

    def _split(self, data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray]:
        cut = np.zeros(len(data), bool)
        cut[1:] = _SPLIT[data[1:]] & _LETTER[data[:-1]]
        words = Words(data, offsets, SPACES, False, cut)
        return words, self._slots(words) if len(words) else np.zeros(0, np.int64)


def _chunk(tokenizer, text: str, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    coded = tokenizer.encode(text[low:high], add_special_tokens=False)
    return np.array(coded.ids, np.int64), np.array(coded.offsets, np.int64).reshape(-1, 2) + low


def _splice(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], low: int, high: int, guard: int, stable: int) -> tuple[int, int] | None:
    """Places in the two token lists of a stable border between characters ``low`` and ``high``."""
    inside = lambda x: np.flatnonzero((x[1][:, 0] >= low + guard) & (x[1][:, 1] <= high - guard))
    mine, other = inside(a), inside(b)
    if len(mine) < 2 * stable or len(other) < 2 * stable:
        return None
    code = lambda x, at: np.concatenate([x[1][at], x[0][at, None]], axis=1)
    left, right = code(a, mine), code(b, other)
    places = {tuple(row): i for i, row in enumerate(right.tolist())}
    match = np.array([places.get(tuple(row), -1) for row in left.tolist()])
    run = 0
    for i in range(len(match)):
        run = run + 1 if match[i] >= 0 and (run == 0 or match[i] == match[i - 1] + 1) else int(match[i] >= 0)
        if run >= 2 * stable:
            k = i - stable + 1
            return int(mine[k]), int(other[match[k]])
    return None


def encode_huge(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP, stable: int = STABLE, guard: int = GUARD) -> np.ndarray:
    """Ids of a text by overlapping chunks; equal to encoding it whole."""
    out: list[np.ndarray] = []
    low, high = 0, min(len(text), chunk)
    current, begin = _chunk(tokenizer, text, low, high), 0
    while high < len(text):
        width, margin, cut = overlap, guard, None
        while cut is None:
            start = max(low, high - width)
            end = min(len(text), high + chunk)
            if start == low:
                # nothing left to widen: the two chunks become one
                high, current = end, _chunk(tokenizer, text, low, end)
                break
            following = _chunk(tokenizer, text, start, end)
            cut = _splice(current, following, start, high, margin, stable)
            if cut is None:
                width, margin = 4 * width, 2 * margin
        else:
            out.append(current[0][begin:cut[0]])
            low, high, current, begin = start, end, following, cut[1]
    out.append(current[0][begin:])
    return np.concatenate(out)


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder per Python worker and tokenizer."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def encoded(path: str, column: pa.Array, huge: int = HUGE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of rows: (first row, ids, bounds of each row)."""
    coder = encoder(path)
    for low, high, data, offsets in pieces(column):
        if (high == low + 1 and len(data) >= huge) or not coder.exact:
            rows = [encode_huge(coder.tokenizer, data[a:b].tobytes().decode()) for a, b in zip(offsets, offsets[1:])]
            yield low, np.concatenate(rows).astype(np.uint32), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        else:
            yield (low, *coder.encode(data, offsets))


def _count(path: str, chunk: int, overlap: int):
    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            sizes, counts = [], []
            for _, _, data, offsets in pieces(batch.column("text")):
                size = np.diff(offsets)
                huge = (size > 2 * chunk) | (not coder.exact)
                count = np.zeros(len(size), np.int64)
                if not huge.all():
                    # huge texts count as empty here
                    keep = np.repeat(~huge, size)
                    count = coder.counts(data[keep] if huge.any() else data, np.concatenate([[0], np.cumsum(np.where(huge, 0, size))]))
                for i in np.flatnonzero(huge):
                    count[i] = len(encode_huge(coder.tokenizer, data[offsets[i]:offsets[i + 1]].tobytes().decode(), chunk, overlap))
                sizes.append(size)
                counts.append(count)
            join = lambda x: pa.array(np.concatenate(x) if x else [], pa.int64())
            yield pa.record_batch([batch.column("id"), join(sizes), join(counts)], ["id", "n_bytes", "n_tokens"])
    return body


def token_counts(docs: DataFrame, path: str, limit: int = 2048, chunk: int = CHUNK, overlap: int = OVERLAP, text: str = "text",
                 id_col: str = "doc_id") -> DataFrame:
    """``id_col``, ``n_bytes``, ``n_tokens`` and ``over_limit`` of every whole text.

    ``path`` is a tokenizer file that every executor can read (a package's file).  Begin, end and
    added special tokens are left out; special strings in a text are handled as the library does.

    * Null and empty texts have 0 bytes and 0 tokens.
    * Texts of more than ``2 * chunk`` bytes go by overlapping chunks.
    * Ids are passed on as they are, null or repeated; each row gives one row.
    * Other columns of ``docs`` are left out, so their names cannot clash.
    * An empty table gives an empty table.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(
        _count(path, chunk, overlap), f"id {kind}, n_bytes bigint, n_tokens bigint")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
