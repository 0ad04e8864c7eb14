"""Language identification with string kernels.

The kernel of two texts is the number of character n-grams (a blended spectrum of lengths) that
both hold, over the geometric mean of how many each holds.  N-grams are hashed to ``BUCKETS``, and
only their presence counts.  Nystroem landmarks turn a text into ``K(x, landmarks) W^-1/2``, and
one ridge regression per language (one versus the rest) is solved on those.  Scoring is a product
of a batch's presence matrix with the landmarks', and of that with one small matrix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tomeweave.llm._sample import remainder
from tomeweave.llm._words import _LOWERED, mixed, pieces

LENGTHS = (1, 2, 3, 4)
BUCKETS = 1 << 14
ROWS = 128
#: Landmarks that each language has at least, however many languages there are.
LEAST_LANDMARKS = 10
_LETTER = regex.compile(r"\p{L}")


def presence(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which n-grams of bytes (ASCII capitals as small letters, white space as one kind) each text holds."""
    n = len(offsets) - 1
    out = np.zeros((n, BUCKETS), np.float32)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    code = _LOWERED[np.where(np.isin(data, (9, 10, 11, 12, 13)), 32, data)]
    ends = np.repeat(offsets[1:], np.diff(offsets))
    gram = np.zeros(len(data), np.uint64)
    for k in range(1, max(LENGTHS) + 1):
        if k > len(data):
            break
        gram = mixed(gram[:len(data) - k + 1] * np.uint64(31) + code[k - 1:])
        if k in LENGTHS:
            at = np.flatnonzero(np.arange(len(gram)) + k <= ends[:len(gram)])
            out[owner[at], gram[at] % np.uint64(BUCKETS)] = 1
    return out / np.sqrt(np.maximum(1, out.sum(1, keepdims=True)))


def _unpacked(bits: np.ndarray) -> np.ndarray:
    rows = np.unpackbits(bits, axis=1).astype(np.float32)
    return rows / np.sqrt(np.maximum(1, rows.sum(1, keepdims=True)))


class Model:
    """Landmarks and the regression's weights, ready for one product per batch."""

    def __init__(self, bits: np.ndarray, langs: list[str], landmarks: int, ridge: float, seed: int = 5) -> None:
        """From packed presence bits, unpacked some rows at a time."""
        self.langs = sorted(set(langs))
        names = np.array(langs)
        draw = np.random.default_rng(seed)
        share = max(LEAST_LANDMARKS, landmarks // len(self.langs))
        # the landmarks are spread evenly over the languages
        chosen = np.concatenate([draw.permutation(np.flatnonzero(names == lang))[:share] for lang in self.langs])
        rows = _unpacked(bits[chosen])
        self.landmarks = np.ascontiguousarray(rows.T)
        value, vector = np.linalg.eigh((rows @ self.landmarks).astype(np.float64))
        good = value > 1e-6 * value.max()
        root = vector[:, good] / np.sqrt(value[good])
        place = np.searchsorted(self.langs, names)
        weight = 1 / np.maximum(1, np.bincount(place, minlength=len(self.langs)))[place] * len(names) / len(self.langs)
        size = root.shape[1] + 1
        square, cross = ridge * np.eye(size), np.zeros((size, len(self.langs)))
        for a in range(0, len(names), 4 * ROWS):
            part = slice(a, a + 4 * ROWS)
            mapped = (_unpacked(bits[part]) @ self.landmarks) @ root
            mapped = np.concatenate([mapped, np.ones((len(mapped), 1))], axis=1)
            weighted = mapped * weight[part, None]
            square += mapped.T @ weighted
            cross += weighted.T @ (place[part, None] == np.arange(len(self.langs)))
        solved = np.linalg.solve(square, cross)
        self.weights, self.bias = (root @ solved[:-1]).astype(np.float32), solved[-1].astype(np.float32)

    def values(self, rows: np.ndarray) -> np.ndarray:
        return (rows @ self.landmarks) @ self.weights + self.bias


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, data, offsets in pieces(batch.column("text")):
            for a in range(0, high - low, ROWS):
                b = min(high - low, a + ROWS)
                rows = presence(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                found = [np.packbits(r > 0).tobytes() for r in rows]
                yield pa.record_batch([batch.column(c).slice(low + a, b - a) for c in ("lang", "draw")] + [pa.array(found, pa.binary())], ["lang", "draw", "grams"])


def _predict(shared):
    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column("text")
            for low, high, data, offsets in pieces(texts):
                for a in range(0, high - low, ROWS):
                    b = min(high - low, a + ROWS)
                    value = model.values(presence(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])).astype(np.float64)
                    best = value.argmax(1)
                    odds = np.exp(8 * np.clip(value, -2, 2))
                    score = odds[np.arange(b - a), best] / odds.sum(1)
                    lang = [model.langs[i] for i in best]
                    for i in range(b - a):
                        if not _LETTER.search(texts[low + a + i].as_py() or ""):
                            lang[i], score[i] = "und", 0.0
                    yield pa.record_batch([batch.column("id").slice(low + a, b - a), pa.array(lang, pa.string()), pa.array(score)], ["id", "lang_pred", "score"])
    return body


def train(docs: DataFrame, landmarks: int = 160, per_language: int = 600, ridge: float = 0.3, text: str = "text",
          id_col: str = "doc_id", label: str = "lang") -> Model | None:
    """A model from the training part (``crc32`` of the id modulo 4 is not 2) with a known language.

    Every language is learnt, from at most ``per_language`` rows each: those whose ids have the
    least hashes.  They are bounded before a shuffle, and only keys are ordered.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.col(label).alias("lang"))
    rows = rows.where(remainder("id", 4) != 2).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.select("lang", "text", F.xxhash64(F.lit(7), "id").alias("draw"))

    def first(part: DataFrame, *order: str) -> DataFrame:
        return part.withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("_n") <= per_language).drop("_n")

    keys = first(rows.select("lang", "draw"), "draw").distinct()
    # rows of one id are bounded as well
    got = first(rows.join(F.broadcast(keys), ["lang", "draw"], "left_semi").mapInArrow(_grams, "lang string, draw bigint, grams binary"), "draw", "grams").toArrow()
    if not got.num_rows:
        return None
    bits = np.array([np.frombuffer(g.as_buffer(), np.uint8) for g in got.column("grams")])
    return Model(bits, got.column("lang").to_pylist(), landmarks, ridge)


def languages(docs: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "lang", **options) -> DataFrame:
    """``id_col``, ``held_out``, ``lang_pred`` and ``score`` (0 to 1) of every whole text.

    * A null text and one without a letter give ``und`` and 0; so does every text if no language
      can be learnt.
    * A null language is not learnt from; ids may be null or repeated.
    * Other columns of ``docs`` are left out, so their names cannot clash.
    * An empty table gives an empty table.
    """
    model = train(docs, text=text, id_col=id_col, label=label, **options)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    if model is None:
        out = rows.select("id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    else:
        shared = docs.sparkSession.sparkContext.broadcast(model)
        out = rows.mapInArrow(_predict(shared), f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double")
    return out.select(F.col("id").alias(id_col), (remainder("id", 4) == 2).alias("held_out"), "lang_pred", "score")
