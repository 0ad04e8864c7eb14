"""Quality classifier by positive-unlabelled learning with the non-negative risk.

Positives are trusted rows; unlabelled rows are any others of the training part, labelled or not.
With class prior ``p``, positives ``P`` and unlabelled ``U`` the risk of a score function is

    p * R(P, +) + max(0, R(U, -) - p * R(P, -))

whose second term is the unbiased risk of the hidden negatives, which may not fall below zero: in a
step where it does, the model follows its reverse gradient instead.  The loss is logistic, so the
score is a probability.  Features are rates of the whole text that do not depend on its language,
and hashed pairs of neighbouring character classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeweave.llm._sample import bounded, remainder
from tomeweave.llm._words import SPACES, Words, pieces, windows

LINES = np.zeros(256, bool)
LINES[10] = True
#: Character classes: space, small and capital letters, digits, other bytes, line end, groups of ASCII marks.
_CLASS = np.zeros(256, np.int64)
_CLASS[33:127], _CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:], _CLASS[10] = 6, 1, 2, 3, 4, 5
for _i, _group in enumerate([b".", b",", b"!", b"?", b"|", b"#*$%&", b"'\"`", b"()[]{}<>", b"-_/\\@:;"]):
    _CLASS[list(_group)] = 7 + _i
CLASSES = int(_CLASS.max()) + 1
RATES = 16
ROWS = 128
WIDTH = 3 * RATES + CLASSES * CLASSES


def _repeats(text: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values per text, and whether each value stands more than once in its text."""
    order = np.lexsort((values, text))
    t, v = text[order], values[order]
    same = np.zeros(len(t), bool)
    same[1:] = (t[1:] == t[:-1]) & (v[1:] == v[:-1])
    twice = same.copy()
    twice[:-1] |= same[1:]
    out = np.zeros(len(t), bool)
    out[order] = twice
    return np.bincount(t[~same], minlength=n), out


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``WIDTH`` numbers per text."""
    n = len(offsets) - 1
    words, lines = Words(data, offsets, SPACES, False), Words(data, offsets, LINES, False)
    folded = Words(data, offsets, SPACES, True)
    size, text = np.diff(words.bounds), words.text
    per = np.maximum(size, 1)
    count = lambda flag, owner: np.bincount(owner[flag], minlength=n)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    kinds = _CLASS[data]
    length = words.end - words.start
    different, _ = _repeats(text, folded.hash, n)
    at, grams = windows(words, 5)
    twice = _repeats(text[at], grams, n)[1]
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + 5, -1)
    stutter = np.zeros(len(words), bool)
    stutter[1:] = (folded.hash[1:] == folded.hash[:-1]) & (text[1:] == text[:-1])
    line_kinds = _repeats(lines.text, lines.hash, n)[0]
    n_lines = np.diff(lines.bounds)
    mark = (kinds >= 6) & ~np.isin(data, list(b".,'"))
    rates = np.stack([
        np.log1p(size) / 8, np.bincount(text, length, n) / per / 12, count(length > 20, text) / per,
        count(mark, owner) / per, count(data == 124, owner) / per, count(data == 33, owner) / per,
        count(np.isin(data, list(b"#*$%&")), owner) / per, count(kinds == 2, owner) / np.maximum(1, np.diff(offsets)) * 4,
        count(kinds == 3, owner) / per, count(stutter, text) / per, 1 - different / per, count(np.cumsum(cover[:-1]) > 0, text) / per,
        1 - line_kinds / np.maximum(1, n_lines), n_lines / per, size < 10, size == 0], axis=1).astype(np.float64)
    rates = np.clip(rates, 0, 2)
    pair = np.bincount(owner[1:] * CLASSES * CLASSES + kinds[:-1] * CLASSES + kinds[1:], minlength=n * CLASSES * CLASSES) if len(data) > 1 else np.zeros(n * CLASSES * CLASSES)
    pair = pair[:n * CLASSES * CLASSES].reshape(n, -1) / np.maximum(1, np.diff(offsets))[:, None]
    return np.concatenate([rates, np.sqrt(rates), np.minimum(1, 8 * rates), np.sqrt(pair)], axis=1).astype(np.float32)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, data, offsets in pieces(batch.column("text")):
            rows = [x.tobytes() for x in features(data, offsets)]
            yield pa.record_batch([batch.column("positive").slice(low, high - low), pa.array(rows, pa.binary())], ["positive", "vector"])


class Model:
    """A logistic model over standardised features."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weight: np.ndarray, bias: float, prior: float) -> None:
        self.mean, self.scale, self.weight, self.bias, self.prior = mean, scale, weight, bias, prior

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weight + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = 120, decay: float = 3e-3, seed: int = 3) -> Model:
    """Minimise the non-negative risk by Adam over shuffled batches."""
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 0.02
    p, u = (np.clip((x - mean) / scale, -8, 8) for x in (positive, unlabelled))
    weight, bias = np.zeros(both.shape[1]), float(np.log(prior / (1 - prior)))
    first, second, step = np.zeros(len(weight) + 1), np.zeros(len(weight) + 1), 0
    draw = np.random.default_rng(seed)
    sigma = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for epoch in range(epochs):
        rate = 0.02 * (1 - epoch / epochs) + 0.0005
        for part in np.array_split(draw.permutation(len(u)), max(1, len(u) // 1024)):
            bp, bu = p[draw.integers(0, len(p), min(len(p), 1024))], u[part]
            zp, zu = bp @ weight + bias, bu @ weight + bias
            hidden = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            # gradients of the losses by z: -s(-z) for a positive, s(z) for a negative
            down = (sigma(zu) / len(zu), -prior * sigma(zp) / len(zp))
            if hidden >= 0:
                gp, gu = -prior * sigma(-zp) / len(zp) + down[1], down[0]
            else:
                gp, gu = -down[1], -down[0]
            slope = np.append(bp.T @ gp + bu.T @ gu + decay * weight, gp.sum() + gu.sum())
            step += 1
            first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope * slope
            move = rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
            weight, bias = weight - move[:-1], bias - move[-1]
    return Model(mean, scale, weight, bias, prior)


def _scores(shared, names: list[str]):
    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for low, high, data, offsets in pieces(batch.column("text")):
                n, scores = high - low, []
                for a in range(0, n, ROWS):
                    b = min(n, a + ROWS)
                    scores.append(model.score(features(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])))
                score = np.concatenate(scores)
                yield pa.record_batch([*[batch.column(x).slice(low, high - low) for x in names], pa.array(score, pa.float64())], [*names, "score"])
    return body


def train(docs: DataFrame, labels: DataFrame, sample: int = 8000, text: str = "text", id_col: str = "doc_id", label: str = "quality") -> Model | None:
    """A model from the training part of the labels (``crc32`` of the id modulo 5 is not 0).

    ``sample`` bounds the positives and the unlabelled rows that reach the driver.  The class prior
    is estimated as the share of positives among all training labels, with one of each added.
    Without any positive label there is no model.
    """
    trusted = labels.where(remainder(id_col, 5) != 0).where(F.col(label).isNotNull())
    marks = trusted.agg(F.count_if(F.col(label) == 1).alias("yes"), F.count(F.lit(1)).alias("all")).first()
    if not marks["yes"]:
        return None
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).where(remainder("id", 5) != 0)
    good = trusted.where(F.col(label) == 1).select(F.col(id_col).alias("id")).distinct()
    vector = "positive boolean, vector binary"
    parts = []
    for mark, part in ((True, rows.join(F.broadcast(bounded(good, ["id"], sample)), "id", "left_semi")), (False, bounded(rows, ["id"], sample, 11))):
        # ids may repeat, so the rows are bounded too
        got = part.withColumn("positive", F.lit(mark)).mapInArrow(_vectors, vector).limit(2 * sample).toArrow()
        parts.append(np.array([np.frombuffer(v.as_buffer(), np.float32) for v in got.column("vector")], np.float64).reshape(-1, WIDTH))
    if not len(parts[0]):
        return None
    return fit(*parts, prior=(marks["yes"] + 1) / (marks["all"] + 2))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = 8000, text: str = "text", id_col: str = "doc_id",
                   label: str = "quality", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, ``held_out``, ``score`` (0 to 1) and ``predicted`` of every whole text.

    * Null and empty texts are scored as texts without words.
    * Without a positive label in the training part every score is 1: nothing is known against a row.
    * Null labels are no labels; rows with null or repeated ids are scored like any other.
    * Columns that ``keep`` names come along in a struct ``kept``, so their names cannot clash.
    * An empty table gives an empty table.
    """
    model = train(docs, labels, sample, text, id_col, label)
    rest = [c for c in keep if c != text]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), *([F.struct(*rest).alias("rest")] if rest else []))
    names = [c for c in rows.columns if c != "text" or text in keep]
    kind = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names)
    if model is None:
        scored = rows.withColumn("score", F.lit(1.0))
    else:
        scored = rows.mapInArrow(_scores(docs.sparkSession.sparkContext.broadcast(model), names), f"{kind}, score double")
    kept = [F.struct(*[(F.col("text") if c == text else F.col("rest")[c]).alias(c) for c in keep]).alias("kept")] if keep else []
    return scored.select(F.col("id").alias(id_col), (remainder("id", 5) == 0).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"), *kept)
