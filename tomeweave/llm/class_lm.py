"""Scores of a Brown class-based bigram model, with classes found by exchange.

    P(w | v) = P(class(w) | class(v)) * P(w | class(w))

* *Counts* cover every token of the training part; the map side combines them before a shuffle.
* The ``head`` of the vocabulary (a bounded number of the most frequent words) is known to every
  task.  The tokens of all other words, the tail, are looked up by one join with the table of tail words.
* *Seeds.*  The ``class_words`` most frequent words start in arbitrary classes.  A pass over all
  training tokens counts the classes before and after each of them; then every seed in turn moves
  to the class that gives the training text the highest likelihood, until a pass adds little.
* *Every training word* then gets a class, by tiers of frequency: each word of a tier takes the
  class of highest likelihood, from all its occurrences and the classes of the words before it in
  frequency; the seeds are exchanged again behind each tier.  The words of the tail come last, and
  words without a class yet count as the open class.  The number of classes grows with the vocabulary.
* *Smoothing.*  Transitions are smoothed by a constant.  In the open class one slot stands for any
  unknown word, with the chance that words seen once suggest; one more class is the text's border.
  So all probabilities sum to one.  Without seeds all words share the open class, each with its
  count plus one.
* *Moves of data.*  Counts beside head words leave a task added up, as one compressed value per shard
  of words.  Tail tokens meet their words once to find the classes and once to look them up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeweave.llm._sample import remainder
from tomeweave.llm._store import Scratch
from tomeweave.llm._words import SPACES, Words, binaries, pieces

#: Words known to every task, seeds of the classes among them, and the least number of classes of a larger vocabulary.
HEAD_WORDS, CLASS_WORDS, CLASSES = 200_000, 4096, 32
SMOOTH = 0.1
#: Passes go on while they add this share to the classes' information on their neighbours.
LEAST_GAIN = 0.01
#: Counts added to a pair of classes and to what chance would give it, when a word looks for its class.
SHRINK = 5.0
MERGE = 500_000
#: Each tier of words that take a class is this many times as large as all before it.
TIER = 8
#: Cells of a shard of the counts beside words; most cells that a task holds as one array; tokens in a stretch of a huge text.
SHARD, DENSE, STRETCH = 1 << 19, 1 << 22, 1 << 16
CODEC = pa.Codec("zstd", compression_level=1)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words, merged over some hundred thousand before they leave the task."""
    keys, counts = [], []

    def merged() -> pa.RecordBatch:
        key, back = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(back, np.concatenate(counts), len(key)).astype(np.int64)
        return pa.record_batch([pa.array(key.view(np.int64)), pa.array(n)], ["word", "n"])

    for batch in batches:
        for _, _, data, offsets in pieces(batch.column("text")):
            key, n = np.unique(Words(data, offsets, SPACES, True).hash, return_counts=True)
            keys.append(key)
            counts.append(n)
            if sum(map(len, keys)) > MERGE:
                yield merged()
                keys, counts = [], []
    if keys:
        yield merged()


@dataclass
class Head:
    """The most frequent words in order of frequency, with a sorted index for look-up."""

    words: np.ndarray
    counts: np.ndarray

    def __post_init__(self) -> None:
        self.order = np.argsort(self.words)
        self.index = self.words[self.order]

    def encode(self, words: np.ndarray) -> np.ndarray:
        """Rank of each word; the number of head words for any other."""
        if not len(self.index):
            return np.zeros(len(words), np.uint32)
        at = np.minimum(np.searchsorted(self.index, words), len(self.index) - 1)
        return np.where(self.index[at] == words, self.order[at], len(self.index)).astype(np.uint32)


def _encode(shared):
    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = shared.value
        for batch in batches:
            for low, high, data, offsets in pieces(batch.column("text")):
                words = Words(data, offsets, SPACES, True)
                keys = words.hash.view(np.int64)
                ids = head.encode(keys)
                tail = ids == len(head.index)
                ends = np.concatenate([[0], np.cumsum(tail)])[words.bounds].astype(np.int32)
                yield pa.record_batch([
                    batch.column("id").slice(low, high - low), pa.array(np.diff(words.bounds)), binaries(ids, words.bounds),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[tail]))], ["id", "n_words", "ids", "tail"])
    return body


def _tokens(batch: pa.RecordBatch, classes: np.ndarray, border: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For some rows at once: word ids, class before, own class and class after each token, with borders as tokens."""
    cells = batch.column("ids")
    size = np.array([len(c.as_buffer()) // 4 for c in cells], np.int64)
    row = 0
    while row < len(size):
        end = max(row + 1, row + int(np.searchsorted(np.cumsum(size[row:]), 1 << 20)))
        ids = np.frombuffer(b"".join(c.as_buffer() for c in cells[row:end]), np.uint32).astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum(size[row:end])])
        own = np.insert(classes[ids], bounds[1:], border)
        own = np.concatenate([[border], own])
        yield ids, own, bounds, size[row:end]
        row = end


def _blobs(cells: np.ndarray, n: np.ndarray, width: int, first: int = 0) -> Iterator[pa.RecordBatch]:
    """Sorted cells with their counts, one compressed value for each shard of ``width`` cells."""
    cut = np.searchsorted(cells, np.arange(0, int(cells[-1]) // width + 2) * width) if len(cells) else np.zeros(1, np.int64)
    for shard in np.flatnonzero(np.diff(cut)):
        at = slice(cut[shard], cut[shard + 1])
        raw = np.concatenate([np.diff(cells[at] - shard * width, prepend=0), n[at]]).astype(np.uint32)
        packed = CODEC.compress(raw.tobytes(), asbytes=True)
        yield pa.record_batch([pa.array([first + shard], pa.int32()), pa.array([len(raw)], pa.int32()), pa.array([packed])], ["shard", "size", "cells"])


def _unpacked(size: int, packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(CODEC.decompress(packed, size * 4, asbytes=True), np.uint32).astype(np.int64)
    return np.cumsum(raw[:size // 2]), raw[size // 2:]


@dataclass
class Ranks:
    """Some ranks of head words, the classes of all head words (and of tail words, last), and cells in shards of words."""

    classes: np.ndarray
    low: int
    high: int
    kinds: int

    @property
    def shard_words(self) -> int:
        return max(1, SHARD // (2 * self.kinds))

    @property
    def shards(self) -> int:
        return -(-(self.high - self.low) // self.shard_words)

    @property
    def width(self) -> int:
        return self.shard_words * 2 * self.kinds


def _near(shared):
    """How often each class stands before (side 0) and after (1) each word of some ranks; in shard -1 each class after each other.

    A task adds up what it reads, so cells leave it merged; a class of ``kinds`` and its steps are not counted.
    """
    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = shared.value
        kinds, wide = ranks.kinds, ranks.kinds + 1
        total = (ranks.high - ranks.low) * 2 * kinds
        often, pairs = np.zeros(total if total <= DENSE else 0, np.int64), np.zeros(wide * wide, np.int64)
        keys, counts = [], []

        def merged() -> Iterator[pa.RecordBatch]:
            cell, back = np.unique(np.concatenate(keys), return_inverse=True)
            return _blobs(cell, np.bincount(back, np.concatenate(counts), len(cell)).astype(np.int64), ranks.width)

        for batch in batches:
            for ids, own, _, size in _tokens(batch, ranks.classes, kinds - 1):
                pairs += np.bincount(own[:-1] * wide + own[1:], minlength=len(pairs))
                mine = np.flatnonzero((ids >= ranks.low) & (ids < ranks.high))
                place = mine + np.repeat(np.arange(len(size)), size)[mine] + 1
                word = (ids[mine] - ranks.low) * 2
                for side, near in ((0, own[place - 1]), (1, own[place + 1])):
                    cell = (word + side) * kinds + near
                    if len(often):
                        often += np.bincount(cell, minlength=len(often))
                    elif total:
                        key, n = np.unique(cell, return_counts=True)
                        keys.append(key)
                        counts.append(n)
                if sum(map(len, keys)) > MERGE:
                    yield from merged()
                    keys, counts = [], []
        if keys:
            yield from merged()
        cell = np.flatnonzero(often)
        yield from _blobs(cell, often[cell], ranks.width)
        pairs = pairs.reshape(wide, wide)[:kinds, :kinds].ravel()
        cell = np.flatnonzero(pairs)
        yield from _blobs(cell, pairs[cell], len(pairs), -1)
    return body


def _summed(batches: Iterator[pa.RecordBatch], ranks: Ranks) -> dict[int, np.ndarray]:
    """The counts of the shards in some rows, added up."""
    sums = {}
    for batch in batches:
        for shard, size, packed in zip(*(batch.column(c).to_pylist() for c in ("shard", "size", "cells"))):
            if shard not in sums:
                sums[shard] = np.zeros(ranks.kinds ** 2 if shard < 0 else ranks.width, np.int64)
            cell, n = _unpacked(size, packed)
            sums[shard][cell] += n
    return sums


def _added(shared):
    """The shards of one partition, added up."""
    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = shared.value
        for shard, sums in _summed(batches, ranks).items():
            cell = np.flatnonzero(sums)
            yield from _blobs(cell, sums[cell], len(sums), shard)
    return body


def best_classes(before: np.ndarray, after: np.ndarray, ratio: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """The class of highest likelihood for each word, given counts of the classes before and after it; the first of equals.

    ``ratio`` is the logarithm of each pair of classes' count over what chance would give it.
    """
    n_classes = len(allowed)
    value = before @ ratio[:, :n_classes] + after @ ratio[:n_classes].T
    value[:, ~allowed] = -np.inf
    return value.argmax(1)


def _placed(shared):
    """The best class of each word of the shards of one partition."""
    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, ratio, allowed = shared.value
        for shard, sums in _summed(batches, ranks).items():
            near = sums.reshape(-1, 2, ranks.kinds)
            word = np.flatnonzero(near.any((1, 2)))
            best = best_classes(near[word, 0], near[word, 1], ratio, allowed)
            yield pa.record_batch([pa.array((word + ranks.low + shard * ranks.shard_words).astype(np.int32)), pa.array(best.astype(np.int32))], ["rank", "class"])
    return body


def _beside_tail(shared):
    """Tail words with the classes before and after them in one number, merged over a task's rows."""
    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, n_head, kinds = shared.value
        words, nears, held = [], [], 0

        def merged() -> pa.RecordBatch:
            word, near = np.concatenate(words), np.concatenate(nears)
            order = np.lexsort((near, word))
            word, near = word[order], near[order]
            first = np.flatnonzero(np.append(True, (np.diff(word) != 0) | (np.diff(near) != 0))[:len(word)])
            n = np.diff(np.append(first, len(word)))
            return pa.record_batch([pa.array(word[first]), pa.array(near[first].astype(np.int32)), pa.array(n.astype(np.int32))], ["word", "near", "n"])

        for batch in batches:
            row = 0
            for ids, own, _, size in _tokens(batch, classes, kinds - 1):
                mine = np.flatnonzero(ids == n_head)
                place = mine + np.repeat(np.arange(len(size)), size)[mine] + 1
                words.append(batch.column("tail").slice(row, len(size)).flatten().to_numpy())
                nears.append(own[place - 1] * kinds + own[place + 1])
                row += len(size)
                held += len(mine)
                if held > MERGE:
                    yield merged()
                    words, nears, held = [], [], 0
        if held:
            yield merged()
    return body


def _placed_tail(shared):
    """Each tail word with its count and best class."""
    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, ratio, allowed = shared.value
        for whole in batches:
            for row in range(0, whole.num_rows, 4096):
                batch = whole.slice(row, 4096)
                cells = batch.column("cells")
                flat = cells.flatten()
                word = np.repeat(np.arange(len(cells)), np.diff(cells.offsets.to_numpy()))
                near = np.bincount(word * (2 * kinds) + flat.field("cell").to_numpy(), flat.field("n").to_numpy(), len(cells) * 2 * kinds).reshape(-1, 2, kinds)
                yield pa.record_batch([batch.column("word"), pa.array(near[:, 0].sum(1).astype(np.int64)),
                                       pa.array(best_classes(near[:, 0], near[:, 1], ratio, allowed).astype(np.int32))], ["word", "n", "class"])
    return body


TAIL = -1


def _tail_tokens(shared):
    """Every tail token with its place and the classes beside it, ``TAIL`` for a tail neighbour.

    ``at`` holds, from its high bits down, the stretch, the place and whether the text is of the training part.
    Tail words in a row are of one stretch; stretches keep the tokens of a huge text apart.
    """
    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, n_head, kinds = shared.value
        for batch in batches:
            row = 0
            for ids, own, bounds, size in _tokens(batch, classes, kinds - 1):
                mine = np.flatnonzero(ids == n_head)
                text = np.repeat(np.arange(len(size)), size)[mine]
                place = mine + text + 1
                left, right = (np.where(near == kinds, TAIL, near) for near in (own[place - 1], own[place + 1]))
                start = np.maximum.accumulate(np.where(left == TAIL, 0, mine)) if len(mine) else mine
                uid, trained = (batch.column(c).slice(row, len(size)).to_numpy(zero_copy_only=False)[text] for c in ("uid", "trained"))
                at = ((start - bounds[text]) // STRETCH << 33) | ((mine - bounds[text]) << 1) | trained.astype(np.int64)
                yield pa.record_batch([pa.array(uid), batch.column("tail").slice(row, len(size)).flatten(), pa.array(at),
                                       pa.array(((left + 1) * (kinds + 1) + right + 1).astype(np.int32))], ["uid", "word", "at", "near"])
                row += len(size)
    return body


def _resolve(shared):
    """Steps into the tail words of a stretch and from the last of each run of them, as numbers of pairs of classes, and what their counts add."""
    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, opened, more = shared.value
        for batch in batches:
            cells = batch.column("cells")
            flat = cells.flatten()
            row = np.repeat(np.arange(len(cells)), np.diff(cells.offsets.to_numpy()))
            at, near = flat.field("at").to_numpy(), flat.field("near").to_numpy().astype(np.int64)
            order = np.lexsort((at, row))
            at, near = at[order], near[order]
            own = flat.field("class").fill_null(opened).to_numpy()[order].astype(np.int64)
            n = flat.field("n").fill_null(0).to_numpy()[order]
            left, right = near // (kinds + 1) - 1, near % (kinds + 1) - 1
            into = np.where(left == TAIL, np.append(0, own[:-1]), left) * kinds + own
            last = right != TAIL
            bounds = np.searchsorted(row, np.arange(len(cells) + 1))
            lasts = np.concatenate([[0], np.cumsum(last)])[bounds]
            yield pa.record_batch([batch.column("uid"), pa.array((at[bounds[:-1]] & 1).astype(bool)), binaries(into.astype(np.uint32), bounds),
                                   binaries((own * kinds + right)[last].astype(np.uint32), lasts), pa.array(_sums(np.log10(np.maximum(1, n + more)), bounds)),
                                   pa.array(_sums(np.log10(n + 1), bounds)), pa.array(_sums((n > 0).astype(np.int64), bounds))], RESOLVED)
    return body


RESOLVED = ["uid", "trained", "into", "out", "tail_emit", "tail_base", "tail_known"]


def _codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in binary cells, one after another, and where each cell begins."""
    bounds = np.concatenate([[0], np.cumsum([len(c.as_buffer()) // 4 for c in column])]).astype(np.int64)
    return np.frombuffer(b"".join(c.as_buffer() for c in column), np.uint32).astype(np.int64), bounds


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ranges, each added pairwise; a running sum would lose digits over many equal values."""
    return np.array([values[a:b].sum() for a, b in zip(bounds, bounds[1:])], values.dtype)


def _tail_pairs(shared):
    """The steps to and from tail words, counted."""
    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = shared.value
        pairs = np.zeros(ranks.kinds ** 2, np.int64)
        for batch in batches:
            for name in ("into", "out"):
                pairs += np.bincount(_codes(batch.column(name))[0], minlength=len(pairs))
        cell = np.flatnonzero(pairs)
        yield from _blobs(cell, pairs[cell], len(pairs), -1)
    return body


def _tail_scores(shared):
    """What the tail words of a stretch add to a text's scores."""
    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps, slots = shared.value
        flat, kinds = steps.ravel(), len(slots)
        for batch in batches:
            (into, mine), (out, theirs) = _codes(batch.column("into")), _codes(batch.column("out"))
            score = _sums(flat[into] - slots[into % kinds], mine) + _sums(flat[out], theirs) + batch.column("tail_emit").to_numpy()
            yield pa.record_batch([batch.column("uid"), pa.array(score), batch.column("tail_base"), batch.column("tail_known")],
                                  ["uid", "tail_score", "tail_base", "tail_known"])
    return body


def information(pairs: np.ndarray) -> float:
    """What the class of a token tells about the next one's, in nats over all tokens."""
    expected = pairs.sum(1, keepdims=True) * pairs.sum(0, keepdims=True) / max(1, pairs.sum())
    seen = pairs > 0
    return float((pairs[seen] * np.log(pairs[seen] / expected[seen])).sum())


BLOB = "shard int, size int, cells binary"


def _counted(blobs: DataFrame, ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """Counts of classes beside each word of some ranks, as (word, side, class), and of pairs of classes."""
    send = blobs.sparkSession.sparkContext.broadcast
    got = blobs.repartition(ranks.shards + 1, "shard").mapInArrow(_added(send(ranks)), BLOB).toArrow()
    sums = _summed(got.to_batches(), ranks)
    near = np.concatenate([np.zeros(0, np.int64), *(sums.get(k, np.zeros(ranks.width, np.int64)) for k in range(ranks.shards))])
    pairs = sums.get(-1, np.zeros(ranks.kinds ** 2, np.int64)).reshape(ranks.kinds, -1)
    return near[:(ranks.high - ranks.low) * 2 * ranks.kinds].reshape(-1, 2, ranks.kinds), pairs


def _head_classes(training: DataFrame, n_head: int, n_seeds: int, n_classes: int, passes: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the head words (tail words, last, in the open class), and the counts of pairs of classes.

    Seeds are exchanged until that adds little.  Then the words of the next tier, ``TIER`` times as many, each
    take their best class beside all that stand already, and the seeds are exchanged again.
    """
    send, kinds = training.sparkSession.sparkContext.broadcast, n_classes + 2
    classes = np.full(n_head + 1, n_classes)
    classes[:n_seeds] = np.arange(n_seeds) % n_classes
    done = n_seeds
    while True:
        told = 0.0
        for turn in count():
            ranks = Ranks(classes.copy(), 0, n_seeds, kinds)
            near, pairs = _counted(training.mapInArrow(_near(send(ranks)), BLOB), ranks)
            now = information(pairs)
            if turn == passes or turn and now <= told * (1 + LEAST_GAIN):
                break
            told = now
            classes[:n_seeds] = exchange(classes[:n_seeds], near[:, 0], near[:, 1], n_classes)
        if done == n_head:
            return classes, pairs
        ranks = Ranks(classes.copy(), done, min(n_head, done * TIER), kinds)
        found = (training.mapInArrow(_near(send(ranks)), BLOB).where("shard >= 0").repartition(ranks.shards, "shard")
                 .mapInArrow(_placed(send((ranks, *_ratio(pairs, n_classes)))), "rank int, class int").toArrow())
        classes[found.column("rank").to_numpy()] = found.column("class").to_numpy()
        done = ranks.high


def _ratio(pairs: np.ndarray, n_classes: int) -> tuple[np.ndarray, np.ndarray]:
    """For ``best_classes``: each pair's logarithm over chance, and the classes that have words."""
    expected = pairs.sum(1, keepdims=True) * pairs.sum(0, keepdims=True) / max(1, pairs.sum())
    return np.log((pairs + SHRINK) / (expected + SHRINK)), pairs[:n_classes].sum(1) > 0


def _tail_classes(training: DataFrame, classes: np.ndarray, pairs: np.ndarray, n_classes: int) -> DataFrame:
    """Each tail word of the training part with its count and its best class beside the head words."""
    send, kinds = training.sparkSession.sparkContext.broadcast, n_classes + 2
    beside = training.where("size(tail) > 0").mapInArrow(_beside_tail(send((classes, len(classes) - 1, kinds))), "word bigint, near int, n int")
    cells = (beside.repartition("word")
             .select("word", "n", F.explode(F.array((F.col("near") / kinds).cast("int"), F.col("near") % kinds + kinds)).alias("cell"))
             .groupBy("word", "cell").agg(F.sum("n").alias("n"))
             .groupBy("word").agg(F.collect_list(F.struct("cell", "n")).alias("cells")))
    return cells.mapInArrow(_placed_tail(send((kinds, *_ratio(pairs, n_classes)))), WORD)


WORD = "word bigint, n bigint, class int"


def exchange(classes: np.ndarray, before: np.ndarray, after: np.ndarray, n_classes: int) -> np.ndarray:
    """One sweep: each word moves to the class with the best likelihood, given the classes around it."""
    def gain(x):
        return x * np.log(np.maximum(x, 1))

    classes = classes.copy()
    into, out = np.zeros((n_classes, before.shape[1])), np.zeros((n_classes, after.shape[1]))
    np.add.at(into, classes, before)
    np.add.at(out, classes, after)
    members = np.bincount(classes, minlength=n_classes)
    for word in range(len(classes)):
        old, b, a = classes[word], before[word], after[word]
        n = b.sum()
        if n == 0 or members[old] == 1:
            continue
        into[old] -= b
        out[old] -= a
        total = into.sum(1)
        value = ((gain(into + b) - gain(into)).sum(1) + (gain(out + a) - gain(out)).sum(1) - 2 * (gain(total + n) - gain(total)))
        new = int(value.argmax())
        into[new] += b
        out[new] += a
        members[old] -= 1
        members[new] += 1
        classes[word] = new
    return classes


@dataclass
class Model:
    """Classes of head words, and base-10 logarithms of transitions and emissions."""

    classes: np.ndarray
    steps: np.ndarray
    emits: np.ndarray
    base: np.ndarray
    border: int


def transitions(pairs: np.ndarray, once: int | None) -> np.ndarray:
    """Base-10 logarithms of the steps between classes; the last two are the open class and the border.

    ``once`` is the number of training words seen once: their share of all steps is the chance of an unknown
    word, after any class, and after an unknown word classes follow as after all.  Without it the open
    class is smoothed as any other.
    """
    if once is None:
        return np.log10((pairs + SMOOTH) / (pairs + SMOOTH).sum(1, keepdims=True))
    opened, made = len(pairs) - 2, pairs + SMOOTH
    made[opened] = made.sum(0)
    made[:, opened] = 0
    new = (once + SMOOTH) / (pairs.sum() + 2 * SMOOTH)
    made *= (1 - new) / made.sum(1, keepdims=True)
    made[:, opened] = new
    return np.log10(made)


def _scores(shared):
    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            scores, bases, known = [], [], []
            for ids, own, bounds, size in _tokens(batch, model.classes, model.border):
                cut = bounds + np.arange(len(bounds))
                step = np.concatenate([[0], np.cumsum(model.steps[own[:-1], own[1:]])])
                emit, base = np.concatenate([[0], np.cumsum(model.emits[ids])]), np.concatenate([[0], np.cumsum(model.base[ids])])
                head = np.concatenate([[0], np.cumsum(ids < len(model.base) - 1)])
                scores.append(np.diff(step[cut]) + np.diff(emit[bounds]))
                bases.append(np.diff(base[bounds]))
                known.append(np.diff(head[bounds]))
            join = lambda x, kind: pa.array(np.concatenate(x) if x else [], kind)
            yield pa.record_batch([batch.column(c) for c in ("uid", "id", "n_words")]
                                  + [join(scores, pa.float64()), join(bases, pa.float64()), join(known, pa.int64())],
                                  ["uid", "id", "n_words", "head_score", "head_base", "head_known"])
    return body


def head_of(counts: DataFrame, limit: int) -> Head:
    """The words with at least the least count that at most ``limit`` words reach.

    The bound is read off counts of counts in classes of an eighth of an octave, so no sort over
    the vocabulary and no more than ``limit`` rows come to the driver.
    """
    band = F.floor(F.log2("n") * 8)
    sizes = sorted(((r["band"], r["words"]) for r in counts.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("words")).collect()), reverse=True)
    least, total = None, 0
    for value, words in sizes:
        total += words
        if total > limit:
            break
        least = value
    if least is None:
        return Head(np.zeros(0, np.int64), np.zeros(0, np.int64))
    got = counts.where(band >= least).toArrow()
    words, n = got.column("word").to_numpy(), got.column("n").to_numpy()
    order = np.lexsort((words, -n))
    return Head(words[order], n[order])


def class_scores(docs: DataFrame, head_words: int = HEAD_WORDS, class_words: int = CLASS_WORDS, n_classes: int | None = None, passes: int | None = None,
                 text: str = "text", id_col: str = "doc_id", scratch: Scratch | None = None) -> DataFrame:
    """Log-probability (base 10) of every whole text under a class bigram model and an add-one unigram.

    Trained on the texts whose ``crc32`` of the id modulo 7 is not 2.  ASCII capitals count as
    small letters; each text ends with one end token.  Returns ``id_col``, ``held_out``,
    ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` and ``perplexity``.

    The classes start from the ``class_words`` most frequent words, and every training word gets
    one.  Without ``n_classes`` their number is the vocabulary's size to the power 0.3, and at
    least ``CLASSES``; without ``passes`` seeds are exchanged until another pass adds little.

    * Null and empty texts are the end token alone.
    * Without training texts nothing is known: the base score is 0, classes and counts are empty.
    * Each row is scored, also one that stands twice or has a null id.
    * Other columns of ``docs`` are left out, so their names cannot clash.
    * An empty table gives an empty table.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    scratch = scratch or Scratch(spark, "class-lm")
    send = spark.sparkContext.broadcast
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    trained = remainder("id", 7) != 2
    counts = scratch.table(rows.where(trained).select("text").mapInArrow(_count_words, "word bigint, n bigint")
                           .groupBy("word").agg(F.sum("n").alias("n")), "counts")
    sums = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(name) for c, name in (("n", "tokens"), (F.lit(1), "words"), ((F.col("n") == 1).cast("int"), "once"))]).first()
    head = head_of(counts, head_words)
    n_head, n_seeds = len(head.words), min(class_words, len(head.words))
    n_classes = max(1, min(n_classes or max(CLASSES, round(sums["words"] ** 0.3)), n_seeds))
    kinds, opened, border = n_classes + 2, n_classes, n_classes + 1
    encoded = (rows.mapInArrow(_encode(send(head)), f"id {kind}, n_words bigint, ids binary, tail array<bigint>")
               .withColumn("uid", F.monotonically_increasing_id()))
    encoded = scratch.table(encoded, "encoded")
    training = encoded.where(trained).select("ids", "tail")

    classes, table = np.full(n_head + 1, opened), counts.withColumn("class", F.lit(opened))
    if n_seeds:
        classes, pairs = _head_classes(training.select("ids"), n_head, n_seeds, n_classes, passes)
        table = scratch.table(_tail_classes(training, classes, pairs, n_classes), "tail")
    more = 0 if n_seeds else 1
    # a tail word's class is past the kinds here: its steps and emission come from its stretch
    classes[-1] = kinds
    tokens = (encoded.where("size(tail) > 0").select("uid", trained.alias("trained"), "ids", "tail")
              .mapInArrow(_tail_tokens(send((classes, n_head, kinds))), "uid bigint, word bigint, at bigint, near int"))
    resolved = scratch.table(
        tokens.join(table, "word", "left").groupBy("uid", F.shiftright("at", 33).alias("stretch")).agg(F.collect_list(F.struct("at", "near", "class", "n")).alias("cells"))
        .mapInArrow(_resolve(send((kinds, opened, more))), "uid bigint, trained boolean, into binary, out binary, tail_emit double, tail_base double, tail_known bigint"),
        "resolved")
    ranks = Ranks(classes, 0, 0, kinds)
    _, pairs = _counted(training.mapInArrow(_near(send(ranks)), BLOB).unionByName(resolved.where("trained").mapInArrow(_tail_pairs(send(ranks)), BLOB)), ranks)

    texts = int(pairs[:, border].sum())
    n_tokens, vocabulary = int(sums["tokens"]) + texts, int(sums["words"]) + (1 if texts else 0)
    logs = transitions(pairs, int(sums["once"]) if n_seeds else None)
    in_class = pairs.sum(0)
    in_class[opened] = 1 if n_seeds else int(sums["tokens"]) + int(sums["words"]) + 1
    slots = np.log10(np.maximum(1, in_class))
    steps = np.zeros((kinds + 1, kinds + 1))
    steps[:kinds, :kinds] = logs
    counted = np.append(head.counts, 0).astype(np.float64)
    emits = np.append(np.log10(np.maximum(1, head.counts + more)) - slots[classes[:-1]], 0.0)
    model = Model(classes, steps, emits, np.log10(counted + 1), border)

    partial = encoded.select("uid", "id", "n_words", "ids").mapInArrow(
        _scores(send(model)), f"uid bigint, id {kind}, n_words bigint, head_score double, head_base double, head_known bigint")
    looked = (resolved.mapInArrow(_tail_scores(send((logs, slots))), "uid bigint, tail_score double, tail_base double, tail_known bigint")
              .groupBy("uid").agg(*[F.sum(c).alias(c) for c in ("tail_score", "tail_base", "tail_known")]))
    end_base = float(np.log10(texts + 1))
    none = F.lit(0.0)
    return (partial.join(looked, "uid", "left").select(
        F.col("id").alias(id_col), (~trained).alias("held_out"), (F.col("n_words") + 1).alias("n_tokens"),
        (F.col("head_known") + F.coalesce("tail_known", F.lit(0)) + F.lit(1 if texts else 0)).alias("n_known"),
        F.lit(n_tokens).cast("bigint").alias("train_tokens"),
        (F.col("head_base") + F.coalesce("tail_base", none) + F.lit(end_base)
         - (F.col("n_words") + 1) * F.lit(float(np.log10(n_tokens + vocabulary + 1)))).alias("base_score"),
        (F.col("head_score") + F.coalesce("tail_score", none)).alias("score"))
        .withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))))
