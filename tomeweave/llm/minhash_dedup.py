"""Near-duplicates: MinHash banding, verification on full sets, connected components.

1. Each document gives the hashes of its distinct shingles, the minima of many universal hashes
   (multiply-shift) and one key per band of minima.  Documents with one set form a class with one
   representative.
2. Representatives that share a band form a *group*.  No group is expanded to pairs.  Its hub is
   the member that shares most bands with others (a family's original, as a rule), and every
   member is verified against the hub on full sets.  The members compared with one hub form its
   *family*; a member's *difference* is the set of shingles by which it and the hub differ.
3. Two members whose differences share nothing are no closer to each other than each is to the
   hub, so if they are linked, both are linked to the hub.  Only a member that is not linked to
   the hub can have an unseen link.  Those members are compared with the rest of the family in
   blocks of bounded size, one task per pair of blocks, by one product of incidence matrices over
   their differences.  A task gives a spanning forest of its links, never its pairs.
4. Components by alternating large-star and small-star.

A missed link needs two linked documents that share no band: at similarity 0.85 with the default
30 bands of 6 rows about 7 in 10 million, and a component is lost only if no other path joins it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeweave.llm._store import Scratch
from tomeweave.llm._words import SPACES, Words, between, binaries, mixed, pieces, running
from tomeweave.llm.components import components

BANDS, ROWS = 30, 6
BLOCK = 512


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of rows: (first row, distinct shingle hashes row by row, bounds of each row).

    ASCII capitals count as small letters.  Fewer words than ``k`` are one shingle; none gives an
    empty set.
    """
    for low, high, data, offsets in pieces(column):
        words = Words(data, offsets, SPACES, True)
        sums, size = running(words.hash), np.diff(words.bounds)
        starts = np.flatnonzero(words.left >= k)
        short = np.flatnonzero((size > 0) & (size < k))
        text = np.concatenate([np.searchsorted(words.bounds, starts, "right") - 1, short])
        hashes = np.concatenate([between(sums, starts, starts + k),
                                 between(sums, words.bounds[short], words.bounds[short + 1])])
        order = np.lexsort((hashes, text))
        text, hashes = text[order], hashes[order]
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
        text, hashes = text[new], hashes[new]
        yield low, hashes, np.searchsorted(text, np.arange(high - low + 1))


def _universal(n: int) -> np.ndarray:
    return np.random.default_rng(85).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _signatures(hashes: np.ndarray, bounds: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A key per band for each non-empty set (``bounds`` without empty ranges)."""
    keys = np.empty((len(bounds) - 1, bands), np.uint64)
    scratch = np.empty_like(hashes)
    multipliers = _universal(bands * rows)
    for band in range(bands):
        key = np.full(len(bounds) - 1, np.uint64(band + 1))
        for factor in multipliers[band * rows:(band + 1) * rows]:
            np.multiply(hashes, factor, out=scratch)
            key = mixed(key ^ (np.minimum.reduceat(scratch, bounds[:-1]) >> np.uint64(8)))
        keys[:, band] = key
    return keys


SIGNED = "row bigint, id {kind}, n_shingles bigint, set1 bigint, set2 bigint, bands array<bigint>"


def _sign(k: int, bands: int, rows: int):
    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("row").to_numpy()
            for low, hashes, bounds in shingle_sets(batch.column("text"), k):
                size = np.diff(bounds)
                full = np.flatnonzero(size)
                keys = np.zeros((len(size), bands), np.uint64)
                ones, twos = np.zeros(len(size), np.uint64), np.zeros(len(size), np.uint64)
                if len(full):
                    inner = np.append(bounds[full], bounds[-1])
                    keys[full] = _signatures(hashes, inner, bands, rows)
                    ones[full] = np.add.reduceat(hashes, inner[:-1])
                    twos[full] = np.bitwise_xor.reduceat(mixed(hashes * np.uint64(3)), inner[:-1])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * bands), pa.array(keys.ravel().view(np.int64)))
                yield pa.record_batch([pa.array(ids[low:low + len(size)]), batch.column("id").slice(low, len(size)), pa.array(size.astype(np.int64)), pa.array(ones.view(np.int64)),
                                       pa.array(twos.view(np.int64)), lists], ["row", "id", "n_shingles", "set1", "set2", "bands"])
    return body


def _sets(k: int):
    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("node").to_numpy()
            for low, hashes, bounds in shingle_sets(batch.column("text"), k):
                yield pa.record_batch([pa.array(ids[low:low + len(bounds) - 1]), binaries(hashes, bounds)], ["node", "shingles"])
    return body


COMPARED = "hub bigint, node bigint, linked boolean, n bigint, difference binary"


def _compare(percent: int):
    """Exact similarity of each (hub, node) pair, and the node's difference."""
    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked, sizes, differences = [], [], []
            for mine, hubs in zip(batch.column("shingles"), batch.column("hub_shingles")):
                a, b = np.frombuffer(mine.as_buffer(), np.uint64), np.frombuffer(hubs.as_buffer(), np.uint64)
                difference = np.setxor1d(a, b, assume_unique=True)
                union = (len(a) + len(b) + len(difference)) // 2
                linked.append(100 * (union - len(difference)) >= percent * union)
                sizes.append(len(a))
                differences.append(b"" if linked[-1] and not len(difference) else difference.tobytes())
            yield pa.record_batch([batch.column("hub"), batch.column("node"), pa.array(linked, pa.bool_()), pa.array(sizes, pa.int64()),
                                   pa.array(differences, pa.binary())], ["hub", "node", "linked", "n", "difference"])
    return body


def _forest(left: np.ndarray, right: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of a small graph with the least node of its component."""
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, least)
        np.minimum.at(new, right, least)
        new = new[new]
        if (new == label).all():
            moved = np.flatnonzero(label != np.arange(len(nodes)))
            return nodes[moved], nodes[label[moved]]
        label = new


def _resolve(percent: int):
    """Links between the asking and the other members of one pair of blocks."""
    def body(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy(zero_copy_only=False)
        nodes, n = table.column("node").to_numpy(), table.column("n").to_numpy()
        cells = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("difference")]
        size = np.array([len(x) for x in cells])
        values, place, times = np.unique(np.concatenate(cells), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(cells)), size)
        column = np.cumsum(times > 1) - 1
        often = times[place] > 1
        ask, other = np.flatnonzero(asks), np.flatnonzero(~asks)
        position = np.empty(len(cells), np.int64)
        position[ask], position[other] = np.arange(len(ask)), np.arange(len(other))
        shared = np.zeros((len(ask), len(other)))
        # columns in slices, so that the two incidence matrices stay small
        for low in range(0, int((times > 1).sum()), 4096):
            take = often & (column[place] >= low) & (column[place] < low + 4096)
            who, what = owner[take], column[place[take]] - low
            a, b = np.zeros((len(ask), 4096), np.float32), np.zeros((len(other), 4096), np.float32)
            mine = asks[who]
            a[position[who[mine]], what[mine]] = 1
            b[position[who[~mine]], what[~mine]] = 1
            shared += a @ b.T
        apart = size[ask][:, None] + size[other][None, :] - 2 * shared
        union = (n[ask][:, None] + n[other][None, :] + apart) / 2
        i, j = np.nonzero(100 * (union - apart) >= percent * union)
        names, back = np.unique(nodes, return_inverse=True)
        u, v = _forest(back[ask[i]], back[other[j]], names)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})
    return body


def links(signed: DataFrame, rows: DataFrame, scratch: Scratch, k: int, percent: int) -> DataFrame:
    """Verified links ``(u, v)`` between representatives that keep every component whole."""
    banded = signed.where("n_shingles > 0").select("node", F.explode("bands").alias("band"))
    # an aggregate that a join reads is stored first: a join straight over it could not split a hot key
    shared = scratch.table(banded.groupBy("band").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "shared")
    members = scratch.table(banded.join(shared, "band"), "members")
    score = scratch.table(members.groupBy("node").agg(F.sum("m").alias("score")), "score")
    sets = scratch.table(rows.join(score.select("node"), "node", "left_semi").mapInArrow(_sets(k), "node bigint, shingles binary")
                         .dropDuplicates(["node"]), "sets")
    hubs = scratch.table(members.select("band", "node").join(score, "node").groupBy("band")
                         .agg(F.max_by("node", F.struct("score", "node")).alias("hub")), "hubs")
    pairs = members.select("band", "node").join(hubs, "band").where("hub <> node").select("hub", "node").distinct()
    compared = scratch.table(
        pairs.join(sets, "node").join(sets.select(F.col("node").alias("hub"), F.col("shingles").alias("hub_shingles")), "hub")
        .select("hub", "node", "shingles", "hub_shingles").mapInArrow(_compare(percent), COMPARED), "compared")
    direct = compared.where("linked").select(F.col("hub").alias("u"), F.col("node").alias("v"))
    # blocks by a hash of the member; their number follows the family's size, so a block stays small
    family = scratch.table(compared.groupBy("hub").agg(F.count(F.lit(1)).alias("m"), F.count_if(~F.col("linked")).alias("asking"))
                           .where("asking > 0 and m > 1"), "family")
    spread = (compared.join(family, "hub").withColumn("ask_blocks", F.ceil(F.col("asking") / BLOCK).cast("int"))
              .withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")).withColumn("h", F.xxhash64("node")))
    column = ["hub", "node", "n", "difference"]
    others = spread.select(*column, F.lit(False).alias("asks"), F.pmod("h", "blocks").cast("int").alias("b"),
                           F.explode(F.sequence(F.lit(0), F.col("ask_blocks") - 1)).alias("a"))
    asking = spread.where("not linked").select(*column, F.lit(True).alias("asks"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"),
                                               F.pmod("h", "ask_blocks").cast("int").alias("a"))
    unseen = (asking.unionByName(others).groupBy("hub", "a", "b").applyInArrow(_resolve(percent), "u bigint, v bigint"))
    return direct.unionByName(unseen)


def classes_of(docs: DataFrame, scratch: Scratch, k: int, percent: int, bands: int, rows: int, text: str, id_col: str) -> DataFrame:
    """``row, id, n_shingles, component`` of every row; ``row`` is a hash of its id and its text."""
    kind = docs.schema[id_col].dataType.simpleString()
    keyed = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.xxhash64(F.col(id_col), F.col(text)).alias("row"))
    signed = scratch.table(keyed.select("row", "id", "text").mapInArrow(_sign(k, bands, rows), SIGNED.format(kind=kind)), "signed")
    # one class per set; an empty set is a class of its own
    same = scratch.table(signed.where("n_shingles > 0").groupBy("n_shingles", "set1", "set2").agg(
        F.min("row").alias("node"), F.min_by("bands", "row").alias("bands")), "same")
    found = links(same.select("node", "n_shingles", "bands"), keyed.select(F.col("row").alias("node"), "text"), scratch, k, percent)
    parts = components(found, scratch)
    classes = scratch.table(signed.drop("bands").join(same.drop("bands"), ["n_shingles", "set1", "set2"], "left").join(parts, "node", "left")
               .withColumn("component", F.coalesce("component", "node", "row")).select("row", "id", "n_shingles", "component"), "classes")
    return classes


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, text: str = "text",
                    id_col: str = "doc_id", scratch: Scratch | None = None) -> DataFrame:
    """Components of documents whose shingle sets have ``100 * intersection >= percent * union``.

    Returns ``id_col``, ``n_shingles``, ``component_id`` (least id that is reachable) and ``kept``
    (one row of each component: that of its least id).

    * Null texts and texts without words have an empty set and are linked with nothing.
    * Rows with one id and one text are one document: all come back, with equal values.
    * Rows with one id and different texts are separate documents; they share an id.
    * A null id is kept only where its document is linked with nothing or with null ids alone.
    * Other columns of ``docs`` are left out, so their names cannot clash.
    * An empty table gives an empty table.
    """
    scratch = scratch or Scratch(docs.sparkSession, "near-duplicates")
    classes = classes_of(docs, scratch, k, percent, bands, rows, text, id_col)
    least = scratch.table(classes.groupBy("component").agg(F.min("id").alias("component_id")), "least")
    out = classes.join(least, "component")
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def without_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, text: str = "text",
                            id_col: str = "doc_id", scratch: Scratch | None = None) -> DataFrame:
    """One row of each component of ``near_duplicates``, with all its columns: that of the least id.

    Unlike there, rows with one id and one text count as copies: one stays.  Texts without words
    stay, each of their different ids once.
    """
    scratch = scratch or Scratch(docs.sparkSession, "near-duplicates")
    classes = classes_of(docs, scratch, k, percent, bands, rows, text, id_col)
    chosen = classes.groupBy("component").agg(F.min(F.struct("id", "row")).alias("one")).select(F.col("one.row").alias("_chosen")).distinct()
    chosen = scratch.table(chosen, "chosen")
    packed = docs.select(F.struct(*docs.columns).alias("kept"), F.xxhash64(F.col(id_col), F.col(text)).alias("_row"))
    stays = packed.join(chosen, F.col("_row") == F.col("_chosen"), "left_semi")
    # the rows of one key are equal in id and text; copies of a chosen row are rare, the rest is unique
    many = scratch.table(classes.groupBy("row").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("row").alias("_many")), "many")
    single = stays.join(many, F.col("_row") == F.col("_many"), "left_anti").select("kept")
    copies = stays.join(many, F.col("_row") == F.col("_many"), "left_semi").groupBy("_row").agg(F.first("kept").alias("kept")).select("kept")
    return single.unionByName(copies).select("kept.*")
