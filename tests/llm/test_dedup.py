"""Substring and near-duplicate operators against brute force."""

from collections import Counter

import cases
import numpy as np
import pytest

from tomeweave.llm import minhash_dedup
from tomeweave.llm._store import Scratch
from tomeweave.llm.components import components
from tomeweave.llm.minhash_dedup import near_duplicates, without_near_duplicates
from tomeweave.llm.substring_dedup import substring_dedup


def cut(rows, k):
    """Brute force of the substring rule: (id, words, removed, text) of each row."""
    split = [cases.words(r[1]) for r in rows]
    count = Counter(tuple(w[i:i + k]) for w in split for i in range(len(w) - k + 1))
    out = []
    for r, w in zip(rows, split):
        hit = [False] * len(w)
        for i in range(len(w) - k + 1):
            if count[tuple(w[i:i + k])] > 1:
                hit[i:i + k] = [True] * k
        out.append((r[0], len(w), sum(hit), " ".join(x for x, h in zip(w, hit) if not h)))
    return Counter(out)


@pytest.mark.parametrize("k, anchor", [(35, 6), (8, 3), (5, 5), (1, 1)])
def test_substrings_equal_brute_force(spark, k, anchor):
    docs, rows = cases.documents(spark)
    got = substring_dedup(docs, k, anchor)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_text", "repeats"]
    found = got.collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in found) == cut(rows, k)
    assert all(sum(x["end"] - x["start"] for x in r["repeats"]) == r["n_removed"] for r in found)


def test_substrings_keep_clashing_columns_apart(spark):
    docs, _ = cases.documents(spark)
    got = substring_dedup(docs, 8, 3, keep=tuple(docs.columns))
    assert got.select("kept.*").exceptAll(docs).isEmpty() and docs.exceptAll(got.select("kept.*")).isEmpty()
    assert substring_dedup(cases.empty(spark)).collect() == []


def sets_of(rows, k):
    out = []
    for r in rows:
        w = cases.words((r[1] or "").translate(cases.LOWER))
        out.append(frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    return out


def groups(rows, k, percent):
    """Brute force of components over rows; equal rows are one document."""
    keys = sorted({(r[0] is not None, r[0] or 0, r[1] or "", r[1] is None) for r in rows})
    docs = [(key[1] if key[0] else None, None if key[3] else key[2]) for key in keys]
    sets, parent = sets_of([(d[0], d[1]) for d in docs], k), list(range(len(docs)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                parent[top(i)] = top(j)
    ids = {}
    for i, d in enumerate(docs):
        if d[0] is not None:
            ids[top(i)] = min(ids.get(top(i), d[0]), d[0])
    return {d: (len(sets[i]), ids.get(top(i))) for i, d in enumerate(docs)}


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, k, percent):
    docs, rows = cases.documents(spark)
    want = Counter((r[0], *groups(rows, k, percent)[r[0], r[1]]) for r in rows)
    got = near_duplicates(docs, k, percent)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    found = got.collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)
    assert near_duplicates(cases.empty(spark)).collect() == []


def test_a_family_without_direct_links_to_its_hub_is_whole(spark, monkeypatch):
    """Chains of edits away from a frequent original: only members that share an edit are linked."""
    import random
    monkeypatch.setattr(minhash_dedup, "BLOCK", 8)  # many pairs of blocks
    rng = random.Random(4)
    base = [f"b{i}" for i in range(150)]
    rows = [cases.row(0, " ".join(base))]
    for chain in range(12):
        words = list(base)
        for step in range(9):
            words[rng.randrange(150)] = f"c{chain}x{step}"
            rows.append(cases.row(len(rows), " ".join(words)))
    rng.shuffle(rows)
    rows = [cases.row(i, r[1]) for i, r in enumerate(rows)]
    want = Counter((r[0], *groups(rows, 3, 85)[r[0], r[1]]) for r in rows)
    got = near_duplicates(spark.createDataFrame(rows, cases.SCHEMA), 3, 85).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want
    assert len({r["component_id"] for r in got}) < len(rows) / 4


def test_one_row_of_each_group_stays(spark):
    docs, rows = cases.documents(spark)
    got = without_near_duplicates(docs, 5, 80)
    assert got.columns == docs.columns
    found = Counter((r["doc_id"], r["text"]) for r in got.collect())
    assert max(found.values()) == 1 and found[4, rows[4][1]] == 1
    kept = {r[0] for r in found if r[0] is not None}
    assert kept == {c for _, c in groups(rows, 5, 80).values() if c is not None}
    assert without_near_duplicates(cases.empty(spark)).collect() == []


def test_components_of_chains_stars_and_loops(spark):
    rng = np.random.default_rng(2)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(7000, 7000)] + [(int(a), int(b)) for a, b in rng.integers(3000, 3060, (50, 2))]
    parent = {n: n for e in edges for n in e if e[0] != e[1]}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        if a != b:
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    got = components(spark.createDataFrame(edges, "u bigint, v bigint"), Scratch(spark, "test"))
    assert {tuple(r) for r in got.collect()} == {(n, top(n)) for n in parent}
    assert components(spark.createDataFrame([], "u bigint, v bigint"), Scratch(spark, "test")).collect() == []
