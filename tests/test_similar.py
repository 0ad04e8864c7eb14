"""The title similarity join against the scored cross product."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tomeweave.operators import matching, similar

WORDS = ["the", "art", "of", "war", "dune", "messiah", "s", "it", "ends", "with", "us", "smart", "phone", "vol", "1", "2", "educated", "memoir", "ünder", "ab"]
AUTHORS = [None, [], ["Ann Lee"], ["Frank Herbert", "B. Li"], ["F. Herbert"], ["Herberts"], ["U K"], ["Leeson"]]


def side(spark, rng, key, n):
    rows = []
    for i in range(n):
        title = " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 5))) + (": " + rng.choice(WORDS) if rng.random() < 0.3 else "")
        at = rng.randrange(len(title))
        if rng.random() < 0.4:
            title = title[:at] + rng.choice(["", "x", title[at] * 2]) + title[at + 1:]
        rows.append((i, title, rng.choice(AUTHORS)))
    rows += [(900, "", ["x"]), (901, None, None), (902, f": {key[0]}", None), (903, "Dune", None), (904, "Dune", None)]
    return spark.createDataFrame(rows, f"{key} int, title string, authors array<string>")


def test_nothing_above_the_floor_is_lost(spark):
    rng = random.Random(3)
    wanted, catalogue = side(spark, rng, "wanted_id", 90), side(spark, rng, "candidate_id", 90)
    cross = wanted.select("wanted_id", F.col("title").alias("wanted_title"), F.col("authors").alias("wanted_authors")).crossJoin(catalogue)
    for floor, require, block in ((0.85, True, 20_000), (0.8, False, 3), (0.72, False, 40)):
        columns = ["wanted_id", "candidate_id", "score"]
        want = sorted(map(tuple, matching.accepted(cross, floor, require).select(columns).collect()))
        got = similar.similar(wanted, catalogue, floor, require, block).select(columns).collect()
        assert sorted(map(tuple, got)) == want and len(want) > 100
        assert similar.candidate_pairs(wanted, catalogue, floor, require, block).count() < 0.7 * 95 * 95
    assert similar.similar(wanted.limit(0), catalogue).collect() == []
    with pytest.raises(ValueError):
        similar.candidate_pairs(wanted, catalogue, 0.6)


def test_needed_letter_pairs_are_a_lower_bound(spark):
    rng = random.Random(8)
    for _ in range(4000):
        a = "".join(rng.choice("ab c") for _ in range(rng.randrange(1, 14)))
        b = "".join(rng.choice("ab c") for _ in range(rng.randrange(1, 14)))
        ratio = SequenceMatcher(None, a, b).ratio()
        pairs = lambda x: sorted(x[i:i + 2] for i in range(len(x) - 1))
        left, right, shared = pairs(a), pairs(b), 0
        for g in set(left):
            shared += min(left.count(g), right.count(g))
        if a != b and ratio >= 0.72 and max(len(a), len(b)) > similar.longest_without_pairs(0.72):
            assert shared >= 1
        if ratio >= 0.8:
            assert shared >= 0.2 * (len(a) + len(b)) - 1 - 1e-9
