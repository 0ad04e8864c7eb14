"""Robust outliers, quality, language models and language identification."""

import math
import random
import zlib
from collections import Counter

import cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from tomeweave.llm import class_lm, language_id, quality_classifier
from tomeweave.llm.class_lm import class_scores, exchange, head_of
from tomeweave.llm.language_id import languages
from tomeweave.llm.quality_classifier import fit, quality_scores
from tomeweave.llm.robust_outliers import STATISTICS, chi_square, minimum_covariance, quality_outliers, statistics
from tomeweave.llm._store import Scratch
from tomeweave.llm._words import SPACES, Words


def rest(doc_id, n):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


# ------------------------------------------------------------------ robust outliers
def base(text):
    w = cases.words(text)
    grams = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    lines, seen = [x for x in (text or "").split("\n") if cases.words(x)], set()
    again = sum(x in seen or bool(seen.add(x)) for x in lines)
    return (len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), again, len(covered),
            len(w) < 10 or 100 * len(covered) > 20 * len(w))


def test_base_statistics_equal_brute_force(spark):
    docs, rows = cases.documents(spark)
    more = ["a b c d e a b c d e f", "x x x x x x x", "p q r s t u p q r s t", "a\na\n \n\n b\r\n b\r\na", "# * $ % & | < > ##", "\x0bx\x0c y\t", "a b c d e " * 7 + "z"]
    rows = rows + [cases.row(100 + i, t) for i, t in enumerate(more)]
    docs = spark.createDataFrame(rows, cases.SCHEMA)
    got = quality_outliers(docs)
    fields = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert got.columns == ["doc_id", *fields, "distance", "kept"]
    found = got.collect()
    assert Counter((r["doc_id"], *[r[f] for f in fields]) for r in found) == Counter((r[0], *base(r[1])) for r in rows)
    assert not any(r["kept"] for r in found if r["base_failed"])
    assert quality_outliers(cases.empty(spark)).collect() == []


def test_estimates_resist_a_fifth_of_far_rows(spark):
    rng = np.random.default_rng(1)
    names = list(STATISTICS)
    good = rng.multivariate_normal([5, 1, 2, 3, 4], np.diag([1, 1, 1, 1, 1]) + 0.5, 800)
    far = rng.normal(40, 1, (200, 5))
    rows = [("a", *map(float, x)) for x in np.concatenate([good, far])]
    table = spark.createDataFrame(rows, "cell string, " + ", ".join(f"{n} double" for n in names))
    fitted = minimum_covariance(table, Scratch(spark, "test")).first()
    centre = np.array([fitted[f"m_{n}"] for n in names])
    assert np.abs(centre - [5, 1, 2, 3, 4]).max() < 0.3
    factor = np.array([[fitted[f"l_{i}_{j}"] if j <= i else 0.0 for j in range(5)] for i in range(5)])
    distance = lambda x: (np.linalg.solve(factor, (x - centre).T) ** 2).sum(0) / fitted["scale"]
    assert (distance(far) > chi_square(5, 0.9999)).all() and (distance(good) > chi_square(5, 0.9999)).mean() < 0.02
    assert abs(chi_square(5, 0.999) - 20.515) < 0.3 and abs(chi_square(5, 0.5) - 4.351) < 0.03


def test_odd_rows_are_rejected_and_small_cells_pooled(spark):
    rng = random.Random(2)
    rows = [cases.row(i, cases.prose(rng, rng.randrange(60, 200), 10 ** 6), rng.choice(["en", "de", None]), f"s{i % 60}") for i in range(600)]
    rows += [cases.row(1000 + i, " ".join(f"w{rng.randrange(10 ** 6)}***" for _ in range(80)), "en", "s1") for i in range(5)]
    kept = {r["doc_id"]: r["kept"] for r in quality_outliers(spark.createDataFrame(rows, cases.SCHEMA)).collect()}
    assert not any(kept[1000 + i] for i in range(5)) and sum(kept[i] for i in range(600)) > 590


def test_marks_and_doubled_lines_are_rejected_where_clean_texts_have_none(spark):
    """Well under the old fixed floors: 10 % symbols, and 2.5 % doubled lines, per word; one mark in a clean text is no outlier."""
    rng = random.Random(12)
    plain = lambda: cases.prose(rng, rng.randrange(150, 250), 10 ** 6)
    rows = [cases.row(i, plain() + (" &" if i % 40 == 0 else "")) for i in range(800)]
    for i in range(4):
        words = plain().split()
        rows.append(cases.row(1000 + i, " ".join(w + ("*" if j % 10 == 0 else "") for j, w in enumerate(words))))
        rows.append(cases.row(2000 + i, "\n".join([" ".join(words), *["again"] * (1 + len(words) // 40)])))
    kept = {r["doc_id"]: r["kept"] for r in quality_outliers(spark.createDataFrame(rows, cases.SCHEMA)).collect()}
    assert not any(kept[1000 + i] or kept[2000 + i] for i in range(4))
    assert sum(kept[i] for i in range(800)) > 785


def test_only_sql_functions_on_the_main_path(spark):
    docs, _ = cases.documents(spark)
    plan = quality_outliers(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert docs.select(statistics(F.col("text")).alias("s")).schema["s"].dataType.fieldNames()[0] == "n_words"


# ------------------------------------------------------------------ quality classifier
def quality_rows(n=500):
    rng, rows = random.Random(3), []
    for i in range(n):
        words = cases.prose(rng, rng.randrange(20, 200), 10 ** 5).split()
        bad = rng.random() < 0.2
        rows.append((cases.row(i, " ".join(w + "***" if bad else w for w in words) if words else ""), int(not bad)))
    return rows


def test_held_out_quality(spark):
    rows = quality_rows()
    docs = spark.createDataFrame([r for r, _ in rows] + [cases.row(None, None), cases.row(None, ""), rows[0][0]], cases.SCHEMA)
    labels = spark.createDataFrame([(r[0], q) for i, (r, q) in enumerate(rows) if i % 2] + [(None, 1), (4, None)], "doc_id bigint, quality int")
    got = quality_scores(docs, labels, sample=200, keep=("kept", "score", "text"))
    assert got.columns == ["doc_id", "held_out", "score", "predicted", "kept"]
    found = got.collect()
    truth = {r[0]: q for r, q in rows}
    said = {r[1] for r, _ in rows} | {None, ""}
    assert len(found) == len(rows) + 3 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) and r["kept"]["score"] == 0.5 and r["kept"]["text"] in said for r in found)
    held = [r for r in found if r["doc_id"] is not None and r["held_out"]]
    assert all(r["held_out"] == (rest(r["doc_id"], 5) == 0) for r in found)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) > 0.97 * len(held)
    assert quality_scores(cases.empty(spark), labels.limit(0)).collect() == []
    assert {r["score"] for r in quality_scores(docs, labels.where("quality = 0")).collect()} == {1.0}


def test_the_risk_of_hidden_negatives_stays_above_zero():
    rng = np.random.default_rng(4)
    positive, unlabelled = rng.normal(1, 1, (300, 2)), np.concatenate([rng.normal(1, 1, (240, 2)), rng.normal(-2, 1, (60, 2))])
    model = fit(positive, unlabelled, 0.8, epochs=200)
    loss = lambda z: np.logaddexp(0, z).mean()
    logit = lambda x: np.log(model.score(x) / (1 - model.score(x)))
    assert loss(logit(unlabelled)) - 0.8 * loss(logit(positive)) > -0.02
    assert (model.score(positive) >= 0.5).mean() > 0.9 and (model.score(unlabelled[240:]) < 0.5).mean() > 0.8
    assert quality_classifier.features(np.zeros(0, np.uint8), np.array([0, 0])).shape == (1, quality_classifier.WIDTH)


# ------------------------------------------------------------------ class language model
@pytest.mark.parametrize("head, in_classes", [(10 ** 6, 50), (30, 10), (0, 0)])
def test_scores_equal_a_plain_model(spark, head, in_classes):
    docs, rows = cases.documents(spark)
    split = [[*cases.words((r[1] or "").translate(cases.LOWER)), None] for r in rows]
    count = Counter(w for r, s in zip(rows, split) if rest(r[0], 7) != 2 for w in s)
    n, v = sum(count.values()), len(count)
    got = class_scores(docs, head_words=head, class_words=in_classes, n_classes=4, passes=2)
    found = got.collect()
    want = Counter((r[0], rest(r[0], 7) == 2, len(s), sum(count[w] > 0 for w in s), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in s), 6))
                   for r, s in zip(rows, split))
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found) == want
    assert all(r["score"] < 0 and r["perplexity"] > 1 for r in found)
    assert class_scores(cases.empty(spark)).collect() == []


def test_scores_of_the_open_class_equal_a_plain_sum(spark):
    """Without a head all words are of the open class, and every probability can be written down."""
    docs, rows = cases.documents(spark)
    split = [cases.words((r[1] or "").translate(cases.LOWER)) for r in rows]
    train = [s for r, s in zip(rows, split) if rest(r[0], 7) != 2]
    count, steps = Counter(w for s in train for w in s), Counter()
    for s in train:
        path = ["end", *["open"] * len(s), "end"]
        steps.update(zip(path, path[1:]))
    slots = sum(count.values()) + len(count) + 1
    assert abs(sum((n + 1) / slots for n in count.values()) + 1 / slots - 1) < 1e-12
    total = {a: sum(n for (x, _), n in steps.items() if x == a) + 3 * class_lm.SMOOTH for a in ("end", "open")}
    want = Counter()
    for r, s in zip(rows, split):
        path = ["end", *["open"] * len(s), "end"]
        moves = sum(math.log10((steps[a, b] + class_lm.SMOOTH) / total[a]) for a, b in zip(path, path[1:]))
        want[r[0], round(moves + sum(math.log10((count[w] + 1) / slots) for w in s), 6)] += 1
    assert Counter((r["doc_id"], round(r["score"], 6)) for r in class_scores(docs, head_words=0).collect()) == want


@pytest.mark.parametrize("head, in_classes", [(10 ** 6, 12), (40, 10), (9, 9)])
def test_scores_equal_a_plain_class_model(spark, monkeypatch, head, in_classes):
    """For the classes that the operator found, every count, transition and emission is written down again."""
    seen = {}
    for name in ("head_of", "_head_classes", "_tail_classes"):
        monkeypatch.setattr(class_lm, name, lambda *a, made=getattr(class_lm, name), name=name: seen.setdefault(name, made(*a)))
    rng = random.Random(5)
    some = lambda: f"w{min(int(rng.paretovariate(0.7)), 400)}"
    rows = [cases.row(i, " ".join(some() for _ in range(rng.randrange(0, 40)))) for i in range(150)]
    rows += [cases.row(500, " ".join(some() for _ in range(3000))), cases.row(None, None), cases.row(501, ""), cases.row(501, "only here w1 w399 w1 new")]
    found = class_scores(spark.createDataFrame(rows, cases.SCHEMA), head_words=head, class_words=in_classes, n_classes=3).collect()
    name = lambda w: int(Words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]), SPACES, True).hash.view(np.int64)[0])
    classes = dict(zip(seen["head_of"].words.tolist(), seen["_head_classes"][0][:-1].tolist())) | {r["word"]: r["class"] for r in seen["_tail_classes"].collect()}
    split = [cases.words(r[1] or "") for r in rows]
    train = [s for r, s in zip(rows, split) if rest(r[0], 7) != 2]
    count = Counter(w for s in train for w in s)
    own = {w: classes.pop(name(w)) for w in count}
    assert not classes and set(own.values()) <= {0, 1, 2}
    members, steps = Counter(), np.zeros((5, 5))
    for w, n in count.items():
        members[own[w]] += n
    path = lambda s: [4, *(own.get(w, 3) for w in s), 4]
    for s in train:
        for a, b in zip(path(s), path(s)[1:]):
            steps[a, b] += 1
    new = (sum(n == 1 for n in count.values()) + class_lm.SMOOTH) / (steps.sum() + 2 * class_lm.SMOOTH)
    chance = steps + class_lm.SMOOTH
    chance[3] = chance.sum(0)
    chance[:, 3] = 0
    chance = chance / chance.sum(1, keepdims=True) * (1 - new)
    chance[:, 3] = new
    assert np.allclose(chance.sum(1), 1)
    want = Counter()
    for r, s in zip(rows, split):
        score = sum(math.log10(chance[a, b]) for a, b in zip(path(s), path(s)[1:])) + sum(math.log10(count[w] / members[own[w]]) for w in s if w in own)
        want[r[0], len(s) + 1, round(score, 4)] += 1
    assert Counter((r["doc_id"], r["n_tokens"], round(r["score"], 4)) for r in found) == want


def test_counts_beside_words_equal_a_plain_count(spark, monkeypatch):
    """Held dense or sparse, in one shard or in many, by one task or by several."""
    rng = np.random.default_rng(8)
    classes, kinds = np.append(rng.integers(0, 4, 30), 3), 5
    rows = [rng.integers(0, 31, n).astype(np.uint32) for n in (0, 1, 50, 400, 3)] * 3
    pairs, near = np.zeros((kinds, kinds), int), np.zeros((20, 2, kinds), int)
    for ids in rows:
        own = [4, *classes[ids], 4]
        for a, b in zip(own, own[1:]):
            pairs[a, b] += 1
        for i, word in enumerate(ids):
            if 5 <= word < 25:
                near[word - 5, 0, own[i]] += 1
                near[word - 5, 1, own[i + 2]] += 1
    table = spark.createDataFrame([(bytearray(ids.tobytes()),) for ids in rows], "ids binary").repartition(3)
    for shard, dense in ((1 << 19, 1 << 22), (30, 0), (30, 1 << 22)):
        monkeypatch.setattr(class_lm, "SHARD", shard)
        ranks = class_lm.Ranks(classes, 5, 25, kinds)
        assert ranks.shards == (1 if shard > 30 else 7)
        blobs = []
        monkeypatch.setattr(class_lm, "DENSE", dense)
        body = class_lm._near(type("Held", (), {"value": ranks}))
        for batch in table.toArrow().to_batches():
            blobs += body(iter([batch]))
        blobs = spark.createDataFrame([tuple(x.values()) for b in blobs for x in b.to_pylist()], class_lm.BLOB)
        got_near, got_pairs = class_lm._counted(blobs, ranks)
        assert (got_near == near).all() and (got_pairs == pairs).all()


def test_exchange_finds_planted_classes():
    rng = np.random.default_rng(6)
    truth = np.arange(40) % 2  # words of class 0 are followed by words of class 1 and the other way round
    words, at = [], 0
    for _ in range(20_000):
        words.append(int(rng.choice(np.flatnonzero(truth == at))))
        at = 1 - at
    classes = rng.integers(0, 2, 40)
    for _ in range(6):
        before, after = np.zeros((40, 4)), np.zeros((40, 4))
        for a, b in zip(words, words[1:]):
            before[b, classes[a]] += 1
            after[a, classes[b]] += 1
        classes = exchange(classes, before, after, 2)
    assert (classes == truth).all() or (classes == 1 - truth).all()


def test_words_beyond_the_seeds_get_classes_too(spark):
    """Rare words of two kinds alternate; which kind may follow is known only if each rare word has a class."""
    rng, rows = random.Random(9), []
    some = lambda k: f"{k}{rng.randrange(4) if rng.random() < 0.5 else rng.randrange(4, 150)}"
    for i in range(400):
        rows.append(cases.row(i, " ".join(some(k) for _ in range(30) for k in "xy")))
    # rare words in the right order and in a wrong one, both held out
    held = [i for i in range(1000, 1100) if rest(i, 7) == 2][:2]
    order = [f"{k}{j}" for j in range(50, 100) for k in "xy"]
    rows += [cases.row(held[0], " ".join(order)), cases.row(held[1], " ".join(sorted(order)))]
    for head in (10 ** 6, 100, 8):
        got = {r["doc_id"]: r["score"] for r in class_scores(spark.createDataFrame(rows, cases.SCHEMA), head_words=head, class_words=8, n_classes=2).collect()}
        assert got[held[0]] > got[held[1]] + 20, head


def test_the_head_is_bounded(spark):
    counts = spark.createDataFrame([(i, 1 + 1000 // (i + 1)) for i in range(2000)], "word bigint, n bigint")
    for limit in (0, 1, 50, 5000):
        head = head_of(counts, limit)
        assert len(head.words) <= limit and (len(head.words) == 2000 or limit < 5000)
        assert (np.diff(head.counts) <= 0).all() and head.encode(np.array([-5])).tolist() == [len(head.words)]
    assert class_lm.CLASS_WORDS <= class_lm.HEAD_WORDS


# ------------------------------------------------------------------ language identification
def test_held_out_languages(spark):
    rng = random.Random(7)
    sounds = {"aa": "ka ko ke mu na".split(), "bb": "sch ung ein lich".split(), "cc": "ção ñe é que".split()}
    rows = []
    for i in range(360):
        lang = rng.choice(list(sounds))
        rows.append(cases.row(i, " ".join("".join(rng.choice(sounds[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(4, 60))), lang))
    odd = [cases.row(1000, None), cases.row(1001, "12 -- !"), cases.row(1002, ""), cases.row(None, "ka ko", None), cases.row(None, "ka ko", None)]
    docs = spark.createDataFrame(rows + odd, cases.SCHEMA)
    got = languages(docs, landmarks=30, per_language=60)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    found = got.collect()
    truth = {r[0]: r[2] for r in rows}
    assert len(found) == len(rows) + 5 and all(0 <= r["score"] <= 1 and r["held_out"] == (rest(r["doc_id"], 4) == 2) for r in found)
    assert {r["lang_pred"] for r in found if r["doc_id"] in (1000, 1001, 1002)} == {"und"}
    held = [r for r in found if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) > 0.97 * len(held)
    assert languages(cases.empty(spark)).collect() == []
    assert {r["lang_pred"] for r in languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_every_language_is_learnt(spark):
    """Ninety languages of their own syllables; the rarest has a tenth of the others' rows."""
    rng, rows = random.Random(11), []
    sounds = {f"l{k:02}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4)) for _ in range(5)] for k in range(90)}
    for k, (lang, made) in enumerate(sounds.items()):
        for i in range(2 if k > 70 else 20):
            rows.append(cases.row(next(j for j in range(1000 * k + 10 * i, 10 ** 6) if rest(j, 4) != 2), " ".join(rng.choice(made) for _ in range(30)), lang))
    held = {}
    for k, (lang, made) in enumerate(sounds.items()):
        held[next(j for j in range(10 ** 6 + 100 * k, 10 ** 7) if rest(j, 4) == 2)] = lang
        rows.append(cases.row(list(held)[-1], " ".join(rng.choice(made) for _ in range(30)), lang))
    got = {r["doc_id"]: r["lang_pred"] for r in languages(spark.createDataFrame(rows, cases.SCHEMA)).collect()}
    assert {i: got[i] for i in held} == held


def test_presence_counts_ngrams_once():
    data = np.frombuffer("abab aBAB".encode(), np.uint8)
    rows = language_id.presence(data, np.array([0, 4, 5, 9]))
    assert np.allclose(rows[0], rows[2]) and abs((rows[0] ** 2).sum() - 1) < 1e-6 and (rows[1] > 0).sum() == 1
