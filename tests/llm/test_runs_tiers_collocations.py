"""Periodic runs, tiered packing and collocations against brute force."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from tomeweave.llm.collocations import Filter, _bits, _folded, collocations
from tomeweave.llm.periodic_runs import find_runs, periodic_runs, respelled, synchronising
from tomeweave.llm.queries import QUERIES, word_bpe
from tomeweave.llm.tier_pack import Groups, Item, Packer, tier_pack
from tomeweave.llm.token_counts import load


# ------------------------------------------------------------------ periodic runs
def brute_runs(w, least, powers=3):
    found = {}
    for q in range(1, len(w) // powers + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, powers * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e, q) for (s, e), q in found.items())


CODES = np.random.default_rng(3).integers(1, 1 << 63, 100_000, dtype=np.uint64)


def named(texts):
    parts = []
    for k, t in enumerate(texts):
        parts += [*t, 90_000 + k]
    return CODES[np.array(parts)]


def patterned(rng):
    some = lambda n, k: [rng.randrange(k) for _ in range(n)]
    unary = [0] * rng.randrange(1, 25) + [1]
    nested = some(rng.randrange(1, 4), 3) * rng.randrange(1, 8) + [7]
    body = rng.choice([some(rng.randrange(1, 30), rng.choice([1, 2, 3, 50])), unary, nested, nested * rng.randrange(1, 5) + [8]])
    return some(rng.randrange(5), 3) + (body * rng.randrange(2, 9))[:rng.randrange(1, 250)] + some(rng.randrange(9), 3)


def test_runs_equal_brute_force_on_patterns():
    rng, seen = random.Random(11), 0
    for trial in range(300):
        texts, least = [patterned(rng) for _ in range(rng.randrange(1, 4))], rng.choice([1, 3, 24])
        want, base = [], 0
        for t in texts:
            want += [(base + s, base + e, q) for s, e, q in brute_runs(t, least)]
            base += len(t) + 1
        got = sorted(zip(*(x.tolist() for x in find_runs(named(texts), max(map(len, texts)), least))))
        assert got == sorted(want), texts
        seen += len(want)
    assert seen > 1000


def test_fibonacci_words_and_more_powers():
    a, b = [0], [0, 1]
    while len(b) < 1500:
        a, b = b, b + a
    for powers in (3, 4):
        got = sorted(zip(*(x.tolist() for x in find_runs(named([b]), len(b), 1, powers))))
        assert got == brute_runs(b, 1, powers)
    with pytest.raises(ValueError):
        find_runs(named([b]), len(b), 24, 2)


def test_synchronising_positions_depend_on_their_context_and_are_few():
    rng = random.Random(2)
    t = [rng.randrange(50) for _ in range(4000)]
    t[3000:3400] = t[1000:1400]
    names, scale = named([t]), 1
    from tomeweave.llm._words import mixed
    while scale < 16:
        names, scale = mixed(names[:-scale] * np.uint64(3) + mixed(names[scale:].copy())), 2 * scale
    none = np.zeros(0, np.int64)
    at = set(synchronising(names, 16, (none, none, none)).tolist())
    assert {i + 2000 for i in at if 1000 <= i <= 1400 - 32} == {i for i in at if 3000 <= i <= 3400 - 32}
    assert len(at) < 4000 / 5
    gaps = np.diff(sorted(at))
    assert gaps.max() <= 16


def brute_document(doc_id, text, rule):
    w = cases.words(text)
    order = respelled(doc_id, len(w)) if rule else None
    if order is not None:
        w = [w[i] for i in order.tolist()]
    runs = [(s, e - s, q) for s, e, q in brute_runs(w, 24)]
    runs.sort(key=lambda r: (r[0], r[2]))
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(kept))


def test_documents_equal_brute_force(spark):
    rng = random.Random(4)
    docs, rows = cases.documents(spark)
    rows = [r if len(r[1] or "") < 50_000 else (*r[:1], "a b c " * 9_000 + cases.prose(rng, 300), *r[2:]) for r in rows]
    rows += [cases.row(100 + i, " ".join(f"v{x}" for x in patterned(rng))) for i in range(40)]
    # ids that the contract's rule changes
    rows += [cases.row(i, cases.prose(rng, rng.randrange(1, 400))) for i in range(1000, 1100)]
    docs = spark.createDataFrame(rows, cases.SCHEMA).repartition(3)
    for rule in (None, respelled):
        short = [r for r in rows if len(r[1] or "") < 20_000]
        got = periodic_runs(docs, rule=rule, spans=False).collect()
        assert len(got) == len(rows)
        left = Counter(tuple(r) for r in got)
        left.subtract(Counter(brute_document(r[0], r[1], rule) for r in short))
        assert min(left.values()) == 0 and sum(left.values()) == len(rows) - len(short)
    long = [r for r in got if r.length == 27_000 and r.period == 3]
    assert len(long) == 1 and long[0].exponent_milli == 9_000_000
    full = periodic_runs(docs).where("n_runs > 0").collect()
    assert all(hashlib.sha256(r.collapsed.encode()).hexdigest() == r.collapsed_sha256 and len(r.runs) == r.n_runs for r in full)
    assert periodic_runs(cases.empty(spark)).collect() == []


# ------------------------------------------------------------------ tiers
def test_packer_fills_every_context_exactly():
    rng = random.Random(6)
    for tiers in ((8, 16, 64), (32,), (1, 2, 4, 8)):
        packer, total = Packer(tiers), 0
        for owner in range(400):
            n = min(1 + int(rng.expovariate(1 / 15)), 900)
            packer.add(Item(owner, 0, np.arange(n, dtype="<u4")))
            total += n
            if owner % 37 == 0:
                packer.pack()
                assert packer.shelf.tokens < tiers[-1]
                assert all(sum(map(len, s)) in tiers for s in packer.sequences)
        packer.pack()
        packer.finish()
        sizes = [sum(map(len, s)) for s in packer.sequences]
        assert sum(sizes) == total and all(x & (x - 1) == 0 for x in sizes) and sum(x not in tiers for x in sizes) <= 8
        places = defaultdict(list)
        for item in (i for s in packer.sequences for i in s):
            assert item.tokens[0] == item.start
            places[item.owner].append((item.start, len(item)))
        for parts in places.values():
            parts.sort()
            assert [a for a, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1].tolist()]


def test_groups_are_full_but_for_the_last():
    groups, room = Groups(64), Counter()
    rng = random.Random(1)
    sizes = [[1 << rng.randrange(7) for _ in range(rng.randrange(60))] for _ in range(9)]
    for batch in sizes:
        for size, group in zip(batch, groups.place(batch)):
            room[group] += size
    assert max(room.values()) <= 64 and len(room) == groups.count
    whole = [1 << (i % 6) for i in range(600)]
    groups = Groups(64)
    room = Counter()
    for size, group in zip(whole, groups.place(whole)):
        room[group] += size
    assert sorted(room.values())[1:] == [64] * (len(room) - 1)
    with pytest.raises(ValueError):
        Groups(100)


def test_tiers_hold_every_id_once(spark):
    docs, rows = cases.documents(spark)
    tokenizer = load(word_bpe())
    want = Counter()
    for r in rows:
        ids = tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [2]
        want[(r[0], len(ids), tuple(ids))] += 1
    got = tier_pack(docs.repartition(2), word_bpe(), tiers=(64, 256, 1024), group_tokens=2048).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        sequences[r.sequence_id].append(r)
        pieces[(r.doc_id, r.doc_tokens)].append(r)
    for rs in sequences.values():
        rs.sort(key=lambda r: r.offset)
        assert [r.offset for r in rs] == [0, *np.cumsum([r.length for r in rs])[:-1].tolist()]
        assert sum(r.length for r in rs) == rs[0].context and rs[0].context & (rs[0].context - 1) == 0 and len({r.step_group for r in rs}) == 1
    groups = Counter()
    for rs in sequences.values():
        groups[rs[0].step_group] += rs[0].context
    assert max(groups.values()) <= 2048
    for (doc_id, n, ids), times in want.items():
        mine = sorted((r.start, struct.unpack(f"<{r.length}I", r.ids)) for r in pieces[(doc_id, n)])
        assert sum(len(x) for _, x in mine) % n == 0
        whole = defaultdict(list)
        for start, part in mine:
            whole[start].append(part)
        assert all(ids[s:s + len(p)] == p for s, ps in whole.items() for p in ps) or times > 1 or len([k for k in want if k[:2] == (doc_id, n)]) > 1
    assert sum(r.length for r in got) == sum(n * t for (_, n, _), t in want.items())
    assert tier_pack(cases.empty(spark), word_bpe()).collect() == []
    for bad in ((3, 4), (4, 2)):
        with pytest.raises(ValueError):
            tier_pack(docs, word_bpe(), tiers=bad)


# ------------------------------------------------------------------ collocations
def brute_collocations(rows, least, top, covered):
    f, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(cases.LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        drop = set()
        for p, a in candidates.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    if 100 * a >= covered * counts[p[i:i + k]]:
                        drop.add(p[i:i + k])
        scored = []
        for p, a in candidates.items():
            if p not in drop:
                score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, total[lang], -score))
    return sorted(out)


def text_rows(seed=3):
    """Skewed words, so pairs repeat; passages, so longer phrases cover shorter ones; ties and odd bytes."""
    rng = random.Random(seed)
    rows = []
    for lang, size in (("en", 60), ("de", 30), (None, 20), ("und", 10), ("é", 3), ("nothing", 0)):
        vocabulary = [f"{'W' if i % 7 == 0 else 'w'}{i}" for i in range(40)] + ["the", "ÄB", "a\x85b"]
        passages = [[rng.choice(vocabulary) for _ in range(rng.randrange(2, 7))] for _ in range(8)]
        for _ in range(size):
            words = []
            for _ in range(rng.randrange(1, 120)):
                words += rng.choice(passages) if rng.random() < 0.4 else [vocabulary[min(int(rng.expovariate(0.15)), len(vocabulary) - 1)]]
                words[-1] += rng.choice(["", "", "", "", "", ".", ",", "\n", "\t", "! "])
            rows.append((" ".join(words), lang))
    return rows + [("", "en"), (None, "en"), (None, None), (" \t\n", "de"), ("x y " * 5000, "long"), ("one", "nothing")]


def test_collocations_equal_brute_force_at_any_floor(spark):
    rows = text_rows()
    docs = spark.createDataFrame([(i, t, lang, "s", 1, "x") for i, (t, lang) in enumerate(rows)], "doc_id int, text string, lang string, w string, a int, n string")
    docs = docs.repartition(4)
    for least, top, margin in ((3, 1000, 1), (3, 4, 1), (5, 25, 2)):
        want = brute_collocations(rows, least, top, 80)
        got = collocations(docs, least=least, top=top, margin=margin, filter_bits=1 << 20).collect()
        assert sorted(tuple(r) for r in got) == want
        assert {r.lang for r in got} >= {"en", "de", "und", "long"}
    assert collocations(docs.limit(0)).collect() == []
    # a language whose every phrase is covered but the longest
    repeated = [("a b c d. " * 40, "en")] * 3
    one = spark.createDataFrame(repeated, "text string, lang string")
    assert sorted(tuple(r) for r in collocations(one, top=3).collect()) == brute_collocations(repeated, 30, 3, 80)
    with pytest.raises(ValueError):
        collocations(docs, filter_bits=1000)


def test_filter_never_forgets():
    rng = np.random.default_rng(5)
    names = [rng.integers(0, 1 << 63, 5000, dtype=np.uint64) for _ in range(2)]
    bits, block = 1 << 20, (1 << 20) // 256
    cells = np.zeros(bits, bool)
    for place in _bits(_folded(names, np.uint64(7)), bits):
        cells[place] = True
    raw = np.packbits(cells, bitorder="little").tobytes()
    found = Filter({i: raw[i * block // 8:(i + 1) * block // 8] for i in range(256)}, bits)
    assert found.has(names, np.uint64(7)).all()
    assert found.has(names, np.uint64(8)).mean() < 0.01 and found.has(names[::-1], np.uint64(7)).mean() < 0.01


def test_queries_are_registered_with_their_columns(spark):
    columns = {
        "op11_tier_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
        "op12_periodic_runs": ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
        "op13_collocations": ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]}
    for name, wanted in columns.items():
        df = QUERIES[name](spark, "/root/testdata/sf0.001")
        assert df.columns[:len(wanted)] == wanted
        longs = [c for c in wanted if c not in ("doc_id", "phrase", "lang") and not c.endswith("sha256")]
        assert all(df.schema[c].dataType.simpleString() == "bigint" for c in longs)
        assert df.agg(F.count(F.lit(1))).first()[0] >= 0


def test_phrases_are_counted_in_bounded_stretches_of_an_arrow_batch(monkeypatch):
    """A batch may hold a whole task's tokens; what is sorted at once must not grow with it."""
    import numpy as np
    import pyarrow as pa

    from tomeweave.llm import collocations as c
    monkeypatch.setattr(c, "STRETCH", 100)
    rows = [np.array([0, 1, 2, 1, 2, 3, 0], np.uint64).tobytes() for _ in range(200)]
    made = list(c._grams(2, None, None)(iter([pa.record_batch([pa.array(rows, pa.binary())], ["tokens"])])))
    assert len(made) == 14 and max(sum(b.column("n").to_pylist()) for b in made) <= 100
    counts = {}
    for b in made:
        for w1, w2, n in zip(*(b.column(k).to_pylist() for k in ("w1", "w2", "n"))):
            counts[w1, w2] = counts.get((w1, w2), 0) + n
    assert counts == {(1, 2): 400, (2, 1): 200, (2, 3): 200}


def test_filter_blocks_are_packed_as_they_are_filled():
    import numpy as np
    import pyarrow as pa

    from tomeweave.llm import collocations as c
    keys = np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    bits = 1 << 20
    want = np.zeros(bits, bool)
    for place in c._bits(keys, bits):
        want[place] = True
    batches = [pa.record_batch([pa.array(k.view(np.int64))], ["key"]) for k in np.array_split(keys, 3)]
    (made,) = c._blocks(bits)(iter(batches))
    filled = c.Filter(dict(zip(made.column("block").to_pylist(), made.column("cells").to_pylist())), bits)
    assert (np.unpackbits(filled.cells, bitorder="little").astype(bool) == want).all()
