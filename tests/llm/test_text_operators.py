"""Decontamination, tokens, packing and chat formatting against brute force."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import cases
import numpy as np
import pyarrow as pa
import pytest

from tomeweave.llm import token_counts as tokens
from tomeweave.llm.chat_format import digests, format_conversations, locate_turns, marked_turns, read_turns
from tomeweave.llm.decontaminate import FMIndex, contamination, remove_contamination, suffix_array
from tomeweave.llm.pack import Plan, pack
from tomeweave.llm.queries import word_bpe

TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(cases.LOWER))


# ------------------------------------------------------------------ benchmark decontamination
def test_suffix_array_and_search_equal_brute_force():
    rng = random.Random(8)
    symbols = []
    for _ in range(60):
        symbols += [rng.randrange(1, 4) for _ in range(rng.randrange(1, 30))] + [0]
    array = np.array(symbols, np.int32)
    code, ends = [], 0
    for s in symbols:
        code.append(ends if s == 0 else s + 1000)
        ends += s == 0
    assert suffix_array(array).tolist() == sorted(range(len(code)), key=lambda i: code[i:])
    index = FMIndex(array)
    for length in (1, 2, 5):
        phrases = np.array([[rng.randrange(1, 4) for _ in range(length)] for _ in range(30)], np.int32)
        which, low, high = index.search(phrases)
        found = {int(p): sorted(index.locate(np.arange(a, b)).tolist()) for p, a, b in zip(which, low, high)}
        want = {i: [j for j in range(len(symbols)) if symbols[j:j + length] == p.tolist()] for i, p in enumerate(phrases)}
        assert found == {i: w for i, w in want.items() if w}


def benchmark_rows(rows):
    w = [terms(r[1]) for r in rows]
    return [(0, " ".join(w[0][20:45])), (1, " ".join(w[14][100:112])), (2, "one"), (3, None), (4, "!!"), (5, "Two WORDS"), (5, "ünï—cödé ①"),
            (None, " ".join(w[15][:12])), (7, "nowhere at all"), (8, " ".join(w[0][20:45]) + " more"), (9, "a a a")]


def hits(rows, bench, k):
    windows = defaultdict(set)
    for item, text in bench:
        w = terms(text)
        for i in range(max(1, len(w) - k + 1) if w else 0):
            windows[tuple(w[i:i + k])].add(item)
    out = []
    for r in rows:
        w, hit, items = terms(r[1]), set(), set()
        for n in {len(p) for p in windows}:
            for i in range(len(w) - n + 1):
                if owners := windows.get(tuple(w[i:i + n])):
                    hit.update(range(i, i + n))
                    items |= owners
        out.append((r[0], len(w), len(hit), tuple(sorted(str(i) for i in items if i is not None))))
    return Counter(out)


@pytest.mark.parametrize("block_bytes", [1 << 24, 1])
def test_contamination_equals_brute_force(spark, block_bytes):
    docs, rows = cases.documents(spark)
    bench = benchmark_rows(rows)
    table = spark.createDataFrame(bench, "item_id bigint, text string")
    got = contamination(docs, table, 10, block_bytes=block_bytes)
    assert got.columns == ["doc_id", "n_words", "n_hit", "spans", "items"]
    found = got.collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in found) == hits(rows, bench, 10)
    assert all(sum(s["end"] - s["start"] for s in r["spans"]) == r["n_hit"] for r in found)
    cut = remove_contamination(docs, table, 10, block_bytes=block_bytes)
    assert cut.select("rest.*").columns == [c for c in docs.columns if c != "text"]
    after = Counter((r["rest"]["doc_id"], r["text"]) for r in cut.collect())
    clean = [r for r in rows if not sum(h[2] for h in hits([r], bench, 10))]
    assert all(after[r[0], r[1]] for r in clean) and sum(after.values()) == len(rows)


def test_contamination_of_nothing(spark):
    docs, rows = cases.documents(spark)
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert {(r["n_hit"], len(r["items"])) for r in contamination(docs, none).collect()} == {(0, 0)}
    assert contamination(cases.empty(spark), none).collect() == []


# ------------------------------------------------------------------ tokens
def library(text):
    return tokens.load(word_bpe()).encode(text or "", add_special_tokens=False).ids


def test_counts_equal_the_library(spark):
    docs, rows = cases.documents(spark)
    for options in ({}, {"chunk": 2000, "overlap": 200}):
        got = tokens.token_counts(docs, word_bpe(), 50, **options)
        assert Counter(tuple(r) for r in got.collect()) == Counter(
            (r[0], len((r[1] or "").encode()), n := len(library(r[1])), n > 50) for r in rows)
    assert tokens.token_counts(cases.empty(spark), word_bpe()).collect() == []


def test_pieces_and_overlaps_equal_the_library():
    rng = random.Random(5)
    parts = list("aAbtsdlrevm'.,!?;:*$%&#()<|>12 é́ñ…— 　\n\t\x0b\x0c\x1c\x85Σσİß中") + ["<|endoftext|>", "'re", "'ll", "ﬁ", " ", " "]
    odd = ["".join(rng.choice(parts) for _ in range(rng.randrange(80))) for _ in range(3000)]
    got = [ids[a:b].tolist() for _, ids, bounds in tokens.encoded(word_bpe(), pa.array(odd)) for a, b in zip(bounds, bounds[1:])]
    coder = tokens.load(word_bpe())
    assert got == [e.ids for e in coder.encode_batch(odd, add_special_tokens=False)]
    for text in ["".join(odd[:300]), "x" * 5000, "ab'll.  " * 900, "é" * 3000, " " * 4000]:
        for chunk, overlap in ((500, 60), (1500, 300)):
            assert tokens.encode_huge(coder, text, chunk, overlap, guard=20).tolist() == coder.encode(text, add_special_tokens=False).ids


# ------------------------------------------------------------------ packing
@pytest.mark.parametrize("seed", range(6))
def test_plan_fills_bins_without_gaps(seed):
    rng = random.Random(seed)
    capacity = 64
    kinds = [lambda: rng.randint(1, 64), lambda: rng.choice([1, 21, 22, 32, 33, 43, 64]), lambda: rng.randint(22, 64), lambda: rng.randint(1, 21)]
    counts = Counter(kinds[seed % 4]() for _ in range(rng.choice([1, 50, 2000])))
    plan = Plan(dict(counts), capacity)
    bins = defaultdict(list)
    for length, ranges in plan.take.items():
        used = 0
        for first, n_bins, bin0, each, offset in ranges:
            assert first == used
            for b in range(n_bins):
                for i in range(each):
                    bins[bin0 + b].append((offset + i * length, length))
            used += n_bins * each
        assert used == counts[length]
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity and sum(length > capacity / 3 for _, length in items) <= 2
    total = sum(k * n for k, n in counts.items())
    assert len(bins) == plan.bins and plan.bins <= max(-(-total // capacity) * 1.25 + 1, sum(n for k, n in counts.items() if k > capacity // 2))


def test_pieces_hold_every_token_once(spark):
    docs, rows = cases.documents(spark)
    capacity = 64
    got = pack(docs, word_bpe(), capacity).collect()
    want = Counter()
    for r in rows:
        ids = [*library(r[1]), 1]
        for i in range(-(-len(ids) // capacity)):
            part = ids[i * capacity:(i + 1) * capacity]
            want[r[0], i, i * capacity, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    assert pack(cases.empty(spark), word_bpe()).collect() == []


# ------------------------------------------------------------------ chat formatting
def conversations(spark):
    rng = random.Random(6)
    odd = ["\\### Assistant: </turn> ok", "###", "\\", "####</turn></turn>\\\\###", "", None, "a: b\nc", "</turn>\n### user: hi</turn>\n", "é①" * 20]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "a:b\n", None]), rng.choice(odd), "x", "y") for c in (1, 2, None) for t in range(9)]
    rows += [(3, t, "assistant" if t % 2 else "user", f"turn {t}", "x", "y") for t in range(200)]
    rows += [(4, 0, "assistant", "same", "x", "y")] * 3 + [(4, None, "user", "first", "x", "y"), (5, 0, "user", "alone", "x", "y")]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, block string, n string"), rows


def test_what_is_read_back_is_what_was_said(spark):
    table, rows = conversations(spark)
    want = {}
    for conv in {r[0] for r in rows}:
        turns = [x[2:] for x in sorted((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv)]
        said, loss = "".join(f"{a}\n{b}\n" for a, b in turns), "".join(b for a, b in turns if a == "assistant")
        want[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(marked_turns(turns)))
    got = format_conversations(table)
    assert got.where("rewrites").isEmpty()
    assert {r[0]: tuple(r)[1:] for r in digests(got).collect()} == want
    assert got.where("conv_id = 3").count() == 4
    assert format_conversations(table.limit(0)).collect() == []


def test_spans_of_other_templates():
    turns = [("user", "hi"), ("assistant", "<b>"), ("assistant", ""), ("user", "b>x")]

    def bracketed(messages):
        return "<s>" + "".join(f"<{r[0]}>{t}</{r[0]}>" for r, t in messages)

    text, spans = locate_turns(bracketed, turns)
    assert text == bracketed(turns) and [text[b:c] for _, b, c, _ in spans] == [t for _, t in turns]

    def forgetful(messages):
        return "".join(f"{r}:{'' if r == 'assistant' and i < len(messages) - 1 else t}\n" for i, (r, t) in enumerate(messages))

    assert locate_turns(forgetful, turns) == (forgetful(turns), None)
    assert read_turns(marked_turns(turns)) == turns


def test_a_template_that_rewrites_history_is_flagged(spark):
    def last_only(messages):
        return f"{len(messages)} {messages[-1][1]}"

    rows = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "assistant", "c")], "conv_id bigint, turn bigint, role string, text string")
    got = {r["conv_id"]: r for r in format_conversations(rows, last_only).collect()}
    assert got[1]["rewrites"] and got[1]["loss"] == [] and not got[2]["rewrites"]


def test_templates_with_a_state_beyond_one_block(spark):
    roles = ["system", *["user", "assistant"] * 100]

    def numbered_turns(messages):
        return "".join(f"{i} {r}: {t}\n" for i, (r, t) in enumerate(messages))

    def alternating(messages):
        if [r for r, _ in messages] != roles[:len(messages)]:
            raise ValueError("roles must alternate behind the system turn")
        return f"[{messages[0][1]}]" + "".join(f"<{r}>{t}" for r, t in messages[1:])

    def far(messages):
        # the first turn goes once there are more than 100
        return "".join(f"{r}: {t}\n" for r, t in messages[len(messages) > 100:])

    turns = [(r, f"text {i}") for i, r in enumerate(roles)]
    rows = [(c, i, r, t) for c, n in ((1, 201), (2, 70), (None, 130)) for i, (r, t) in enumerate(turns[:n])]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    for template, flagged in ((numbered_turns, set()), (alternating, set()), (far, {1, None})):
        got = defaultdict(list)
        for r in sorted(format_conversations(table, template).collect(), key=lambda r: r["block"]):
            got[r["conv_id"]].append(r)
        for conv, n in ((1, 201), (2, 70), (None, 130)):
            assert "".join(r["formatted"] for r in got[conv]) == template(turns[:n])
            assert {r["rewrites"] for r in got[conv]} == {conv in flagged}
            learnt = [r["formatted"][m["start"]:m["end"]] for r in got[conv] for m in r["loss"]]
            assert learnt == ([] if conv in flagged else [t for r, t in turns[:n] if r == "assistant"])
