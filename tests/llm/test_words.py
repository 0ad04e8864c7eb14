"""Names of words: equal for equal words only, whatever stands around them."""

import cases
import numpy as np
import pyarrow as pa

from tomeweave.llm import _words
from tomeweave.llm._words import SPACES, Words, pieces
from tomeweave.llm.queries import word_bpe
from tomeweave.llm.token_counts import load, token_counts


def thue_morse(n, a="a", b="b"):
    return "".join(a if bin(i).count("1") % 2 == 0 else b for i in range(n))


def colliding():
    return thue_morse(1024), thue_morse(1024, "b", "a")


def names(text, lower=False):
    column = pa.array([text])
    return [h for _, _, data, offsets in pieces(column) for h in Words(data, offsets, SPACES, lower).hash.tolist()]


def test_words_that_a_polynomial_takes_for_one():
    a, b = colliding()
    assert a != b and len(set(names(f"{a} {b} {a}"))) == 2
    # letters that change places 64 apart, and patterns over such places
    many = ["".join("b" if i // 64 in turned and i % 64 == 5 else "a" for i in range(640)) for turned in [set(), {0}, {1}, {0, 3}, {1, 2}, {0, 3, 5, 6}, {1, 2, 4, 7}]]
    assert len(set(names(" ".join(many)))) == len(many)
    assert names(f"{a} {b} {a}")[0] == names(f"x yy {a}")[2] == names(f"x yy {a.upper()}", True)[2]


def test_names_do_not_depend_on_blocks_or_neighbours():
    texts = [t or "" for t in cases.texts()] + ["é" * 3000, "ab " * 900]
    whole = [names(t) for t in texts]
    seen = {}
    for t, hashes in zip(texts, whole):
        for w, h in zip(cases.words(t), hashes):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    old = _words._BLOCK
    _words._BLOCK = 1000
    try:
        for t, hashes in zip(texts, whole):
            data = np.frombuffer(t.encode(), np.uint8)
            assert Words(data, np.array([0, len(data)]), SPACES, False).hash.tolist() == hashes
    finally:
        _words._BLOCK = old


def test_token_counts_of_texts_with_both_words(spark):
    a, b = colliding()
    texts = [f"{a} {b}", f"{b} {a} {b}", a, b]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    tokenizer = load(word_bpe())
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts(docs, word_bpe()).collect()}
    assert got == {i: len(tokenizer.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}
