"""Small inputs with all the odd cases, shared by the operators' tests."""

import random
import re

SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, n_words bigint, kept boolean, row string, id string, "
          "score double, found string, piece int, component string, block string")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def texts(seed=1):
    """Plain, copied, near-copied, repeated, empty, null, odd and very long texts."""
    rng = random.Random(seed)
    base, passage, long = prose(rng, 120), prose(rng, 60, 10 ** 6), prose(rng, 30_000, 10 ** 6)
    near = base.split()
    near[50] = "changed"
    return [base, base, " ".join(near), base.upper(), prose(rng, 10, 10 ** 6) + " " + passage + "\n" + prose(rng, 10, 10 ** 6),
            passage + "\t" + prose(rng, 40, 10 ** 6), prose(rng, 5, 10 ** 6) + "\r\n" + passage, "", None, " \n\t ", "one", "two words", "a " * 200,
            "Ünï—cödé ① \x85   ok <|endoftext|> it's ### | $$ ÀÉ", long, prose(rng, 300), prose(rng, 300, 20), "same line\nsame line\nsame line\n\nother"]


def row(doc_id, text, lang="en", source="s"):
    return (doc_id, text, lang, source, len(text or ""), -1, True, "r", "i", 0.5, "f", 3, "c", "b")


def documents(spark, seed=1):
    """The texts with ids, one row twice, one id with two texts, and null ids; names clash with the operators' own."""
    rows = [row(i, t) for i, t in enumerate(texts(seed))]
    rows += [rows[4], row(2, "a second text under one id"), row(None, "no id here"), row(None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA), rows


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
