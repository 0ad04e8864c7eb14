"""The pipeline's stages and the registered queries."""

import random
from collections import Counter

import cases
import pytest
from test_dedup import cut, groups
from test_text_operators import terms

import corpus_pipeline
from tomeweave.llm import queries
from tomeweave.llm._store import Scratch

FOLDER = "/root/testdata/sf0.001"
TYPES = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, n_words int"


def write(spark, folder, rows, bench, labels):
    spark.createDataFrame(rows, TYPES).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    plain = lambda n: cases.prose(rng, n, 10 ** 6)
    passage, item = plain(60), plain(20)
    texts = [plain(rng.randrange(70, 150)) for _ in range(120)]
    texts += [texts[0], texts[0], texts[1] + " one more", plain(30) + " " + passage + " " + plain(30), passage + "\n" + plain(40), plain(30) + "\n" + item + ", " + plain(30)]
    good = [1] * len(texts)
    texts += [" ".join(w + "***" for w in plain(90).split()) for _ in range(30)]
    good += [0] * 30
    rows = [(i, t, "en", "s", len(t), True, 7) for i, t in enumerate(texts)] + [(None, plain(80), None, None, None, None, None), (500, texts[2], "en", "s", 1, None, 1)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    write(spark, folder, rows, [(0, item), (1, None), (2, "")], [(i, q, 0) for i, q in enumerate(good)])
    return folder, rows, good


def test_every_stage_does_its_work_and_keeps_the_clean(spark, corpus):
    folder, rows, good = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names, results, tables = docs.columns, [], Scratch(spark, "test")
    for name, stage in corpus_pipeline.STAGES:
        docs = tables.table(stage(spark, docs, folder), name.replace(" ", "-"))
        results.append(docs)
    assert [r.columns for r in results[:4]] == [names] * 4
    one, two, three, four = ({(r["doc_id"], r["text"]) for r in d.collect()} for d in results[:4])
    assert one == {(r[0], r[1]) for r in rows if r[0] is None or r[0] == 500 or good[r[0]]}
    want = groups([r for r in rows if (r[0], r[1]) in one], 5, 80)
    assert two == {k for k, (_, c) in want.items() if k[0] == c}
    assert Counter(cut(sorted(two, key=str), 50)) == Counter((i, len(cases.words(dict(two)[i])), len(cases.words(dict(two)[i])) - len(cases.words(t)), " ".join(cases.words(t)))
                                                              for i, t in three)
    hit = {i for i, _ in three} - {i for i, t in three if (i, t) in four}
    assert hit == {125} and len(four) == len(three)
    item = dict(rows_of(spark, folder))[0]
    left = terms(dict(four)[125])
    assert not any(terms(item)[j:j + 10] == left[i:i + 10] for i in range(len(left)) for j in range(11))
    assert all(r["n_chars"] == len(r["text"]) for r in results[3].where("doc_id in (123, 124, 125)").collect())
    assert {r["doc_id"] for r in results[4].collect()} == {i for i, _ in four}
    assert corpus_pipeline.run(spark, folder).exceptAll(results[4].select("*")).count() >= 0


def rows_of(spark, folder):
    return [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]


def test_an_empty_corpus_gives_an_empty_result(spark, tmp_path):
    write(spark, str(tmp_path), [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_all_operators_are_registered_with_their_columns(spark):
    want = {"op1_substring_dedup": "doc_id n_words n_removed kept_sha256", "op2_robust_outliers": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed distance kept",
            "op3_quality_classifier": "doc_id held_out score predicted", "op4_minhash_dedup": "doc_id n_shingles component_id kept",
            "op5_best_fit_packing": "doc_id piece start length ids_crc32 sequence_id offset", "op6_token_counts": "doc_id n_bytes n_tokens over_limit",
            "op7_chat_format": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
            "op8_class_lm": "doc_id held_out n_tokens n_known train_tokens base_score score", "op9_decontaminate": "doc_id n_words n_hit n_items items_sha256 contaminated",
            "op10_language_id": "doc_id held_out lang_pred score",
            "op11_tier_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
            "op12_periodic_runs": "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
            "op13_collocations": "lang rank phrase a l r n score"}
    assert set(queries.QUERIES) == set(want)
    for name in ("op1_substring_dedup", "op6_token_counts", "op9_decontaminate", "op10_language_id"):
        assert queries.QUERIES[name](spark, FOLDER).columns == want[name].split()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_oracle(spark, name):
    from oracle_check import connect, duck_rows, spark_rows
    assert spark_rows(queries.QUERIES[name](spark, FOLDER)) == duck_rows(connect(FOLDER), queries.ORACLES[name])
