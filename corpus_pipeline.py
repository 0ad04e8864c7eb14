"""From raw documents to packed training sequences.

Five stages, in order: the quality classifier drops what it rejects; of each group of
near-duplicates one document stays; passages that repeat across documents are cut; benchmark
phrases are cut; what is left is packed.  Each stage is written as Parquet and read again before
the next, so a lost executor or driver costs one stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeweave.llm import decontaminate, minhash_dedup, pack, quality_classifier, substring_dedup
from tomeweave.llm._store import Scratch, small_batches
from tomeweave.llm.queries import word_bpe

REPEAT_WORDS, BENCHMARK_WORDS, CAPACITY, END_ID = 50, 10, 4096, 1
WORD = r"[^\x20\x09-\x0D]"
_open: list[Scratch] = []


def _scratch(spark: SparkSession, name: str) -> Scratch:
    """A stage's own tables; those of the stage before, whose result is written by now, go."""
    while _open:
        _open.pop().drop()
    small_batches(spark)
    _open.append(Scratch(spark, name))
    return _open[-1]


def _retexted(cut: DataFrame, gone: str, docs: DataFrame) -> DataFrame:
    """``cut(rest, text, gone)`` as documents; a text that lost all its words goes.

    Where words are gone, ``n_chars`` follows the text.
    """
    n_chars = F.when(F.col(gone) > 0, F.length("text").cast("bigint")).otherwise(F.col("rest.n_chars"))
    out = {"text": F.col("text"), "n_chars": n_chars}
    left = cut.where((F.col(gone) == 0) | F.col("text").rlike(WORD))
    return left.select(*[(out[c] if c in out else F.col("rest")[c]).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    _scratch(spark, "quality")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality_classifier.quality_scores(docs, labels, keep=tuple(docs.columns))
    return scored.where("predicted = 1").select("kept.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8."""
    return minhash_dedup.without_near_duplicates(docs, k=5, percent=80, scratch=_scratch(spark, "near-duplicates"))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of ``REPEAT_WORDS`` words or more that stand anywhere else."""
    rest = tuple(c for c in docs.columns if c != "text")
    found = substring_dedup.substring_dedup(docs, REPEAT_WORDS, keep=rest, rejoin=False, scratch=_scratch(spark, "repeats"))
    return _retexted(found.select(F.col("kept").alias("rest"), F.col("kept_text").alias("text"), "n_removed"), "n_removed", docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the phrases of ``BENCHMARK_WORDS`` words of benchmark items."""
    _scratch(spark, "benchmark")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _retexted(decontaminate.remove_contamination(docs, benchmark, BENCHMARK_WORDS), "n_hit", docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most ``CAPACITY`` tokens, a row per piece."""
    return pack.pack(docs, word_bpe(), CAPACITY, END_ID, scratch=_scratch(spark, "pack"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good_quality), ("near-duplicates", one_of_each_group), ("substring dedup", without_repeats),
    ("benchmark decontamination", without_benchmark), ("best-fit packing", packed)]

#: Training, connected components and packing are beyond SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``."""
    docs, tables = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = tables.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
