"""Run reports as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUSES = ["ok", "partial", "empty", "blocked", "error", "skipped"]


def per_source(outcomes: DataFrame) -> DataFrame:
    """Seen, metadata, reviews, covers and a count per status, by source."""
    return outcomes.groupBy("source").agg(
        F.count(F.lit(1)).alias("seen"), F.count_if(F.col("has_metadata")).alias("metadata"),
        F.sum("reviews").cast("bigint").alias("reviews"), F.sum("covers").cast("bigint").alias("covers"),
        *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


def rates(outcomes: DataFrame) -> DataFrame:
    """Success rate and mean seconds per source over the pairs that were attempted."""
    tried = outcomes.where("status <> 'skipped'").groupBy("source").agg(
        F.count_if(F.col("has_metadata")).alias("succeeded"), F.count(F.lit(1)).alias("attempted"),
        F.sum("seconds").alias("_seconds"))
    return tried.select(
        "source", "succeeded", "attempted",
        F.round(100.0 * F.col("succeeded") / F.greatest(F.lit(1), "attempted"), 4).alias("rate"),
        F.round(F.col("_seconds") / F.greatest(F.lit(1), "attempted"), 4).alias("mean_seconds"))


def totals(outcomes: DataFrame) -> DataFrame:
    """One row for the run; books first, so a book counts once whatever its sources say."""
    books = outcomes.groupBy("isbn13").agg(
        F.max("has_metadata").alias("_has"), F.sum("reviews").alias("_r"), F.sum("covers").alias("_c"),
        F.count_if(F.col("incomplete")).alias("_i"),
        F.count_if((F.col("status") == "empty") & ~F.col("trustworthy")).alias("_u"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return books.agg(
        F.count(F.lit(1)).alias("books"), F.count_if("_has").alias("with_metadata"),
        F.count_if(~F.col("_has")).alias("failed"), (zero("_r") + zero("_c")).alias("files"),
        zero("_r").alias("reviews"), zero("_c").alias("covers"), zero("_i").alias("incomplete"),
        zero("_u").alias("untrusted_empty"))


def skips(outcomes: DataFrame) -> DataFrame:
    return (outcomes.where("status = 'skipped'").groupBy("source")
            .agg(F.count(F.lit(1)).alias("skipped")))


def blocked_sources(outcomes: DataFrame) -> DataFrame:
    """Names of the sources that met a wall, one sorted list (there are few sources)."""
    names = outcomes.where("status = 'blocked'").groupBy("source").agg(F.count(F.lit(1)).alias("pairs"))
    return names.agg(F.array_join(F.sort_array(F.collect_list("source")), ", ").alias("blocked"))


def failure_reason() -> Column:
    """The most specific account of why nothing came back."""
    return (F.when(F.col("status") == "blocked", F.lit("the site was blocking automated access"))
            .when(~F.col("trustworthy"), F.lit("no host was successfully reached"))
            .otherwise(F.coalesce(F.get("warnings", 0), F.lit("no metadata parsed from the page"))))


def detail_rows(outcomes: DataFrame) -> DataFrame:
    """Attempted pairs by section (failed, untrusted, succeeded) with a reason for failures."""
    section = (F.when(F.col("has_metadata"), F.lit("succeeded"))
               .when(F.col("trustworthy"), F.lit("failed")).otherwise(F.lit("untrusted")))
    rank = F.when(section == "failed", 1).when(section == "untrusted", 2).otherwise(3)
    return outcomes.where("status <> 'skipped'").select(
        "source", "pos", "isbn13", section.alias("section"), rank.alias("section_rank"), "status",
        F.when(~F.col("has_metadata"), failure_reason()).alias("reason"))


def run_state(outcomes: DataFrame) -> DataFrame:
    """Success when anything was found, or when there was nothing left to ask."""
    seen = F.count(F.lit(1)) > 0
    good = F.coalesce(F.bool_or("has_metadata"), F.lit(False)) | (
        seen & F.coalesce(F.bool_and(F.col("status") == "skipped"), F.lit(False)))
    return outcomes.agg(F.when(good, F.lit(0)).otherwise(F.lit(1)).alias("exit_code"))
