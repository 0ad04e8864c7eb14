"""Per-source ISBN sets and the rules that change them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["source", "kind", "isbn13"]


def merge(on_disk: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply ``changes(source, kind, isbn13, op, seq)`` to the stored sets.

    The last change of a key decides; keys without a change stay.  One aggregation over the
    union does it, and it combines map-side.
    """
    both = on_disk.select(*KEYS, F.lit("note").alias("op"), F.lit(None).cast("bigint").alias("seq")).unionByName(
        changes.select(*KEYS, "op", "seq"))
    last = F.max_by("op", F.struct(F.col("seq").isNotNull(), "seq", "op"))
    return both.groupBy(*KEYS).agg(last.alias("op")).where("op = 'note'").select(*KEYS)


def newly_noted(on_disk: DataFrame, changes: DataFrame) -> DataFrame:
    """Keys the changes added that were not stored before, counted per source and kind."""
    added = changes.groupBy(*KEYS).agg(F.max_by("op", F.struct("seq", "op")).alias("op")).where("op = 'note'")
    return (added.join(on_disk.select(*KEYS).distinct(), KEYS, "left_anti")
            .groupBy("source", "kind").agg(F.count(F.lit(1)).alias("recorded")))


def changes_from_outcomes(outcomes: DataFrame) -> DataFrame:
    """A trustworthy empty is an absence; an incomplete record stays to do; a complete one leaves.

    A pair can yield at most one row per kind.
    """
    rows = F.array(
        F.when((F.col("status") == "empty") & F.col("trustworthy"),
               F.struct(F.lit("no_data").alias("kind"), F.lit("note").alias("op"))),
        F.when(F.col("incomplete"), F.struct(F.lit("incomplete").alias("kind"), F.lit("note").alias("op")))
        .when(F.col("has_metadata"), F.struct(F.lit("incomplete").alias("kind"), F.lit("discard").alias("op"))))
    return (outcomes.where("status <> 'skipped'")
            .select("source", "isbn13", "seq", F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r"))
            .select("source", "r.kind", "isbn13", "r.op", "seq"))


def missing_covers(records: DataFrame, covers: DataFrame) -> DataFrame:
    """Records that have no stored cover, as ledger notes."""
    have = covers.select("isbn13", "source").distinct()
    return (records.where(F.trim("isbn13") != "").select("isbn13", "source").distinct()
            .join(have, ["isbn13", "source"], "left_anti")
            .select("source", F.lit("incomplete").alias("kind"), "isbn13", F.lit("note").alias("op")))
