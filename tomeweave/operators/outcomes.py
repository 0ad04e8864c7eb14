"""What a (book, source) pass amounted to: status, trust, field completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import RECORD_FIELDS
from ..functions.lists import genre_text
from .skew import carry_forward


def field_present(df: DataFrame, name: str) -> Column:
    kind = dict(df.dtypes)[name]
    column = F.col(name)
    return F.coalesce(F.size(column) > 0 if kind.startswith("array") else column != "", F.lit(False))


def completeness(records: DataFrame) -> DataFrame:
    """Add ``found`` and ``missing``: which of the seven fields have a value."""
    marks = F.array(*[F.struct(F.lit(f).alias("name"), field_present(records, f).alias("present"))
                      for f in RECORD_FIELDS])
    pick = lambda want: F.transform(F.filter(marks, lambda m: m["present"] == want),
                                    lambda m: m["name"])
    return records.withColumns({"found": pick(True), "missing": pick(False)})


def completeness_report(records: DataFrame) -> DataFrame:
    """Found and missing counts per field, by one pass and a final unpivot."""
    sums = records.agg(F.count(F.lit(1)).alias("_n"), *[
        F.count_if(field_present(records, f)).alias(f) for f in RECORD_FIELDS])
    pairs = ", ".join(f"'{f}', {f}" for f in RECORD_FIELDS)
    return (sums.select("_n", F.expr(f"stack({len(RECORD_FIELDS)}, {pairs}) as (field, found)"))
            .select("field", "found", (F.col("_n") - F.col("found")).alias("missing")))


def canonical(records: DataFrame) -> DataFrame:
    """The eight-field record: genres as one text, null when there are none."""
    return records.select("isbn13", "title", "authors", "publisher", "origin", "date_of_publication",
                          "language", genre_text(F.col("genres")).alias("genre"))


def classify(passes: DataFrame) -> DataFrame:
    """Add ``status`` and ``trustworthy``.

    ``passes`` has has_metadata, has_payload, block_reason, responded_hosts, missing, warnings
    and optionally ``failed`` (the pass itself broke) and ``skip_reason``.
    """
    column = lambda name, default: F.col(name) if name in passes.columns else default
    failed, skip = column("failed", F.lit(False)), column("skip_reason", F.lit(None).cast("string"))
    blocked = F.col("block_reason").isNotNull()
    nothing = ~F.col("has_metadata") & ~F.col("has_payload")
    flawed = (F.size("missing") > 0) | (F.size("warnings") > 0)
    status = (F.when(skip.isNotNull(), F.lit("skipped")).when(failed, F.lit("error"))
              .when(nothing & blocked, F.lit("blocked")).when(nothing, F.lit("empty"))
              .when(flawed, F.lit("partial")).otherwise(F.lit("ok")))
    trust = (F.when(failed, F.lit(False))
             .when(skip.isNull() & nothing, ~blocked & (F.col("responded_hosts") > 0)).otherwise(F.lit(True)))
    return passes.withColumns({"status": status, "trustworthy": trust})


def block_registry(log: DataFrame, width_seconds: int = 60) -> DataFrame:
    """Fetch log with the host's latest block reason so far; a later success clears nothing.

    ``log(host, ts, seq, block_reason, ...)``.
    """
    hour = F.unix_seconds(F.col("ts").cast("timestamp")) / width_seconds
    return carry_forward(log, ["host"], hour, ["ts", "seq"], F.col("block_reason"), "registered")


def pair_summary(log: DataFrame, width_seconds: int = 60) -> DataFrame:
    """Per (book, source): hosts attempted, hosts that responded, and the block reason of the
    alphabetically first contacted host that is registered when the pair ends.

    ``log(isbn13, source, host, ts, seq, responded, block_reason)``.  Each pair asks the
    registry once per host, at the pair's last fetch, so questions ride along with the log.
    """
    pair = ["isbn13", "source"]
    contacts = log.groupBy(*pair, "host").agg(
        F.max(F.struct("ts", "seq")).alias("_end"), F.max(F.col("responded")).alias("_responded"))
    ends = contacts.groupBy(*pair).agg(F.max("_end").alias("_pair_end"))
    asks = contacts.join(ends, pair).select(
        *pair, "host", F.col("_pair_end.ts").alias("ts"), F.col("_pair_end.seq").alias("seq"),
        F.lit(1).alias("_ask"), "_responded", F.lit(None).cast("string").alias("block_reason"))
    facts = log.where(F.col("block_reason").isNotNull()).select(
        *pair, "host", "ts", "seq", F.lit(0).alias("_ask"), F.lit(None).cast("boolean").alias("_responded"),
        "block_reason")
    hour = F.unix_seconds(F.col("ts").cast("timestamp")) / width_seconds
    told = carry_forward(facts.unionByName(asks), ["host"], hour, ["ts", "seq", "_ask"],
                         F.col("block_reason"), "registered").where("_ask = 1")
    return told.groupBy(*pair).agg(
        F.count(F.lit(1)).alias("attempted_hosts"),
        F.count_if(F.col("_responded")).alias("responded_hosts"),
        F.min_by("registered", F.when(F.col("registered").isNotNull(), F.col("host"))).alias("block_reason"))
