"""Identifier lists: choose the column, validate, convert, de-duplicate, number, slice."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..fixed import ISBN_HEADER_GROUPS, LABEL_HEADERS
from ..functions import isbn
from ..functions.core import compute_once
from .skew import SPAN, first_per_key, numbered


def normalize_identifiers(df: DataFrame, raw: str, keep_10: bool = True) -> DataFrame:
    """Add ``code``, ``isbn13``, ``reason`` (and ``isbn10``) for a raw identifier column."""
    out = compute_once(df, code=isbn.normalize(F.col(raw)))
    out = (out.withColumn("isbn13", isbn.isbn13_of("code"))
           .withColumn("reason", isbn.reason_of(F.col(raw), "code")))
    return out.withColumn("isbn10", isbn.isbn10_of("isbn13")) if keep_10 else out


def is_header(cells: Column) -> Column:
    """A header row holds no identifier and at least one letter."""
    return (~F.exists(cells, isbn.is_valid)) & F.exists(cells, lambda c: F.coalesce(c, F.lit("")).rlike("[A-Za-z]"))


def choose_columns(rows: DataFrame, headers: list[str], sample_rows: int | None = None) -> tuple[int, int | None]:
    """Positions of the identifier column and of the label column (None without a fitting header).

    One query ranks the columns: the one with the best-known header if it holds identifiers, then
    by the number of identifiers, then that header alone, then by position.  ``sample_rows`` counts
    the first rows only; by default all are counted.
    """
    counted = rows if sample_rows is None else rows.orderBy("row").limit(sample_rows)
    valid = (counted.select(F.posexplode("cells").alias("pos", "cell")).groupBy("pos")
             .agg(F.count_if(isbn.is_valid(F.col("cell"))).alias("valid")))
    known = [(key, rank) for rank, group in enumerate(ISBN_HEADER_GROUPS) for key in group]
    spark = rows.sparkSession
    named = spark.createDataFrame(list(enumerate(headers)), "pos int, header string").withColumn("key", isbn.header_key(F.col("header")))
    rank = F.coalesce(*[F.when(F.col("key") == key, F.lit(i)) for key, i in known])
    best = F.min(F.struct(F.coalesce("rank", F.lit(len(known))), "pos")).over(W.partitionBy())
    ranked = (valid.join(named.withColumn("rank", rank).withColumn("is_label", F.col("key").isin(LABEL_HEADERS)), "pos", "full")
              .withColumn("named", F.col("rank").isNotNull() & (best["pos"] == F.col("pos"))).withColumn("valid", F.coalesce("valid", F.lit(0))))
    order = F.when(F.col("named") & (F.col("valid") > 0), 0).when(F.col("valid") > 0, 1).when(F.col("named"), 2).otherwise(3)
    # one row per column of the list
    columns = ranked.select("pos", F.coalesce("is_label", F.lit(False)).alias("is_label")).orderBy(order, F.desc("valid"), "pos").collect()
    chosen = columns[0]["pos"]
    return chosen, min((c["pos"] for c in columns if c["is_label"] and c["pos"] != chosen), default=None)


@dataclass
class Ingested:
    """Three outputs of one list: usable entries, refused rows, one summary row."""

    entries: DataFrame
    problems: DataFrame
    summary: DataFrame

    def with_problems(self, more: DataFrame) -> Ingested:
        """Refused rows found elsewhere, listed and counted."""
        counts = self.summary.unionByName(more.agg(F.lit(0).cast("bigint").alias("entries"), F.lit(0).cast("bigint").alias("duplicates"), F.count(F.lit(1)).alias("skipped")))
        return Ingested(self.entries, self.problems.unionByName(more), counts.agg(*[F.sum(c).alias(c) for c in self.summary.columns]))


def ingest(rows: DataFrame, column: str = "column 1") -> Ingested:
    """``rows(row, raw, label)`` to entries, problems and summary.

    The normalised rows feed three outputs; callers that write all three should persist
    ``rows`` first.
    """
    checked = normalize_identifiers(rows, "raw", keep_10=False)
    reason = F.when(F.coalesce(F.col("raw"), F.lit("")) == "", F.lit(f"{column} is empty")).otherwise(F.col("reason"))
    valid = checked.where(F.col("isbn13").isNotNull())
    entries = first_per_key(valid, ["isbn13"], ["row"]).select(
        "isbn13", "row", F.nullif("label", F.lit("")).alias("label"))
    problems = (checked.where(F.col("isbn13").isNull()).select("row", reason.alias("reason")))
    return Ingested(entries, problems, summarise(checked))


def summarise(checked: DataFrame) -> DataFrame:
    """Entries, duplicates and refused rows in one pass."""
    distinct = F.count_distinct("isbn13")
    return checked.agg(distinct.alias("entries"),
                       (F.count("isbn13") - distinct).alias("duplicates"),
                       F.count_if(F.col("isbn13").isNull()).alias("skipped"))


def row_slice(entries: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Entries ``[start, end)`` by dense position in file order; slices tile exactly."""
    placed = numbered(entries, [], F.col("row") / SPAN, ["row"], "position", start=0)
    low = max(0, start or 0)
    wanted = F.col("position") >= low
    return placed.where(wanted if end is None else wanted & (F.col("position") < max(low, end)))


def literal_entry(spark, raw: str) -> DataFrame:
    """A list of one identifier given directly."""
    rows = spark.createDataFrame([(0, raw)], "row bigint, raw string")
    return normalize_identifiers(rows, "raw").select("isbn13", "row", F.lit(None).cast("string").alias("label"), "reason")
