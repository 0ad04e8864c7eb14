"""Per-key operators that hold when one key owns a third of all rows.

* *First / top-k per key* filter on ``row_number`` directly, so Spark places a partial group
  limit before the shuffle: a hot key sends at most k rows per map task.
* *Numbering* and *carry forward* work over ``(key, bucket)``: rows are spread by bucket, and only
  one summary row per bucket goes on.  Summaries are spread again by spans of buckets, so no
  window holds all buckets of a key.

No row is lost: null keys are a key of their own, and rows without an order value form a bucket
before all others.  Joins on a key that may be hot are plain joins, which adaptive execution
splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SPAN = 1 << 16
#: Bucket of rows without an order value; below every bucket of a real one, as nulls sort first.
NO_ORDER = -(1 << 62)


#: Rows of a task where each costs milliseconds: parsing, JSON, text ratios.
TASK_ROWS = 2000


def spread_rows(df: DataFrame) -> DataFrame:
    """The same rows, dealt evenly over tasks of about ``TASK_ROWS``.

    Readers cut files by bytes, so a table of short rows is one task even where each row then
    becomes a page to parse.  Call it on the short rows, before they grow.
    """
    return df.repartition(-(-df.count() // TASK_ROWS) or 1)


def null_safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join whose null keys meet; the right side's keys are dropped."""
    other = right.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns])
    same = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on]
    return left.join(other, same, how).drop(*[f"_r_{c}" for c in on])


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return top_per_key(df, keys, order, 1).drop("_rank")


def top_per_key(df: DataFrame, keys: list[str], order: list, k: int, rank: str = "_rank") -> DataFrame:
    """The first ``k`` rows of each key with their 1-based rank."""
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def _spread(df: DataFrame, bucket: Column) -> DataFrame:
    return df.withColumn("_bucket", F.coalesce(F.floor(bucket).cast("bigint"), F.lit(NO_ORDER)))


def _span() -> Column:
    return F.floor(F.col("_bucket") / SPAN).cast("bigint")


def _before(keys: list[str], order: str, *more: str):
    window = W.partitionBy(*keys, *more) if keys or more else W
    return window.orderBy(order).rowsBetween(W.unboundedPreceding, -1)


def _offsets(sizes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows before each bucket of a key; two levels, so no window sees all buckets."""
    sized = sizes.withColumn("_span", _span())
    spans = (sized.groupBy(*keys, "_span").agg(F.sum("_rows").alias("_rows"))
             .withColumn("_far", F.coalesce(F.sum("_rows").over(_before(keys, "_span")), F.lit(0))).drop("_rows"))
    near = sized.withColumn("_near", F.coalesce(F.sum("_rows").over(_before(keys, "_bucket", "_span")), F.lit(0)))
    return null_safe_join(near, spans, [*keys, "_span"]).select(*keys, "_bucket", (F.col("_near") + F.col("_far")).alias("_offset"))


def numbered(df: DataFrame, keys: list[str], bucket: Column, order: list, name: str = "n",
             start: int = 1) -> DataFrame:
    """Dense numbering per key in ``order``.

    ``bucket`` is a whole number that grows with ``order`` and keeps one bucket small enough
    for a task (a position divided by a width, an hour number); null where the order value is.
    """
    spread = _spread(df, bucket)
    sizes = spread.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    inside = W.partitionBy(*keys, "_bucket").orderBy(*order)
    placed = null_safe_join(spread.withColumn("_at", F.row_number().over(inside)), _offsets(sizes, keys), [*keys, "_bucket"])
    return (placed.withColumn(name, (F.col("_at") + F.col("_offset") + (start - 1)).cast("bigint"))
            .drop("_bucket", "_at", "_offset"))


def carry_forward(df: DataFrame, keys: list[str], bucket: Column, order: list[str], value: Column,
                  name: str) -> DataFrame:
    """Latest non-null ``value`` of a key up to and including each row."""
    spread = _spread(df, bucket).withColumn("_value", value)
    latest = F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(*order)))
    sums = spread.groupBy(*keys, "_bucket").agg(latest.alias("_latest")).withColumn("_span", _span())
    spans = (sums.groupBy(*keys, "_span").agg(F.max_by("_latest", F.when(F.col("_latest").isNotNull(), F.col("_bucket"))).alias("_far"))
             .withColumn("_far", F.last("_far", True).over(_before(keys, "_span"))))
    near = sums.withColumn("_near", F.last("_latest", True).over(_before(keys, "_bucket", "_span")))
    carried = null_safe_join(near, spans, [*keys, "_span"]).select(*keys, "_bucket", F.coalesce("_near", "_far").alias("_carry"))
    inside = (W.partitionBy(*keys, "_bucket").orderBy(*order)
              .rowsBetween(W.unboundedPreceding, W.currentRow))
    seen = spread.withColumn("_seen", F.last("_value", True).over(inside))
    return (null_safe_join(seen, carried, [*keys, "_bucket"]).withColumn(name, F.coalesce("_seen", "_carry"))
            .drop("_bucket", "_value", "_seen", "_carry"))


def _composed(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """For rows that each map state 0 to ``_f0`` and state 1 to ``_f1``: what all rows of a key up to each one do together (``_h``).

    Behind the last row that forgets the state (both give the same) only the swaps count.
    """
    upto = (W.partitionBy(*keys) if keys else W).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    swaps = df.withColumn("_swaps", F.sum(((F.col("_f0") == 1) & (F.col("_f1") == 0)).cast("int")).over(upto))
    reset = F.when(F.col("_f0") == F.col("_f1"), F.struct(F.col("_f0").alias("state"), F.col("_swaps").alias("at")))
    reset = F.last(reset, True).over(upto)
    known = (reset["state"] + F.col("_swaps") - reset["at"]) % 2
    odd = F.col("_swaps") % 2
    return swaps.withColumn("_h", F.struct(F.coalesce(known, odd).cast("int").alias("f0"), F.coalesce(known, 1 - odd).cast("int").alias("f1"))).drop("_swaps")


def _applied(function: Column, state: Column) -> Column:
    """A missing function keeps the state."""
    return F.coalesce(F.when(state == 0, function["f0"]).otherwise(function["f1"]), state)


def state_before(df: DataFrame, keys: list[str], bucket: Column, order: list[str], from_0: Column, from_1: Column, name: str) -> DataFrame:
    """The state (0 or 1, at first 0) in which each row of a key is reached.

    ``from_0`` and ``from_1`` are the states behind a row that is reached in 0 and in 1.  Rows are
    composed within their bucket, buckets within a span, and spans: a row's function is its own,
    whatever comes before it, so no task sees a whole key.
    """
    rows = _composed(_spread(df, bucket).withColumns({"_f0": from_0.cast("int"), "_f1": from_1.cast("int")}), [*keys, "_bucket"], order)
    rows = rows.withColumn("_own", F.lag("_h").over(W.partitionBy(*keys, "_bucket").orderBy(*order)))
    sums = rows.groupBy(*keys, "_bucket").agg(F.max_by("_h", F.struct(*order)).alias("_h")).withColumn("_span", _span())
    sums = _composed(sums.select(*keys, "_bucket", "_span", F.col("_h")["f0"].alias("_f0"), F.col("_h")["f1"].alias("_f1")), [*keys, "_span"], ["_bucket"])
    near = sums.withColumn("_near", F.lag("_h").over(W.partitionBy(*keys, "_span").orderBy("_bucket")))
    spans = sums.groupBy(*keys, "_span").agg(F.max_by("_h", "_bucket").alias("_h"))
    spans = _composed(spans.select(*keys, "_span", F.col("_h")["f0"].alias("_f0"), F.col("_h")["f1"].alias("_f1")), keys, ["_span"])
    spans = spans.withColumn("_far", F.lag("_h").over((W.partitionBy(*keys) if keys else W).orderBy("_span")))
    entry = null_safe_join(near.select(*keys, "_bucket", "_span", "_near"), spans.select(*keys, "_span", "_far"), [*keys, "_span"]).drop("_span")
    joined = null_safe_join(rows, entry, [*keys, "_bucket"])
    state = _applied(F.col("_own"), _applied(F.col("_near"), _applied(F.col("_far"), F.lit(0))))
    return joined.withColumn(name, state).drop("_bucket", "_f0", "_f1", "_h", "_own", "_near", "_far")
