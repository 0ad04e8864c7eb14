"""Host health: failure streaks, pauses, limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..fixed import HOST_LIMITS, PAUSE_SECONDS, PAUSE_STEPS, STRIKES_BEFORE_PAUSE
from .skew import NO_ORDER, SPAN, null_safe_join


def pause_seconds(strikes: Column) -> Column:
    """Pause after a run of failures: none below the threshold, then growing, then flat."""
    steps = F.least(strikes - (STRIKES_BEFORE_PAUSE - 1), F.lit(PAUSE_STEPS))
    return F.when(strikes < STRIKES_BEFORE_PAUSE, F.lit(0)).otherwise(steps * PAUSE_SECONDS).cast("bigint")


def streaks(log: DataFrame, width_seconds: int = 60) -> DataFrame:
    """Consecutive failures of each host up to each row: ``log(host, ts, seq, ok)``.

    A row's streak is its distance in failures to the host's latest success, so two numbers do:
    failures so far, and their value at the latest success.  Both run in buckets of
    ``width_seconds``.  A null host is a host of its own; rows without a time come first.
    """
    at = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / width_seconds)
    failed = (~F.coalesce("ok", F.lit(False))).cast("bigint")
    spread = log.withColumn("_bucket", F.coalesce(at.cast("bigint"), F.lit(NO_ORDER)))
    rows = W.partitionBy("host", "_bucket").orderBy("ts", "seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    inner = (spread.withColumn("_failures", F.sum(failed).over(rows))
             .withColumn("_cleared", F.max(F.when(F.col("ok"), F.col("_failures"))).over(rows)))
    sums = inner.groupBy("host", "_bucket").agg(F.max("_failures").alias("_all"), F.max("_cleared").alias("_last"))
    # the open streak behind each bucket: a bucket with a success starts it anew
    carried = open_streaks(sums)
    joined = null_safe_join(inner, carried, ["host", "_bucket"])
    streak = F.when(F.col("_cleared").isNotNull(), F.col("_failures") - F.col("_cleared")).otherwise(F.col("_failures") + F.col("_carry"))
    return joined.withColumn("strikes", streak.cast("bigint")).drop("_bucket", "_failures", "_cleared", "_carry")


def open_streaks(sums: DataFrame) -> DataFrame:
    """Failures since the latest success before each bucket, over spans of buckets and then within them."""
    def closed(over: W, total: str, last: str) -> Column:
        """Open streak behind the rows of a frame: all failures, less those up to the last success."""
        return F.coalesce(F.sum(total).over(over), F.lit(0)) - F.coalesce(F.max(F.col(last)).over(over), F.lit(0))

    near = W.partitionBy("host", "_span").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    far = W.partitionBy("host").orderBy("_span").rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy("host", "_span").orderBy("_bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    marked = (sums.withColumn("_span", F.floor(F.col("_bucket") / SPAN).cast("bigint"))
              .withColumn("_clear", F.sum("_all").over(upto) - F.col("_all") + F.col("_last")))
    inside = marked.withColumn("_near", closed(near, "_all", "_clear")).withColumn("_reset", F.max("_clear").over(near).isNotNull())
    spans = (marked.groupBy("host", "_span").agg(F.sum("_all").alias("_all"), F.max("_clear").alias("_last"))
             .withColumn("_clear", F.sum("_all").over(W.partitionBy("host").orderBy("_span").rowsBetween(W.unboundedPreceding, W.currentRow))
                         - F.col("_all") + F.col("_last"))
             .withColumn("_far", closed(far, "_all", "_clear")).select("host", "_span", "_far"))
    return null_safe_join(inside, spans, ["host", "_span"]).select(
        "host", "_bucket", (F.col("_near") + F.when(F.col("_reset"), F.lit(0)).otherwise(F.col("_far"))).alias("_carry"))


def host_limits(host: Column, low: float, high: float, timeout: int,
                limits: list[tuple] = HOST_LIMITS) -> Column:
    """Limits of the longest listed domain the host belongs to, else the defaults."""
    pack = lambda a, b, c: F.struct(F.lit(a).cast("double").alias("min_delay"),
                                    F.lit(b).cast("double").alias("max_delay"), F.lit(c).cast("int").alias("timeout"))
    out = None
    for domain, a, b, c in sorted(limits, key=lambda r: -len(r[0])):
        test = (host == domain) | F.endswith(host, F.lit("." + domain))
        out = F.when(test, pack(a, b, c)) if out is None else out.when(test, pack(a, b, c))
    default = pack(low, high, timeout)
    return default if out is None else out.otherwise(default)
