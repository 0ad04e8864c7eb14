"""The three incremental rules on Structured Streaming."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..fixed import PAUSE_SECONDS, PAUSE_STEPS, STRIKES_BEFORE_PAUSE
from ..operators.upsert import latest, upsert
from ..session import checkpoint_folder

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STREAKS = "host string, seq bigint, strikes bigint, pause_seconds bigint"


class HostStreak(StatefulProcessor):
    """One number per host: failures since the last success."""

    def init(self, handle):
        self.strikes = handle.getValueState("strikes", "n bigint")

    def handleInputRows(self, key, rows, timerValues):
        held = self.strikes.get() if self.strikes.exists() else None
        count = held[0] if held else 0
        batch = pd.concat(list(rows)).sort_values(["ts", "seq"])
        counts = []
        for ok in batch["ok"]:
            count = 0 if ok else count + 1
            counts.append(count)
        self.strikes.update((count,))
        runs = pd.Series(counts, dtype="int64")
        steps = (runs - (STRIKES_BEFORE_PAUSE - 1)).clip(lower=0, upper=PAUSE_STEPS)
        yield pd.DataFrame({"host": key[0], "seq": batch["seq"].to_numpy(), "strikes": runs, "pause_seconds": steps * PAUSE_SECONDS})

    def close(self):
        pass


def host_streaks(log: DataFrame) -> DataFrame:
    """``log(host, ts, seq, ok)`` stream to running strikes; equals the batch job on the same rows.

    Within a micro-batch the rows of a host are put in time order; the batches themselves must
    arrive in order.  Keyed state of this kind needs the RocksDB state store.
    """
    log.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return log.groupBy("host").transformWithStateInPandas(
        HostStreak(), STREAKS, outputMode="append", timeMode="none")


def first_seen(entries: DataFrame, delay: str) -> DataFrame:
    """First row per ISBN within the watermark delay.

    State is bounded by the delay; a repeat later than that passes, which the batch rule never allows.
    """
    return entries.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["isbn13"])


BUCKETS = 64


def _manifest(spark: SparkSession, root: str, number: int) -> dict[int, int]:
    """Which batch wrote each bucket's latest rows, as of a batch; at most one row per bucket."""
    if number < 0:
        return {}
    return {r["bucket"]: r["batch"] for r in spark.read.parquet(f"{root}/manifest/number={number}").collect()}


def stored(spark: SparkSession, root: str, held: dict[int, int], like: DataFrame) -> DataFrame:
    """The rows of some buckets."""
    paths = [f"{root}/data/number={batch}/_bucket={bucket}" for bucket, batch in sorted(held.items())]
    return spark.read.schema(like.schema).parquet(*paths) if paths else like.limit(0)


def upsert_batches(spark: SparkSession, root: str, keys: list[str], order: list[str], buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` body that replaces stored records by key.

    Records lie in buckets by a hash of their key, and a batch writes new only the buckets it
    touches, beside the old ones; a small manifest per batch names each bucket's latest files.  A
    batch that is run again after a failure reads the same manifest and writes the same files.
    """
    def apply(batch: DataFrame, number: int) -> None:
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        new = latest(batch, keys, order).persist()
        held = _manifest(spark, root, number - 1)
        touched = {r[0] for r in new.select(bucket).distinct().collect()}
        merged = upsert(stored(spark, root, {b: held[b] for b in touched & held.keys()}, new), new, keys)
        merged.withColumn("_bucket", bucket).write.mode("overwrite").partitionBy("_bucket").parquet(f"{root}/data/number={number}")
        held |= dict.fromkeys(touched, number)
        (spark.createDataFrame(sorted(held.items()), "bucket int, batch bigint").coalesce(1)
         .write.mode("overwrite").parquet(f"{root}/manifest/number={number}"))
        new.unpersist()
    return apply


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, which every executor can reach."""
    return os.path.join(checkpoint_folder(spark), f"{name}-{uuid.uuid4().hex}")


def run_to_table(stream: DataFrame, schema, name: str) -> DataFrame:
    """Run a stream over what is there now and return the written table."""
    spark = stream.sparkSession
    root = scratch(spark, name)
    (stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state")
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(schema).parquet(f"{root}/out")


def run_upserts(stream: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Run the keyed upsert over what is there now and return the records."""
    spark = stream.sparkSession
    root = scratch(spark, name)
    done = [-1]
    apply = upsert_batches(spark, f"{root}/out", keys, order)

    def counted(batch: DataFrame, number: int) -> None:
        apply(batch, number)
        done.append(number)

    (stream.writeStream.foreachBatch(counted).option("checkpointLocation", f"{root}/state")
     .trigger(availableNow=True).start().awaitTermination())
    empty = spark.createDataFrame([], stream.schema)
    return stored(spark, f"{root}/out", _manifest(spark, f"{root}/out", max(done)), empty)


__all__ = ["HostStreak", "first_seen", "host_streaks", "run_to_table", "run_upserts", "upsert_batches"]
