"""Streaming queries over the event table; each must equal its batch rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import incremental
from .base import Catalog, Tables
from .derive import fetch_log
from .runs import _STREAK_SQL

catalog = Catalog()


class _Streamed(Tables):
    """Tables whose ``events`` arrive as a stream."""

    @property
    def events(self):
        schema = self.spark.read.parquet(f"{self.folder}/events.parquet").schema
        return self.spark.readStream.schema(schema).parquet(f"{self.folder}/events.parque*")


def _stream(t: Tables):
    return _Streamed(t.spark, t.folder)


@catalog.query(f"WITH {_STREAK_SQL} SELECT host, seq, strikes, CAST(CASE WHEN strikes < 3 THEN 0 ELSE 30 * least(strikes - 2, 4) END AS BIGINT) AS pause_seconds FROM runs")
def stream_streaks(t: Tables):
    log = fetch_log(_stream(t)).select("host", "ts", "seq", "ok")
    return incremental.run_to_table(incremental.host_streaks(log), incremental.STREAKS, "streaks")


@catalog.query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def stream_upsert(t: Tables):
    records = _stream(t).events.select("user_id", "event_id", "event_type", "ts")
    return incremental.run_upserts(records, ["user_id"], ["ts", "event_id"], "upsert").select("user_id", "event_id", "event_type")


@catalog.query("SELECT DISTINCT 'b' || (event_id % 313) AS isbn13 FROM events")
def stream_dedupe(t: Tables):
    entries = _stream(t).events.select(F.expr("concat('b', event_id % 313)").alias("isbn13"), F.col("ts").cast("timestamp").alias("ts"))
    return incremental.run_to_table(incremental.first_seen(entries, "1 day").select("isbn13"), "isbn13 string", "dedupe")
