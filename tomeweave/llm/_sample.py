"""Fixed splits and bounded samples of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_col: str, n: int) -> Column:
    """``crc32`` of the id as text modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def bounded(rows: DataFrame, keys: list[str], n: int, seed: int = 7) -> DataFrame:
    """The rows whose keys have the ``n`` least hashes; the same for any partitioning.

    Only keys are ordered, so no text moves; the ``n`` kept keys are a small side of a join.
    """
    marked = rows.withColumn("_draw", F.xxhash64(F.lit(seed), *keys))
    kept = marked.select("_draw").distinct().orderBy("_draw").limit(n)
    return marked.join(F.broadcast(kept), "_draw", "left_semi").drop("_draw")
