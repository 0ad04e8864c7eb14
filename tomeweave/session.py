"""Session settings the jobs rely on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Settings that change results: a repeated JSON key keeps its last value."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a local one only where none is named."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if current:
        return current
    if named is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="checkpoint-")
    context.setCheckpointDir(named)
    return named
