"""A registered query: the Spark job over the given tables and, where SQL can say it, its oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """The given tables of one folder, read on demand."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


@dataclass
class Catalog:
    """Queries by name with their oracles."""

    jobs: dict[str, Callable[[Tables], DataFrame]] = field(default_factory=dict)
    oracles: dict[str, str] = field(default_factory=dict)

    def query(self, sql: str | None = None):
        def register(job: Callable[[Tables], DataFrame]):
            name = job.__name__
            self.jobs[name] = job
            if sql is not None:
                self.oracles[name] = sql
            return job
        return register
