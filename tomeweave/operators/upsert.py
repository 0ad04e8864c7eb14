"""Keyed metadata: latest version per key, and replace by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import first_per_key

KEYS = ["source", "isbn13"]


def latest(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest record of each key of an append log."""
    return first_per_key(log, keys, [F.col(c).desc() for c in order])


def upsert(stored: DataFrame, new: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Stored records with the new ones added or put in place by key.

    ``new`` has one row per key (see :func:`latest`).
    """
    kept = stored.join(new.select(*keys), keys, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)
