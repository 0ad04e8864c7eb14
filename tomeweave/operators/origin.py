"""Place of publication: layered probe results, and back-fill across sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import let


def probe(layers: list[tuple[str, Column, Column]]) -> Column:
    """``struct<origin, searched>`` of ``(name, present, place)`` layers, best layer first.

    A layer counts as searched when it was present and no earlier layer had an answer.
    """
    packed = F.filter(F.array(*[
        F.struct(F.lit(name).alias("name"), F.coalesce(present, F.lit(False)).alias("present"), place.alias("place"))
        for name, present, place in layers]), lambda x: x["present"])

    def judge(seen: Column) -> Column:
        at = F.array_position(F.transform(seen, lambda x: x["place"].isNotNull()), True).cast("int")
        upto = F.when(at > 0, at).otherwise(F.size(seen))
        return F.struct(F.when(at > 0, F.try_element_at(seen, at)["place"]).alias("origin"),
                        F.transform(F.slice(seen, F.lit(1), upto), lambda x: x["name"]).alias("searched"))

    return let(packed, judge)


def searched_text(searched: Column) -> Column:
    """The layers as an English list, or the sentence for none."""
    size = F.size(searched)
    return (F.when(size == 0, F.lit("no parsed layer was available to search on this run"))
            .when(size == 1, F.get(searched, 0))
            .otherwise(F.concat(F.array_join(F.slice(searched, F.lit(1), size - 1), ", "), F.lit(" and "),
                                F.element_at(searched, -1))))


def is_unset(origin: Column) -> Column:
    return origin.isNull() | origin.isin("", "None")


def origin_map(records: DataFrame) -> DataFrame:
    """ISBN to origin; the last record of an ISBN that has one wins.  ``records(isbn13, origin, pos)``."""
    usable = records.where(~is_unset(F.col("origin")) & (F.coalesce("isbn13", F.lit("")) != ""))
    return usable.groupBy("isbn13").agg(F.max_by("origin", "pos").alias("origin"), F.min("pos").alias("first_pos"))


def coverage(records: DataFrame, origins: DataFrame) -> DataFrame:
    """Totals, share with an origin (0 for an empty table) and distinct spellings, one row."""
    facts = records.select(F.lit(None).cast("string").alias("origin")).unionByName(origins.select("origin"))
    known = F.count("origin")
    total = F.count(F.lit(1)) - known
    share = F.when(total > 0, F.round(100.0 * known / total, 1)).otherwise(F.lit(0.0))
    return facts.agg(total.alias("total"), known.alias("with_origin"),
                     F.count_distinct("origin").alias("spellings"), share.alias("percent"))


def top_spellings(origins: DataFrame, k: int = 5) -> DataFrame:
    """The most frequent spellings; ties in first-seen order."""
    return (origins.groupBy("origin").agg(F.count(F.lit(1)).alias("books"), F.min("first_pos").alias("_pos"))
            .orderBy(F.desc("books"), "_pos").limit(k).drop("_pos"))


def backfill(targets: DataFrame, origins: DataFrame, overwrite: bool = False) -> DataFrame:
    """Targets with the origin filled in, and what was done: fill, keep or absent."""
    joined = targets.join(origins.select("isbn13", F.col("origin").alias("_new")), "isbn13", "left")
    action = (F.when(F.col("_new").isNull(), F.lit("absent"))
              .when(is_unset(F.col("origin")) | F.lit(overwrite), F.lit("fill")).otherwise(F.lit("keep")))
    return (joined.withColumn("action", action)
            .withColumn("origin", F.when(F.col("action") == "fill", F.col("_new")).otherwise(F.col("origin")))
            .drop("_new"))


def sidecar(origins: DataFrame, source: str = "openlibrary") -> DataFrame:
    return origins.select("isbn13", "origin", F.lit(source).alias("origin_source"))
