"""What is left to do: wanted books times sources, minus what is answered."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import SEED_SOURCE, SOURCE_ORDER
from ..functions.core import literal_array
from ..functions.text import clean


def select_sources(names: list[str] | None) -> tuple[list[str], list[str]]:
    """Known sources, seed first, then the fixed order; and the unknown names."""
    asked = [n.strip().lower() for n in names or [] if n.strip()]
    known = [s for s in SOURCE_ORDER if not asked or s in asked]
    known.sort(key=lambda s: s != SEED_SOURCE)
    return known, [n for n in dict.fromkeys(asked) if n not in SOURCE_ORDER]


def rank_sources(df: DataFrame, column: str = "source") -> DataFrame:
    """Known sources with their rank; unknown ones get rank null and ``known`` false."""
    rank = F.array_position(literal_array(SOURCE_ORDER), F.col(column))
    return df.withColumn("source_rank", F.nullif(rank, F.lit(0)).cast("int")).withColumn("known", rank > 0)


def answered_bits(scraped: DataFrame, no_data: DataFrame, incomplete: DataFrame) -> DataFrame:
    """One row per book: a bit per source for each of the three facts.

    The bits merge map-side, so the shuffle carries one small row per book and map task.
    """
    facts = reduce(DataFrame.unionByName, [
        df.select("isbn13", "source", F.lit(kind).alias("kind"))
        for kind, df in (("scraped", scraped), ("no_data", no_data), ("incomplete", incomplete))])
    bit = F.expr("shiftleft(1, source_rank - 1)")
    return (rank_sources(facts).where("known").groupBy("isbn13").agg(*[
        F.bit_or(F.when(F.col("kind") == kind, bit).otherwise(F.lit(0))).alias(kind)
        for kind in ("scraped", "no_data", "incomplete")]))


def pair_states(wanted: DataFrame, bits: DataFrame, sources: list[str] = SOURCE_ORDER) -> DataFrame:
    """Every (book, source) pair with its skip reason, null when there is work to do.

    An incomplete record wins over both other facts.  The join happens before the sources
    multiply the rows, on a key that is unique on both sides.
    """
    joined = wanted.join(bits, "isbn13", "left")
    pairs = joined.withColumn("source", F.explode(literal_array(sources)))
    held = {kind: F.expr(f"coalesce({kind}, 0) & shiftleft(1, source_rank - 1)") != 0
            for kind in ("scraped", "no_data", "incomplete")}
    reason = (F.when(held["incomplete"], F.lit(None).cast("string"))
              .when(held["scraped"], F.concat("source", F.lit("_metadata already holds it")))
              .when(held["no_data"], F.concat("source", F.lit("_no_data records no such book"))))
    return rank_sources(pairs).withColumn("skip_reason", reason).drop("scraped", "no_data", "incomplete", "known")


def worklist(states: DataFrame) -> DataFrame:
    return states.where(F.col("skip_reason").isNull()).drop("skip_reason")


def skipped(states: DataFrame) -> DataFrame:
    return states.where(F.col("skip_reason").isNotNull())


def recover_hints(hints: DataFrame, seed_records: DataFrame) -> DataFrame:
    """Fill missing title and authors from the stored seed record of the same book."""
    stored = seed_records.select("isbn13", F.col("title").alias("_title"), F.col("authors").alias("_authors"))
    kept = F.filter("_authors", lambda a: F.coalesce(a, F.lit("")) != "")
    return (hints.join(stored, "isbn13", "left")
            .withColumn("title", F.coalesce(F.nullif("title", F.lit("")), F.nullif("_title", F.lit(""))))
            .withColumn("authors", F.when(F.size(F.coalesce("authors", F.array())) > 0, F.col("authors"))
                        .otherwise(F.coalesce(kept, F.array().cast("array<string>"))))
            .drop("_title", "_authors"))


def fold_hints(found: DataFrame) -> DataFrame:
    """Per book, the first non-empty title, authors and ISBN-10 in source order.

    ``found(isbn13, source, confirmed, title, authors, isbn10)``; only confirmed pages count.
    """
    usable = rank_sources(found).where(F.col("confirmed") & F.col("known"))

    def first(column: str, present: Column) -> Column:
        return F.min_by(column, F.when(present, F.col("source_rank"))).alias(column)

    return usable.groupBy("isbn13").agg(
        first("title", F.coalesce(F.col("title"), F.lit("")) != ""),
        first("authors", F.size(F.coalesce("authors", F.array())) > 0),
        first("isbn10", F.coalesce(F.col("isbn10"), F.lit("")) != ""))


def search_terms(hints: DataFrame, seed_records: DataFrame, search_index: DataFrame,
                 subtitle: bool = False) -> DataFrame:
    """Title and authors to search by, with where they came from.

    The hint wins; then the seed record by ISBN-13, by ISBN-10, then the search index.
    ``seed_records(isbn, title, subtitle, authors)``, ``search_index(isbn13, title, subtitle, authors)``.
    """
    def renamed(df: DataFrame, key: str, to: str, tag: str) -> DataFrame:
        pack = F.struct(F.nullif(clean(F.col("title")), F.lit("")).alias("title"),
                        F.nullif(clean(F.col("subtitle")), F.lit("")).alias("subtitle"),
                        F.coalesce("authors", F.array().cast("array<string>")).alias("authors"))
        return df.select(F.col(key).alias(to), pack.alias(tag)).where(F.col(tag)["title"].isNotNull())

    joined = (hints.join(renamed(seed_records, "isbn", "isbn13", "_by13"), "isbn13", "left")
              .join(renamed(seed_records, "isbn", "isbn10", "_by10"), "isbn10", "left")
              .join(renamed(search_index, "isbn13", "isbn13", "_index"), "isbn13", "left"))
    seed = F.coalesce("_by13", "_by10", "_index")
    own = F.nullif(F.trim("title"), F.lit(""))
    full = F.nullif(F.concat_ws(": ", seed["title"], seed["subtitle"]), F.lit("")) if subtitle else seed["title"]
    known = F.filter(F.coalesce("authors", F.array().cast("array<string>")), lambda a: clean(a) != "")
    return joined.select(
        "isbn13", F.coalesce(own, full).alias("title"),
        F.when(own.isNotNull() | (F.size(known) > 0), known)
        .otherwise(F.coalesce(seed["authors"], known)).alias("authors"),
        F.when(own.isNotNull(), F.lit("hint")).when(F.col("_by13").isNotNull(), F.lit("seed_isbn13"))
        .when(F.col("_by10").isNotNull(), F.lit("seed_isbn10"))
        .when(F.col("_index").isNotNull(), F.lit("search_index")).otherwise(F.lit("none")).alias("provenance"))
