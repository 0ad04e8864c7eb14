"""Captured replies that hold further reviews, and the review path from there to numbered files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import blank_to_null, compute_once
from ..functions.dates import published_date
from ..functions.payload import elements, loads, member, raw_text
from ..functions.text import clean, html_text, rating_text
from ..operators import artefacts
from . import audible, kobo
from .common import REVIEW, parsed

#: Positions a page's reviews may take; pages follow each other at this distance.
PAGE = 1 << 32
PAIR = ["isbn13", "source"]
FIELDS = ["review_id", "text", "reviewer", "rating", "date", "url"]


def _cursor_reviews(pages: DataFrame) -> DataFrame:
    """Replies of a cursor query: JSON with review nodes; one with errors holds none."""
    df = compute_once(pages, reply=loads(F.col("body")))
    block = member(member(F.col("reply"), "data"), "getReviews")
    errors = member(F.col("reply"), "errors")
    broken = errors.isNotNull() & ~F.is_variant_null(errors)
    nodes = F.transform(F.coalesce(F.when(~broken, elements(block, "edges")), F.array().cast("array<variant>")), lambda e: member(e, "node"))

    def row(node, i):
        return F.struct(
            i.cast("bigint").alias("pos"), raw_text(node, "id").alias("review_id"), html_text(raw_text(node, "text")).alias("text"),
            blank_to_null(clean(raw_text(member(node, "creator"), "name"))).alias("reviewer"), rating_text(raw_text(node, "rating")).alias("rating"),
            published_date(raw_text(node, "createdAt"), pacific=False).alias("date"), F.lit(None).cast("string").alias("url"))

    return df.withColumn("found", F.transform(nodes, row).cast(f"array<{REVIEW}>"))


def _fragment_reviews(reader):
    """Replies that are page fragments, read by the mapping's own reader."""
    return lambda pages: parsed(pages.withColumnRenamed("body", "html")).withColumn("found", reader(F.col("nodes")))


READERS = {"goodreads": _cursor_reviews, "kobo": _fragment_reviews(kobo.reviews), "audible": _fragment_reviews(audible.reviews)}


def read_pages(pages: DataFrame) -> DataFrame:
    """``pages(isbn13, source, page_no, body)`` as one row per review, ``pos`` in page order.

    A source without a reader has no rows here; a body that cannot be read holds no review.
    """
    each = [reader(pages.where(F.col("source") == name)).select(*PAIR, "page_no", F.explode("found").alias("r")) for name, reader in READERS.items()]
    rows = reduce(DataFrame.unionByName, each)
    place = F.coalesce(F.col("page_no"), F.lit(0)).cast("bigint") * PAGE + F.col("r.pos")
    return rows.select(*PAIR, place.alias("pos"), *[F.col("r")[c].alias(c) for c in FIELDS]).where("text <> ''")


def with_pages(first: DataFrame, pages: DataFrame) -> DataFrame:
    """Reviews of the first page and of captured ones in page order.

    ``first`` has ``pos`` within its page, which is page 1, but for the source whose replies come
    before its page's own widget.
    """
    widget_last = F.when(F.col("source") == "kobo", F.lit(1 << 20)).otherwise(F.lit(1))
    return first.withColumn("pos", widget_last * PAGE + F.col("pos")).select(*PAIR, "pos", *FIELDS).unionByName(read_pages(pages))


def review_path(reviews: DataFrame, cap: int | None = None) -> DataFrame:
    """Least length, the source's own rule for repeats, numbers, cap, and the text of each review's file."""
    usable = artefacts.usable_reviews(reviews)
    either = F.col("source") == "goodreads"
    once = artefacts.dedupe_reviews_either_key(usable.where(either)).unionByName(artefacts.dedupe_reviews(usable.where(~either)))
    return artefacts.number_reviews(once, cap).withColumn("body", artefacts.render_review())
