"""Catalogue records: the books reply keyed by identifier, and the edition record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import blank_to_null
from ..functions.dates import iso_date
from ..functions.lists import dedupe
from ..functions.payload import (as_map, as_object, elements, is_object, loads, member, names, origin_in, raw_text,
                                 text)
from ..functions.text import catalogue_language, clean
from ..operators.artefacts import catalogue_has_cover
from ..operators.origin import probe
from .common import shaped


def to_records(captured: DataFrame) -> DataFrame:
    """``captured(isbn13, isbn10, reply, edition)`` with both payloads as JSON text."""
    replies = captured.withColumn("_reply", as_map(loads(F.col("reply")))).withColumn(
        "edition", loads(F.coalesce("edition", F.lit("{}"))))
    by = lambda c: as_object(F.try_element_at("_reply", F.concat(F.lit("ISBN:"), F.col(c))))
    df = replies.withColumn("record", F.coalesce(by("isbn13"), by("isbn10"))).where(
        F.size(as_map(F.col("record"))) > 0)

    record, edition = F.col("record"), F.col("edition")
    code = F.get(F.transform(F.filter(elements(edition, "languages"), is_object), lambda e: raw_text(e, "key")), 0)
    described = F.coalesce(raw_text(edition, "description", "value"),
                           F.when(~is_object(member(edition, "description")), raw_text(edition, "description")))
    sizes = F.filter(F.array(*[raw_text(record, "cover", s) for s in ("large", "medium", "small")]),
                     lambda u: (F.coalesce(u, F.lit("")) != "") & catalogue_has_cover(u))
    exact = F.transform(sizes, lambda u: F.concat(
        u, F.when(F.contains(u, F.lit("?")), F.lit("&")).otherwise(F.lit("?")), F.lit("default=false")))
    found = probe([("the /api/books record", F.lit(True), origin_in(record)),
                   ("the /isbn/ edition record", F.size(as_map(edition)) > 0, origin_in(edition))])
    df = df.withColumn("_origin", found)
    return shaped(
        df, "openlibrary", title=text(record, "title"), authors=names(record, "authors"),
        publisher=F.get(names(record, "publishers"), 0), date_of_publication=iso_date(raw_text(record, "publish_date")),
        language=catalogue_language(code), genres=dedupe(names(record, "subjects")),
        blurb=blank_to_null(clean(described)), origin=F.col("_origin.origin"), origin_layers=F.col("_origin.searched"),
        covers=F.when(F.size(exact) > 0, F.array(exact)).otherwise(F.array().cast("array<array<string>>")),
        reviews=F.array(), book_url=F.concat(F.lit("https://openlibrary.org/isbn/"), "isbn13"),
        hint_title=text(record, "title"), hint_isbn10=F.coalesce(raw_text(F.get(elements(record, "isbn_10"), 0)), F.col("isbn10")),
        confirmed=F.lit(True))
