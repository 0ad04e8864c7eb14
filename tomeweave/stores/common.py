"""What the six mappings share: parsing once, in-row cover collection, the output shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import parse_nodes
from ..functions.core import compute_once, first_of_each, let
from ..functions.markup import looks_like_html, select
from ..functions.payload import loads
from ..operators.artefacts import COLLECTORS, is_placeholder
from ..functions.urls import absolute

REVIEW = "struct<pos:bigint,review_id:string,text:string,reviewer:string,rating:string,date:string,url:string>"
COLUMNS = ["source", "isbn13", "book_url", "title", "authors", "publisher", "origin", "origin_layers",
           "date_of_publication", "language", "genres", "blurb", "covers", "reviews", "work_id",
           "hint_title", "hint_isbn10", "confirmed"]


def parsed(pages: DataFrame) -> DataFrame:
    """Pages with their node list; a body that is no HTML gets none."""
    return pages.withColumn("nodes", parse_nodes(F.when(looks_like_html(F.col("html")), F.col("html"))))


def shaped(df: DataFrame, source: str, **columns: Column) -> DataFrame:
    """Select the common output columns; what a source does not offer is null."""
    types = {"authors": "array<string>", "origin_layers": "array<string>", "genres": "array<string>",
             "covers": "array<array<string>>", "reviews": f"array<{REVIEW}>", "confirmed": "boolean"}
    columns["source"] = F.lit(source)
    columns.setdefault("isbn13", F.col("isbn13"))
    return df.select(*[columns.get(c, F.lit(None)).cast(types.get(c, "string")).alias(c) for c in COLUMNS])


def collect(source: str, base: Column, offers: Column) -> Column:
    """Offered URLs of one page to its kept covers, one list of alternatives each."""
    key, upgrade, cap = COLLECTORS[source]
    usable = F.filter(F.transform(offers, lambda u: absolute(base, u)),
                      lambda u: (u != "") & ~is_placeholder(u))
    pairs = F.filter(F.transform(F.transform(usable, lambda u: upgrade(source, u)),
                                 lambda u: F.struct(u.alias("url"), key(source, u).alias("key"))),
                     lambda p: p["key"] != "")

    return F.transform(F.slice(first_of_each(pairs, "x.key"), 1, cap), lambda p: F.array(p["url"]))


def offers(*urls: Column) -> Column:
    return F.filter(F.array(*urls), lambda u: u.isNotNull())


def first_collected(source: str, base: Column, *groups: Column) -> Column:
    """The first group of offers that yields any cover."""
    def pick(found: Column) -> Column:
        return F.coalesce(F.get(F.filter(found, lambda g: F.size(g) > 0), 0),
                          F.array().cast("array<array<string>>"))
    return let(F.array(*[collect(source, base, g) for g in groups]), pick)


def script_json(html: Column, element_id: str) -> Column:
    """JSON of the script element with this id."""
    return loads(F.regexp_extract(
        html, rf"(?is)<script\b[^>]*\bid\s*=\s*[\"']{element_id}[\"'][^>]*>(.*?)</script", 1))


def any_found(nodes: Column, *chains) -> Column:
    out = None
    for chain in chains:
        hit = F.size(select(nodes, *chain)) > 0
        out = hit if out is None else out | hit
    return F.coalesce(out, F.lit(False))


def review_rows(records: DataFrame) -> DataFrame:
    """Reviews of mapped records as rows."""
    held = compute_once(records.select("isbn13", "source", "reviews"), reviews=F.col("reviews"))
    return held.select("isbn13", "source", F.explode("reviews").alias("r")).select("isbn13", "source", "r.*")


def cover_rows(records: DataFrame) -> DataFrame:
    """Covers of mapped records as rows with their alternatives."""
    held = compute_once(records.select("isbn13", "source", "covers"), covers=F.col("covers"))
    return held.select("isbn13", "source", F.posexplode("covers").alias("cover_no", "alternatives"))
