"""Audiobook pages: JSON-LD first, component JSON next, page text last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import AUDIBLE_CHIP_KINDS
from ..functions.core import blank_to_null, compute_once, keep_nonblank, let
from ..functions.dates import iso_date, us_short_date
from ..functions.isbn import asin_of_row
from ..functions.lists import dedupe
from ..functions.markup import (attr, el, first, html_text_of, meta, origin_of, raw_text_of, sel, select, select_in,
                                text_of)
from ..functions.payload import (as_map, breadcrumb_names, elements, jsonld, list_or_text, loads, named, names,
                                 of_type, origin_in, raw_text, text)
from ..functions.text import composite_rating, html_text, tidy, with_heading
from ..functions.urls import path_of, strip_query
from ..operators.origin import probe
from .common import REVIEW, collect, parsed, shaped

SITE = "https://www.audible.com"
_JSON = el("script", attrs={"type": "application/json"})


def component_json(nodes: Column, *chain) -> Column:
    """JSON that hydrates one page component."""
    return loads(raw_text_of(nodes, first(select(nodes, *chain, _JSON))))


def label_authors(label: Column) -> Column:
    bare = F.regexp_replace(F.coalesce(label, F.lit("")), r"(?i)^by[:\s]+", "")
    return keep_nonblank(F.transform(F.split(bare, ","), lambda p: F.trim(p)))


def genre_chips(nodes: Column) -> Column:
    """Chips whose address path names a real taxonomy; any other chip is dropped."""
    chips = select(nodes, el("adbl-chip-group", attrs={"slot": "chips"}), el("adbl-chip"))
    kind = lambda c: F.lower(F.regexp_extract(path_of(F.coalesce(attr(c, "href"), F.lit(""))), r"^/tag/([^/]+)/", 1))
    return keep_nonblank(F.transform(F.filter(chips, lambda c: kind(c).isin(AUDIBLE_CHIP_KINDS)), lambda c: text_of(nodes, c)))


def genres(nodes: Column, blocks: Column, book: Column, details: Column) -> Column:
    crumbs = F.filter(F.flatten(F.transform(of_type(blocks, ["BreadcrumbList"]), lambda b: breadcrumb_names(b))), lambda n: F.lower(n) != "home")
    return dedupe(F.concat(crumbs, genre_chips(nodes), names(details, "categories"), list_or_text(book, "genre")))


def reviews(nodes: Column) -> Column:
    def row(tile: Column, i: Column) -> Column:
        inner = lambda *c: first(select_in(nodes, tile, *c))
        block = F.coalesce(inner(el("adbl-text-block", attrs={"slot": "review-summary"})), inner(el("adbl-text-block")))
        body = html_text_of(nodes, block)
        headline = F.coalesce(blank_to_null(text_of(nodes, inner(el("h3", attrs={"slot": "review-title"})))), text_of(nodes, inner(el("h3"))))
        stars = attr(inner(el("adbl-star-rating", attrs={"slot": "stars"})), "value")
        return F.struct(
            i.cast("bigint").alias("pos"), F.lit("").alias("review_id"),
            let(body, lambda b: F.when(b == "", headline).otherwise(with_heading(headline, b, ignore_case=False))).alias("text"),
            blank_to_null(tidy(attr(tile, "reviewer"))).alias("reviewer"),
            blank_to_null(composite_rating(stars, attr(tile, "story-rating"), attr(tile, "performance-rating"))).alias("rating"),
            blank_to_null(tidy(attr(tile, "review-date"))).alias("date"), F.lit(None).cast("string").alias("url"))

    return F.filter(F.transform(select(nodes, el("adbl-review-tile")), row).cast(f"array<{REVIEW}>"), lambda r: r["text"] != "")


def search_rows(pages: DataFrame) -> DataFrame:
    """Result pages ``(isbn13, html)`` to candidate rows."""
    nodes = F.col("nodes")
    df = parsed(pages).select("isbn13", "nodes", F.posexplode(select(nodes, el("li", "productListItem"))).alias("pos", "item"))
    inner = lambda *c: first(select_in(nodes, F.col("item"), *c))
    link = F.coalesce(inner(el("a", "bc-link", {"href": "^/pd/"})), inner(el("a", attrs={"href": "*/pd/"})))
    href = strip_query(F.coalesce(attr(link, "href"), F.lit("")))
    impression = attr(inner(el("div", "adbl-asin-impression", has=["data-asin"])), "data-asin")
    asin = asin_of_row(F.coalesce(attr(F.col("item"), "id"), F.lit("")), impression, href)
    headings = [blank_to_null(text_of(nodes, inner(*c))) for c in ([el("h3", "bc-heading"), el("a")], [el("h3"), el("a")], [el("h3")])]
    cover = F.coalesce(inner(el("img", attrs={"alt": "~ cover art$"}, has=["src"])), inner(el("img", has=["src"])))
    df = df.withColumns({"asin": asin, "href": href})
    return df.where((F.col("asin") != "") | (F.col("href") != "")).select(
        "isbn13", F.col("pos").cast("bigint").alias("pos"), "asin",
        F.when(F.startswith("href", F.lit("/")), F.concat(F.lit(SITE), F.col("href"))).when(F.col("href") != "", F.col("href"))
        .otherwise(F.concat(F.lit(SITE + "/pd/"), F.col("asin"))).alias("url"),
        F.coalesce(blank_to_null(tidy(attr(F.col("item"), "aria-label"))), *headings, F.lit("")).alias("title"),
        label_authors(text_of(nodes, inner(el(cls="authorLabel")))).alias("authors"), attr(cover, "src").alias("image"))


def to_records(pages: DataFrame) -> DataFrame:
    """``pages(isbn13, isbn10, url, html[, row_image, sibling_images])``."""
    nodes = F.col("nodes")
    panel = el("adbl-product-details")
    df = parsed(pages)
    df = compute_once(compute_once(df, blocks=jsonld(F.col("html"))), **{
        "blobs": of_type(F.col("blocks"), ["Audiobook", "Product", "Book"]),
        "details": component_json(nodes, panel, el("adbl-product-metadata")),
        "people": component_json(nodes, el("adbl-product-metadata", has=["combine-authors-narrators"]))})
    df = compute_once(df, audio=F.get(F.filter("blobs", lambda b: text(b, "name").isNotNull() | text(b, "description").isNotNull()), 0))
    audio, details, people = F.col("audio"), F.col("details"), F.col("people")
    shown = meta(nodes, "og:title", "twitter:title", "title")
    title = F.coalesce(text(audio, "name"), sel(nodes, [el("h1", attrs={"slot": "title"})]),
                       blank_to_null(F.trim(F.regexp_replace(shown, r"\s+Audiobook\b.*$", ""))), shown)
    some = lambda c: F.when(F.size(c) > 0, c)
    writers = F.coalesce(some(list_or_text(audio, "author")), some(names(people, "authors")),
                         label_authors(sel(nodes, [el(cls="authorLabel")])))
    spoken = F.coalesce(text(audio, "inLanguage"), text(details, "language"))
    found = probe([("the Audiobook/Product JSON-LD", F.size(as_map(audio)) > 0, origin_in(audio)),
                   ("the embedded component JSON", F.size(as_map(details)) > 0, origin_in(details)),
                   ("the page DOM (adbl-metadata slots and og:/meta tags)", F.size(nodes) > 0, origin_of(nodes))])
    blurb = F.coalesce(blank_to_null(html_text(raw_text(audio, "description"))),
                       blank_to_null(html_text_of(nodes, first(select(nodes, el("adbl-text-block", attrs={"slot": "summary"}))))),
                       meta(nodes, "og:description", "description", "twitter:description"))
    image = attr(first(select(nodes, el("adbl-product-image", attrs={"slot": "image"}), el("img", has=["src"]))), "src")
    urls = F.array(raw_text(audio, "image"), image, meta(nodes, "og:image", "twitter:image"))
    if "row_image" in pages.columns:
        urls = F.concat(urls, F.array("row_image"), F.coalesce("sibling_images", F.array().cast("array<string>")))
    linked = attr(first(select(nodes, el("link", attrs={"rel": "canonical"}, has=["href"]))), "href")
    df = compute_once(df, _origin=found, _title=title)
    return shaped(
        df, "audible", book_url=strip_query(F.coalesce(blank_to_null(linked), meta(nodes, "og:url"), F.col("url"))), title=F.col("_title"),
        authors=dedupe(writers), publisher=F.coalesce(named(audio, "publisher"), named(details, "publisher")),
        date_of_publication=F.coalesce(iso_date(raw_text(audio, "datePublished")), us_short_date(raw_text(details, "releaseDate"))),
        language=F.when((spoken == F.lower(spoken)) & (spoken != F.upper(spoken)), F.initcap(spoken)).otherwise(spoken),
        genres=genres(nodes, F.col("blocks"), audio, details), blurb=blurb, origin=F.col("_origin.origin"), origin_layers=F.col("_origin.searched"),
        covers=collect("audible", F.col("url"), urls), reviews=reviews(nodes), hint_isbn10=F.col("isbn10"), confirmed=F.lit(False))
