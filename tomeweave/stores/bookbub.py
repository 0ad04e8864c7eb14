"""Deal pages: a book JSON attribute, JSON-LD, and a labelled panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import (BOOKBUB_DATE_LABELS, BOOKBUB_LANGUAGE_META, BOOKBUB_NON_BOOKS, BOOKBUB_ORIGIN_LABELS,
                     BOOKBUB_PUBLISHER_LABELS, MARKETING_TAG_PATTERN)
from ..functions.core import blank_to_null, compute_once, keep_nonblank, let, some
from ..functions.dates import iso_date
from ..functions.lists import colon_pairs, dedupe, first_label, name_list, split_list
from ..functions.markup import (attr, el, first, html_text_of, meta, origin_of, sel, select, select_in, sels, strings,
                                text_of)
from ..functions.payload import (as_map, as_object, elements, is_object, jsonld, list_or_text, loads, member,
                                 origin_in, origin_in_map, raw_text, text)
from ..functions.text import author_variants, clean, fold, html_text, language_name, repair_repeated, slug, tidy, title_variants
from ..operators.origin import probe
from .common import collect, parsed, shaped

SITE = "https://www.bookbub.com"
PAGE_TITLE = r"^(.+?)\s+by\s+(.+?)\s+-\s+BookBub\s*$"
COVER_ALT = r"(?i)^\s*Book cover for\s+(.+?)\s+by\s+(.+?)\s*$"
DENY = ["description"]


def panel_pairs(nodes: Column) -> Column:
    """``Label: value`` lines of the book panel."""
    panel = F.coalesce(first(select(nodes, el(cls="book-panel"))), first(select(nodes, el(cls="book-info-body"))))
    return colon_pairs(F.split(html_text_of(nodes, panel), "\n"), 40, DENY)


def page_title(nodes: Column, data: Column, blob: Column) -> Column:
    tag = sel(nodes, [el("title")])
    patterned = lambda c: blank_to_null(F.trim(F.regexp_extract(c, PAGE_TITLE, 1)))
    return F.coalesce(text(data, "title"), text(blob, "name"), sel(nodes, [el(cls="book-info-title")]),
                      patterned(tag), patterned(meta(nodes, "og:title", "twitter:title")))


def page_authors(nodes: Column, data: Column, blob: Column) -> Column:
    shown = name_list(sels(nodes, [el(cls="book-info-authors"), el(cls="person-name")], [el(cls="book-info-authors")]))
    titled = split_list(blank_to_null(F.regexp_extract(sel(nodes, [el("title")]), PAGE_TITLE, 2)))
    return dedupe(F.coalesce(some(list_or_text(data, "authors")), some(list_or_text(blob, "author")), some(shown), titled))


def load(pages: DataFrame) -> DataFrame:
    """Pages with book JSON and the first JSON-LD book."""
    nodes = F.col("nodes")
    data = as_object(loads(attr(first(select(nodes, el(has=["data-book-json"]))), "data-book-json")))
    df = compute_once(parsed(pages), data=data, blob=F.get(jsonld(F.col("html"), ["Book"]), 0))
    return df


def scored_pages(pages: DataFrame) -> DataFrame:
    """What scoring needs of candidate pages ``(isbn13, rung, url, html)``: title and authors, JSON-LD aside."""
    bare, nodes = F.lit(None).cast("variant"), F.col("nodes")
    return load(pages).select("isbn13", "rung", "url", page_title(nodes, F.col("data"), bare).alias("title"),
                              page_authors(nodes, F.col("data"), bare).alias("authors"))


def slug_rungs(hints: DataFrame) -> DataFrame:
    """The first three guessed page addresses of each book, as rungs 0 to 2."""
    from ..fixed import BOOKBUB_SLUGS
    titles, people = title_variants(F.col("title")), author_variants(F.col("authors"))
    joined = F.flatten(F.transform(titles, lambda t: F.transform(people, lambda a: F.concat(slug(t), F.lit("-by-"), slug(a)))))
    guesses = F.array_distinct(F.when(F.size(people) > 0, joined).otherwise(F.transform(titles, lambda t: slug(t))))
    return hints.select("isbn13", F.posexplode(F.slice(guesses, 1, BOOKBUB_SLUGS)).alias("rung", "slug"))


def author_rows(pages: DataFrame) -> DataFrame:
    """An author's listing ``(isbn13, html)`` to candidate rows, one per address."""
    from ..operators.skew import first_per_key
    nodes = F.col("nodes")
    df = parsed(pages).select("isbn13", "nodes", F.posexplode(select(nodes, el("a", attrs={"href": "*/books/"}))).alias("pos", "a"))
    address = F.lower(F.regexp_extract(attr(F.col("a"), "href"), r"(?i)/books/([a-z0-9][a-z0-9\-]*)", 1))
    alt = attr(first(select_in(nodes, F.col("a"), el("img"))), "alt")
    from_slug = F.replace(F.get(F.split(F.regexp_replace(address, r"-\d{4}-\d{2}-\d{2}$", ""), "-by-", 2), 0), F.lit("-"), F.lit(" "))
    df = df.withColumn("slug", address).where((F.col("slug") != "") & ~F.col("slug").isin(BOOKBUB_NON_BOOKS))
    title = F.coalesce(blank_to_null(F.regexp_extract(F.coalesce(alt, F.lit("")), COVER_ALT, 1)),
                       blank_to_null(tidy(strings(nodes, F.col("a"), " "))), from_slug)
    rows = df.select("isbn13", F.col("pos").cast("bigint").alias("pos"), "slug", title.alias("title"),
                     F.concat(F.lit(SITE + "/books/"), F.col("slug")).alias("url"))
    return first_per_key(rows, ["isbn13", "slug"], ["pos"])


def to_records(pages: DataFrame) -> DataFrame:
    df = compute_once(load(pages), pairs=panel_pairs(F.col("nodes")))
    nodes, data, blob, pairs = (F.col(c) for c in ("nodes", "data", "blob", "pairs"))
    df = compute_once(df, _title=page_title(nodes, data, blob)).where(F.col("_title").isNotNull())
    dates = F.coalesce(first_label(pairs, BOOKBUB_DATE_LABELS), blank_to_null(raw_text(blob, "datePublished")),
                       blank_to_null(raw_text(blob, "copyrightYear")), meta(nodes, "book:release_date", "og:book:release_date", "datePublished"))
    spoken = F.coalesce(meta(nodes, *BOOKBUB_LANGUAGE_META), raw_text(blob, "inLanguage", "name"), raw_text(blob, "inLanguage", "alternateName"),
                        F.when(~is_object(member(blob, "inLanguage")), raw_text(blob, "inLanguage")))
    deals = F.transform(elements(data, "dealsCategories"), lambda c: clean(F.coalesce(blank_to_null(raw_text(c, "displayName")), raw_text(c, "partnerName"))))
    tags = F.filter(F.transform(elements(data, "tags"), lambda t: clean(raw_text(t, "displayName"))), lambda t: ~t.rlike(MARKETING_TAG_PATTERN))
    own = keep_nonblank(F.concat(deals, tags))
    shown = sel(nodes, [el(cls="expandable-text-description")], [el(cls="expandable-text-rendered")])
    blurb = F.coalesce(*[blank_to_null(html_text(c)) for c in (raw_text(data, "description"), raw_text(data, "blurb"), raw_text(blob, "description"), shown)])
    images = F.filter(nodes, lambda n: (n["tag"] == "img") & F.array_contains(F.split(F.coalesce(attr(n, "class"), F.lit("")), "\\s+"), "book-cover-image"))
    images = F.concat(images, select(nodes, el(cls="cover-image"), el("img")))
    alt_title = lambda n: F.regexp_extract(F.coalesce(attr(n, "alt"), F.lit("")), COVER_ALT, 1)
    wanted = fold(F.col("_title"))
    chosen = let(images, lambda shown: let(wanted, lambda name: F.coalesce(
        F.get(F.filter(shown, lambda n: let(alt_title(n), lambda alt: (alt != "") & (fold(alt) == name))), 0), F.get(shown, 0))))
    urls = F.array(raw_text(data, "coverUrl"), meta(nodes, "og:image", "twitter:image"), let(chosen, lambda n: F.coalesce(blank_to_null(attr(n, "src")), attr(n, "data-src"))))
    found = probe([("the parsed detail rows", F.size(pairs) > 0, origin_in_map(pairs)),
                   ("the data-book-json book JSON payload", F.size(as_map(data)) > 0, origin_in(data)),
                   ("the page DOM and og:/book: meta tags", F.size(nodes) > 0, origin_of(nodes))])
    df = compute_once(df, _origin=found)
    return shaped(
        df, "bookbub", book_url=F.col("url"), title=F.col("_title"), authors=page_authors(nodes, data, blob),
        publisher=first_label(pairs, BOOKBUB_PUBLISHER_LABELS), date_of_publication=iso_date(dates), language=language_name(spoken),
        genres=dedupe(F.coalesce(some(own), list_or_text(blob, "genre"))),
        blurb=F.coalesce(repair_repeated(blurb), meta(nodes, "og:description", "twitter:description", "description")),
        origin=F.coalesce(first_label(pairs, BOOKBUB_ORIGIN_LABELS), F.col("_origin.origin")), origin_layers=F.col("_origin.searched"),
        covers=collect("bookbub", F.col("url"), urls), reviews=F.array(), hint_isbn10=F.col("isbn10"), confirmed=F.lit(False))
