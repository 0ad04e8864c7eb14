"""Pages that carry a pointer cache: book, work, contributors and reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import blank_to_null, compute_once, keep_nonblank
from ..functions.dates import published_by, published_date
from ..functions.lists import dedupe
from ..functions.markup import (attr, el, first, html_text_of, meta, origin_of, sel, select, select_in, sels,
                                text_of)
from ..functions.payload import (as_map, deref, elements, jsonld, member, named, origin_in, raw_text,
                                 root_book, text)
from ..functions.text import clean, drop_librarian_note, html_text, rating_text, search_title
from ..functions.urls import absolute, strip_query
from ..operators.matching import verify_lax
from ..operators.origin import probe
from .common import REVIEW, first_collected, offers, parsed, script_json, shaped

SITE = "https://www.goodreads.com"


def load(pages: DataFrame) -> DataFrame:
    """``pages(isbn13, isbn10, url, html, fuzzy)`` with cache, book, work and node list."""
    nodes = F.col("nodes")
    in_url = r"/book/show/(\d+)"
    linked = attr(first(select(nodes, el("link", attrs={"rel": "canonical"}))), "href")
    legacy = F.coalesce(blank_to_null(F.regexp_extract("url", in_url, 1)),
                        F.regexp_extract(F.coalesce(linked, F.lit("")), in_url, 1))
    cache = as_map(member(script_json(F.col("html"), "__NEXT_DATA__"), "props", "pageProps", "apolloState"))
    df = compute_once(parsed(pages), cache=cache)
    df = compute_once(df, book=root_book(F.col("cache"), legacy))
    return compute_once(df, work=deref(F.col("cache"), member(F.col("book"), "work")))


def work_id(nodes: Column, work: Column) -> Column:
    """Work id: the cache's own, else a work address in the cache or in a link."""
    shape = r"/work/(?:editions|quotes|shelves|)/?(\d+)"
    linked = F.transform(select(nodes, el("a", attrs={"href": "*/work/"})), lambda a: attr(a, "href"))
    addresses = F.concat(F.array(raw_text(work, "editions", "webUrl"), raw_text(work, "details", "webUrl")), linked)
    ids = F.filter(F.transform(addresses, lambda u: F.regexp_extract(F.coalesce(u, F.lit("")), shape, 1)),
                   lambda i: i != "")
    return F.coalesce(text(work, "legacyId"), F.get(ids, 0))


def contributors(cache: Column, book: Column) -> Column:
    """Contributor names; a role other than author stays in parentheses."""
    edges = F.concat(F.array(member(book, "primaryContributorEdge")), elements(book, "secondaryContributorEdges"))

    def credited(edge: Column) -> Column:
        name = clean(raw_text(deref(cache, member(edge, "node")), "name"))
        role = clean(raw_text(edge, "role"))
        return (F.when(name == "", F.lit("")).when(F.lower(role).isin("", "author"), name)
                .otherwise(F.concat(name, F.lit(" ("), role, F.lit(")"))))

    return dedupe(F.transform(F.filter(edges, lambda e: e.isNotNull()), credited))


def reviews_in(cache: Column, url: Column) -> Column:
    """Reviews in the site's own order, else every review node of the cache."""
    root = as_map(F.try_element_at(cache, F.lit("ROOT_QUERY")))
    edges = elements(F.try_element_at(root, F.lit("getReviews")), "edges")
    ranked = F.transform(edges, lambda e: deref(cache, member(e, "node")))
    loose = F.transform(F.filter(F.map_entries(cache), lambda e: F.startswith(e["key"], F.lit("Review:"))),
                        lambda e: e["value"])
    nodes = F.when(F.size(edges) > 0, ranked).otherwise(loose)

    def row(n: Column, i: Column) -> Column:
        return F.struct(
            i.cast("bigint").alias("pos"), raw_text(n, "id").alias("review_id"), html_text(raw_text(n, "text")).alias("text"),
            blank_to_null(clean(raw_text(deref(cache, member(n, "creator")), "name"))).alias("reviewer"),
            rating_text(raw_text(n, "rating")).alias("rating"),
            published_date(raw_text(n, "createdAt"), pacific=False).alias("date"),
            blank_to_null(absolute(url, raw_text(deref(cache, member(n, "shelving")), "webUrl"))).alias("url"))

    rows = F.transform(F.filter(nodes, lambda n: n.isNotNull()), row)
    return F.filter(F.coalesce(rows.cast(f"array<{REVIEW}>"), F.array().cast(f"array<{REVIEW}>")), lambda r: r["text"] != "")


def to_records(pages: DataFrame) -> DataFrame:
    df = load(pages)
    df = compute_once(df, _blobs=jsonld(F.col("html"), ["Book"]))
    nodes, book, work, cache, url = (F.col(c) for c in ("nodes", "book", "work", "cache", "url"))
    details = member(book, "details")
    heading = [el("h1", attrs={"data-testid": "bookTitle"})]
    title = F.coalesce(text(book, "title"), text(book, "titleComplete"), sel(nodes, heading))
    people = contributors(cache, book)
    box = el("div", attrs={"data-testid": "description"})
    blurb = F.coalesce(
        blank_to_null(html_text(raw_text(book, "description"))),
        blank_to_null(html_text_of(nodes, F.coalesce(first(select(nodes, box, el(cls="Formatted"))), first(select(nodes, box))))),
        meta(nodes, "og:description", "description"))
    image = attr(first(select(nodes, el("div", "BookCover__image"), el("img", "ResponsiveImage"))), "src")
    page13 = F.coalesce(text(details, "isbn13"), F.get(F.filter(F.transform(
        F.col("_blobs"), lambda b: F.replace(clean(raw_text(b, "isbn")), F.lit("-"), F.lit(""))), lambda i: F.length(i) == 13), 0))
    blob_list = F.try_parse_json(F.to_json(F.col("_blobs")))
    found = probe([
        ("the __NEXT_DATA__ Apollo cache's work record", F.size(as_map(work)) > 0, origin_in(work)),
        ("its book record (details included)", F.size(as_map(book)) > 0, origin_in(book)),
        ("the JSON-LD Book blocks", F.size("_blobs") > 0, origin_in(blob_list)),
        ("the book page DOM and og:/meta tags", F.size("nodes") > 0, origin_of(nodes))])
    fuzzy = F.coalesce("fuzzy", F.lit(False)) if "fuzzy" in df.columns else F.lit(False)
    web = text(book, "webUrl")
    usable = ((F.size("cache") > 0) | sel(nodes, heading).isNotNull()) & verify_lax(F.col("isbn13"), page13, fuzzy)
    df = compute_once(df, _usable=usable).where("_usable")
    df = compute_once(df, _origin=found, _title=title, _people=people)
    listed = F.slice(sels(nodes, [el("span", "ContributorLink__name")]), 1, 1)
    return shaped(
        df, "goodreads", book_url=F.when(F.contains(web, F.lit("/book/show/")), web).otherwise(url), title=F.col("_title"),
        authors=F.when(F.size("_people") > 0, F.col("_people")).otherwise(listed), publisher=text(details, "publisher"),
        date_of_publication=published_date(raw_text(details, "publicationTime")), language=named(details, "language"),
        genres=dedupe(F.transform(elements(book, "bookGenres"), lambda g: clean(raw_text(g, "genre", "name")))),
        blurb=blank_to_null(drop_librarian_note(blurb)), origin=F.col("_origin.origin"), origin_layers=F.col("_origin.searched"),
        covers=first_collected("goodreads", url, offers(raw_text(book, "imageUrl")), offers(image),
                               offers(meta(nodes, "og:image", "twitter:image"))),
        reviews=reviews_in(cache, url), work_id=work_id(nodes, work),
        hint_title=F.when(~fuzzy, search_title(F.col("_title"))), hint_isbn10=F.col("isbn10"), confirmed=~fuzzy)


def edition_rows(pages: DataFrame) -> DataFrame:
    """Edition listing pages ``(work_id, page_no, url, html)`` to one row per edition."""
    nodes = F.col("nodes")
    df = parsed(pages).select("work_id", "page_no", "url", "nodes",
                              F.posexplode(select(nodes, el("div", ["elementList", "clearFix"]))).alias("at", "box"))
    box = F.col("box")
    rows = select_in(nodes, box, el("div", "dataRow"))

    def labelled(row: Column) -> Column:
        title = first(select_in(nodes, row, el("div", "dataTitle")))
        whole, label = text_of(nodes, row), text_of(nodes, title)
        rest = F.trim(F.regexp_replace(F.substring(whole, F.length(label) + 1, F.length(whole)), "^\\s+", ""))
        key = F.lower(F.regexp_replace(label, ":+$", ""))
        return F.struct(F.when(title.isNull(), F.lit("")).otherwise(key).alias("k"),
                        F.when(title.isNull(), whole).otherwise(rest).alias("v"))

    pairs = F.transform(rows, labelled)
    published = published_by(F.get(F.filter(F.col("pairs"), lambda p: (p["k"] == "")
                                            & F.startswith(F.lower(p["v"]), F.lit("published"))), 0)["v"])
    image = attr(first(select_in(nodes, box, el("div", "leftAlignedImage"), el("img"))), "src")
    return compute_once(compute_once(df, pairs=pairs), published=published).select(
        "work_id", (F.col("page_no") * 100_000 + F.col("at")).cast("bigint").alias("pos"),
        blank_to_null(F.col("published.publisher")).alias("publisher"), F.col("published.date").alias("date"),
        F.get(F.filter("pairs", lambda p: p["k"] == "edition language"), 0)["v"].alias("language"),
        absolute(F.col("url"), image).alias("image"))


def search_rows(pages: DataFrame) -> DataFrame:
    """Result pages ``(isbn13, html)`` to candidate rows."""
    nodes = F.col("nodes")
    rows = F.array_distinct(F.concat(
        F.transform(select(nodes, el("tr", has=["itemtype"])), lambda n: n["pos"]),
        F.transform(select(nodes, el("table", "tableList"), el("tr")), lambda n: n["pos"])))
    df = parsed(pages).select("isbn13", "nodes", F.posexplode(F.transform(F.sort_array(rows), lambda p: F.get(nodes, p))).alias("pos", "row"))
    link = first(select_in(nodes, F.col("row"), el("a", "bookTitle")))
    df = compute_once(df, link=link).where(F.col("link").isNotNull())
    link = F.col("link")
    named_title = text_of(nodes, first(select_in(nodes, link, el("span", attrs={"itemprop": "name"}))))
    people = lambda *chain: F.transform(select_in(nodes, F.col("row"), *chain), lambda n: text_of(nodes, n))
    return df.select(
        "isbn13", F.col("pos").cast("bigint").alias("pos"),
        F.coalesce(blank_to_null(named_title), text_of(nodes, link)).alias("title"),
        dedupe(keep_nonblank(F.concat(people(el("a", "authorName"), el("span", attrs={"itemprop": "name"})),
                                      people(el("a", "authorName"))))).alias("authors"),
        absolute(F.lit(SITE), strip_query(attr(link, "href"))).alias("url"))
