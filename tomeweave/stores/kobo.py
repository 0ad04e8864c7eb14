"""E-book pages: a doubly encoded attribute payload, labelled rows, search cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import KOBO_DROP_CRUMBS
from ..functions import isbn
from ..functions.core import blank_to_null, compute_once, keep_nonblank, let
from ..functions.dates import iso_date, stamp_date
from ..functions.lists import dedupe, first_wins_map
from ..functions.markup import (attr, el, first, html_text_of, meta, origin_of, sel, select, select_in, sels, strings,
                                text_of)
from ..functions.payload import (as_map, as_object, breadcrumb_names, jsonld, list_or_text, loads,
                                 loads_escaped, member, named, of_type, origin_in, origin_in_map, raw_text, text)
from ..functions.text import drop_bold_marks, fold, language_name, tidy, with_heading
from ..functions.urls import absolute, slug_base, strip_query
from ..operators.origin import probe
from .common import REVIEW, any_found, collect, parsed, shaped

STORE = "https://www.kobo.com/us/en"
WIDGET = [el("div", attrs={"data-kobo-gizmo": "RatingAndReviewWidget"}, has=["data-kobo-gizmo-config"])]


def widget(nodes: Column, name: str) -> Column:
    """The JSON object in a widget's configuration attribute."""
    node = first(select(nodes, el("div", attrs={"data-kobo-gizmo": name}, has=["data-kobo-gizmo-config"])))
    return loads_escaped(attr(node, "data-kobo-gizmo-config"))


def nested(config: Column, key: str) -> Column:
    """A member that is an object, or JSON text of one."""
    return F.coalesce(as_object(member(config, key)), as_object(loads(raw_text(config, key))))


def labelled_rows(nodes: Column) -> Column:
    """Secondary rows by label; the one row without a colon is the publisher."""

    def row(item: Column) -> Column:
        raw = text_of(nodes, item)
        label = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.get(F.split(raw, ":", 2), 0))), "[^a-z0-9]+", "_"), "^_+|_+$", "")
        value = F.trim(F.coalesce(F.get(F.split(raw, ":", 2), 1), F.lit("")))
        plain = ~F.contains(raw, F.lit(":"))
        return F.struct(F.when(plain, F.lit("publisher")).otherwise(label).alias("k"),
                        F.when(plain, F.trim(raw)).otherwise(F.regexp_replace(value, "^\\s+", "")).alias("v"))

    rows = F.transform(select(nodes, el("div", "bookitem-secondary-metadata"), el("li")), row)
    return first_wins_map(F.filter(rows, lambda r: (r["k"] != "") & (r["v"] != "")))


def is_book_page(nodes: Column) -> Column:
    return any_found(nodes, [el("div", attrs={"data-kobo-gizmo": "RatingAndReviewWidget"})], [el("h1", ["title", "product-field"])])


def canonical(nodes: Column, fallback: Column) -> Column:
    """Canonical address without tracking; a search address is never canonical."""
    href = strip_query(attr(first(select(nodes, el("link", attrs={"rel": "canonical"}))), "href"))
    return F.when((href != "") & ~F.contains(href, F.lit("/search")), href).otherwise(fallback)


def authors(nodes: Column, book: Column, work: Column) -> Column:
    """Payload authors topped up by page contributors whose role says author."""
    listed = F.when(member(book, "author").isNotNull(), list_or_text(book, "author")).otherwise(list_or_text(work, "author"))
    area = el("span", ["authors", "product-field"])

    def credited(a: Column) -> Column:
        holder = F.element_at(F.filter(nodes, lambda n: (n["tag"] == "li") & (n["pos"] < a["pos"]) & (n["last"] >= a["pos"])), -1)
        tag = first(select_in(nodes, holder, el("span", "mobile-library-tag")))
        role = F.lower(text_of(nodes, tag))
        return F.when((role == "") | F.contains(role, F.lit("author")), text_of(nodes, a)).otherwise(F.lit(""))

    shown = keep_nonblank(F.transform(select(nodes, area, el("a", "contributor-name")), credited))
    known = F.transform(listed, fold)
    return dedupe(F.concat(listed, F.filter(shown, lambda s: ~F.array_contains(known, fold(s)))))


def genres(nodes: Column, blobs: Column, book: Column) -> Column:
    """Payload genres, else breadcrumbs (the first trail loses its leaf), else rankings."""
    trails = F.transform(of_type(blobs, ["BreadcrumbList"]), lambda b, i: F.struct(
        F.filter(breadcrumb_names(b), lambda n: ~fold(n).isin(KOBO_DROP_CRUMBS)).alias("names"), i.alias("at")))
    crumbs = F.flatten(F.transform(trails, lambda t: F.when(t["at"] == 0, F.slice(
        t["names"], F.lit(1), F.greatest(F.size(t["names"]) - 1, F.lit(0)))).otherwise(t["names"])))
    some = lambda c: F.when(F.size(c) > 0, c)
    return dedupe(F.coalesce(some(list_or_text(book, "genre")), some(crumbs), sels(nodes, [el("ul", "category-rankings"), el("li"), el("a")])))


def blurb(nodes: Column, work: Column) -> Column:
    spots = [el("div", has=["data-full-synopsis"]), el("div", "synopsis-description"), el("div", attrs={"id": "synopsis-desc"})]
    texts = [blank_to_null(tidy(drop_bold_marks(html_text_of(nodes, first(select(nodes, s)))))) for s in spots]
    return F.coalesce(*texts, text(work, "description"), meta(nodes, "og:description"))


def reviews(nodes: Column) -> Column:
    def row(node: Column, i: Column) -> Column:
        inner = lambda t: text_of(nodes, first(select_in(nodes, node, t)))
        body = inner(el(cls="review-text"))
        return F.struct(
            i.cast("bigint").alias("pos"), F.lit("").alias("review_id"),
            let(body, lambda b: F.when(b == "", b).otherwise(with_heading(inner(el("h2", "review-title")), b))).alias("text"),
            blank_to_null(inner(el("span", "review-author"))).alias("reviewer"),
            blank_to_null(inner(el(cls="rating-average"))).alias("rating"),
            iso_date(inner(el("span", "review-date"))).alias("date"), F.lit(None).cast("string").alias("url"))

    return F.filter(F.transform(select(nodes, el("div", "review-item")), row).cast(f"array<{REVIEW}>"), lambda r: r["text"] != "")


def search_rows(pages: DataFrame) -> DataFrame:
    """Result pages ``(isbn13, html)`` to cards."""
    nodes = F.col("nodes")
    listed, boxed = select(nodes, el("div", attrs={"id": "^list-item-"})), select(nodes, el("div", attrs={"data-testid": "book-card-search-result-items"}))
    df = parsed(pages).select("isbn13", "nodes", F.posexplode(F.when(F.size(listed) > 0, listed).otherwise(boxed)).alias("pos", "card"))
    inner = lambda *c: first(select_in(nodes, F.col("card"), *c))
    link = F.coalesce(inner(el("a", attrs={"data-testid": "title"})), inner(el("a", attrs={"href": "~/(?:ebook|audiobook)/"})))
    df = df.withColumn("link", link).where(F.col("link").isNotNull())
    image = F.coalesce(inner(el("img", attrs={"data-testid": "cover"})), inner(el("img")))
    people = F.transform(select_in(nodes, F.col("card"), el(attrs={"data-testid": "authors"}), el("a")), lambda a: text_of(nodes, a))
    href = absolute(F.lit(STORE), attr(F.col("link"), "href"))
    return df.select("isbn13", F.col("pos").cast("bigint").alias("pos"), href.alias("url"),
                     F.coalesce(blank_to_null(tidy(attr(F.col("link"), "aria-label"))), tidy(strings(nodes, F.col("link"), " "))).alias("title"),
                     people.alias("authors"), F.coalesce(attr(image, "src"), F.lit("")).alias("image"),
                     isbn.uuid_or_blank(attr(F.col("card"), "data-cross-revision-id")).alias("review_key"),
                     F.contains(href, F.lit("/ebook/")).alias("ebook"))


def sibling_images(cards: DataFrame, records: DataFrame) -> DataFrame:
    """Covers of other editions of the same work: same address stem and agreeing authors."""
    from ..functions.text import authors_agree
    chosen = records.select("isbn13", F.col("book_url").alias("_url"), F.col("authors").alias("_authors"))
    joined = cards.join(chosen, "isbn13")
    return joined.where((F.col("image") != "") & (slug_base(F.col("url")) == slug_base(F.col("_url")))
                        & authors_agree(F.col("_authors"), F.col("authors"))).select("isbn13", "pos", F.col("image").alias("url"))


def to_records(pages: DataFrame) -> DataFrame:
    df = parsed(pages)
    nodes, html = F.col("nodes"), F.col("html")
    df = compute_once(df, config=widget(nodes, "RatingAndReviewWidget"))
    df = compute_once(df, **{"gbook": nested(F.col("config"), "googleBook"), "product": nested(F.col("config"), "googleProduct"),
                         "rows": labelled_rows(nodes), "blobs": jsonld(html), "page_url": canonical(nodes, F.col("url"))})
    df = compute_once(df, work=as_object(member(F.col("gbook"), "workExample")))
    book, product, work, rows = (F.col(c) for c in ("gbook", "product", "work", "rows"))
    shown = meta(nodes, "og:title", "twitter:title")
    main = F.coalesce(text(book, "name"), sel(nodes, [el("h1", ["title", "product-field"])]),
                      F.trim(F.get(F.split(shown, r"\s+eBook by\s+", 2), 0)))
    subtitle = F.coalesce(text(work, "alternativeHeadline"), sel(nodes, [el("span", ["subtitle", "product-field"])]))
    df = df.withColumn("_main", main)
    found = probe([
        ("the data-kobo-gizmo-config googleBook blob", F.size(as_map(book)) > 0, origin_in(book)),
        ("its workExample record", F.size(as_map(work)) > 0, origin_in(work)),
        ("the googleProduct blob", F.size(as_map(product)) > 0, origin_in(product)),
        ("the injected ld+json blocks", F.size("blobs") > 0, origin_in(F.try_parse_json(F.to_json("blobs")))),
        ("the bookitem-secondary-metadata DOM rows", F.size(rows) > 0, origin_in_map(rows)),
        ("the page DOM and og:/meta tags", F.size(nodes) > 0, origin_of(nodes))])
    image = F.coalesce(first(select(nodes, el("div", "main-product-image"), el("img", "cover-image"))), first(select(nodes, el("img", "cover-image"))))
    urls = F.array(raw_text(work, "image"), raw_text(product, "image"), raw_text(work, "thumbnailUrl"), attr(image, "src"),
                   meta(nodes, "og:image", "twitter:image"))
    df = df.withColumn("_origin", found)
    return shaped(
        df, "kobo", book_url=F.col("page_url"), title=F.concat_ws(": ", F.col("_main"), F.when(F.col("_main").isNotNull(), subtitle)),
        authors=authors(nodes, book, work),
        publisher=F.coalesce(named(book, "publisher"), named(product, "brand"), F.try_element_at(rows, F.lit("publisher"))),
        date_of_publication=F.coalesce(stamp_date(raw_text(work, "datePublished")), stamp_date(raw_text(product, "releasedate")),
                                       stamp_date(F.try_element_at(rows, F.lit("release_date")))),
        language=F.coalesce(F.try_element_at(rows, F.lit("language")), language_name(raw_text(book, "inLanguage"))),
        genres=genres(nodes, F.col("blobs"), book), blurb=blurb(nodes, work), origin=F.col("_origin.origin"), origin_layers=F.col("_origin.searched"),
        covers=collect("kobo", F.lit(STORE), urls), reviews=reviews(nodes), hint_title=F.col("_main"), hint_isbn10=F.col("isbn10"),
        confirmed=F.col("_main").isNotNull())
