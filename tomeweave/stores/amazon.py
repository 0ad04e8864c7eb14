"""Product pages with a detail table, detail bullets, or both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import AMAZON_DROP_CRUMBS
from ..functions import isbn
from ..functions.arrow import bracket_block
from ..functions.core import blank_to_null, compute_once, keep_nonblank, let, some
from ..functions.dates import iso_date, reviewed_on
from ..functions.lists import dedupe, first_label, first_wins_map
from ..functions.markup import (attr, el, first, meta, origin_of, prose_of, sel, select, select_in, sels, strings,
                                text_of)
from ..functions.payload import elements, loads, object_keys, origin_in_map, raw_text
from ..functions.text import drop_screen_reader_phrase, flip_name, label_text, with_heading
from ..functions.urls import absolute
from ..operators.matching import verify_isbn
from ..operators.origin import probe
from .common import REVIEW, first_collected, offers, parsed, shaped

SITE = "https://www.amazon.com"
TITLE_TAG = r"(?is)Amazon\.com:\s*(.+?):\s*(97[89]\d{10}):\s*(.+?):\s*Books"
TABLES = [[el("table", "prodDetTable"), el("tr")], [el(attrs={"id": "productDetails_detailBullets_sections1"}), el("tr")],
          [el(attrs={"id": "productDetails_techSpec_section_1"}), el("tr")], [el("table", "a-keyvalue"), el("tr")]]
BULLETS = [[el(attrs={"id": "detailBullets_feature_div"}), el("li"), el("span", "a-list-item")],
           [el(attrs={"id": "detailBulletsWrapper_feature_div"}), el("li"), el("span", "a-list-item")]]


def detail_rows(nodes: Column) -> Column:
    """Labelled rows of both layouts as ``array<struct<k,v,node>>``, tables first."""

    def table_row(row: Column) -> Column:
        head, cell = first(select_in(nodes, row, el("th"))), first(select_in(nodes, row, el("td")))
        return F.when(head.isNotNull() & cell.isNotNull(), F.struct(
            F.lower(label_text(strings(nodes, head, " "))).alias("k"), label_text(strings(nodes, cell, " ")).alias("v"),
            row["pos"].alias("at"), F.lit(1).alias("layout")))

    def bullet(item: Column) -> Column:
        bold = first(select_in(nodes, item, el("span", "a-text-bold")))
        rest = F.slice(nodes, bold["last"] + 2, F.greatest(item["last"] - bold["last"], F.lit(0)))
        value = first(F.filter(rest, el("span")))
        return F.when(bold.isNotNull(), F.struct(
            F.lower(label_text(strings(nodes, bold, " "))).alias("k"), label_text(strings(nodes, value, " ")).alias("v"),
            item["pos"].alias("at"), F.lit(0).alias("layout")))

    found = F.concat(*[F.transform(select(nodes, *c), table_row) for c in TABLES],
                     *[F.transform(select(nodes, *c), bullet) for c in BULLETS])
    return F.filter(found, lambda r: r.isNotNull() & (r["k"] != ""))


def detail_map(rows: Column) -> Column:
    """Label map: the last bullet of a label, else its first table row."""
    bullets = F.reverse(F.filter(rows, lambda r: r["layout"] == 0))
    tables = F.filter(rows, lambda r: r["layout"] == 1)
    return first_wins_map(F.transform(F.concat(bullets, tables), lambda r: F.struct(r["k"], r["v"])))


def image_island(html: Column) -> Column:
    """Text from the opening bracket of the inline image list, at most 500,000 characters of it."""
    at = F.regexp_instr(html, F.lit(r"['\"]colorImages['\"]\s*:\s*\{\s*['\"]initial['\"]\s*:\s*\["))
    tail = F.substring(html, at, 500_200)
    return F.when(at > 0, F.regexp_replace(tail, r"(?s)^[^\[]*", ""))


def authors(nodes: Column, tag_authors: Column) -> Column:
    linked = sels(nodes, [el(attrs={"id": "bylineInfo"}), el("span", "author"), el("a", "a-link-normal")],
                  [el(attrs={"id": "bylineInfo_feature_div"}), el("span", "author"), el("a")])
    byline = first(select(nodes, el(attrs={"id": "bylineInfo"})))
    binding = first(F.filter(nodes, lambda n: (n["tag"] == "#text") & F.contains(n["text"], F.lit("Format: "))
                             & (n["pos"] > byline["pos"])))
    anchors = F.filter(select(nodes, el(attrs={"id": "bylineInfo"}), el("a", attrs={
        "href": r"~(?i)/e/B[A-Z0-9]{9}|field-author|/author/"})), lambda a: F.coalesce(a["pos"] < binding["pos"], F.lit(True)))
    by_cut = dedupe(F.transform(anchors, lambda a: text_of(nodes, a)))
    parts = keep_nonblank(F.transform(F.split(F.coalesce(tag_authors, F.lit("")), ","), lambda p: F.trim(p)))
    return F.coalesce(some(linked), some(by_cut), dedupe(flip_name(parts)))


def genres(nodes: Column, rows: Column) -> Column:
    """Breadcrumbs, then the categories of the best-seller rank rows."""
    crumbs = F.filter(sels(nodes, [el(attrs={"id": "wayfinding-breadcrumbs_feature_div"}), el("ul"), el("li"),
                                   el("span", "a-list-item"), el("a")]), lambda c: ~F.lower(c).isin(AMAZON_DROP_CRUMBS))
    ranked = F.flatten(F.transform(F.filter(rows, lambda r: F.contains(r["k"], F.lit("best sellers rank"))), lambda r: F.transform(
        select_in(nodes, F.get(nodes, r["at"]), el("a")), lambda a: text_of(nodes, a))))
    named = F.transform(F.filter(ranked, lambda t: (t != "") & ~t.rlike(r"(?i)^see top \d+")),
                        lambda t: F.trim(F.regexp_replace(t, r"\s*\((?:Books|Kindle Store)\)\s*$", "")))
    return dedupe(F.concat(crumbs, named))


def reviews(nodes: Column) -> Column:
    hook = lambda tag, value: el(tag, attrs={"data-hook": value})

    def row(node: Column, i: Column) -> Column:
        inner = lambda *chain: first(select_in(nodes, node, *chain))
        body = F.coalesce(inner(hook("div", "reviewRichContentContainer")), inner(hook("span", "review-body")),
                          inner(hook("div", "reviewText")))
        heading = text_of(nodes, F.coalesce(inner(hook("h5", "reviewTitle")), inner(hook(None, "review-title"))))
        prose = drop_screen_reader_phrase(prose_of(nodes, body))
        stars = F.coalesce(inner(hook("i", "review-star-rating"), el("span", "a-icon-alt")),
                           inner(hook("i", "cmps-review-star-rating"), el("span", "a-icon-alt")))
        own = F.trim(F.coalesce(attr(node, "id"), F.lit("")))
        return F.struct(
            i.cast("bigint").alias("pos"), own.alias("review_id"),
            let(prose, lambda x: F.when(x == "", x).otherwise(with_heading(heading, x, 40))).alias("text"),
            blank_to_null(text_of(nodes, inner(el("span", "a-profile-name")))).alias("reviewer"),
            blank_to_null(text_of(nodes, stars)).alias("rating"),
            iso_date(reviewed_on(text_of(nodes, inner(hook("span", "review-date"))))).alias("date"),
            F.when(own != "", F.concat(F.lit(SITE + "/gp/customer-reviews/"), own)).alias("url"))

    found = F.filter(nodes, lambda n: n["tag"].isin("div", "li") & (attr(n, "data-hook") == "review"))
    return F.filter(F.transform(found, row).cast(f"array<{REVIEW}>"), lambda r: r["text"] != "")


def load(pages: DataFrame) -> DataFrame:
    """Pages with node list, detail rows and map, title-tag fields, canonical address and image list."""
    nodes, html = F.col("nodes"), F.col("html")
    head = F.substring(html, 1, 4096)
    df = compute_once(compute_once(parsed(pages), detail_rows=detail_rows(nodes)), details=detail_map(F.col("detail_rows")))
    canonical = absolute(F.col("url"), attr(first(select(nodes, el("link", attrs={"rel": "canonical"}))), "href"))
    return df.withColumns({
        "tag_title": blank_to_null(F.regexp_extract(head, TITLE_TAG, 1)), "tag_isbn13": blank_to_null(F.regexp_extract(head, TITLE_TAG, 2)),
        "tag_authors": blank_to_null(F.regexp_extract(head, TITLE_TAG, 3)),
        "page_url": F.coalesce(blank_to_null(canonical), F.col("url")),
        "images": loads(bracket_block(image_island(html)))})


def verdict() -> Column:
    """Does a loaded page own the wanted identifier?  See ``operators.matching.verify_isbn``."""
    own13 = F.coalesce(first_label(F.col("details"), ["isbn-13", "isbn13"]), F.col("tag_isbn13"))
    wanted10 = F.coalesce(F.col("isbn10"), isbn.isbn10_of(F.col("isbn13")))
    return verify_isbn(F.col("isbn13"), wanted10, own13, first_label(F.col("details"), ["isbn-10", "isbn10"]))


def to_records(pages: DataFrame) -> DataFrame:
    """``pages(isbn13, isbn10, url, html)`` of chosen product pages."""
    df = load(pages)
    nodes, rows, details, url = F.col("nodes"), F.col("detail_rows"), F.col("details"), F.col("page_url")
    title = F.coalesce(sel(nodes, [el("span", attrs={"id": "productTitle"})]), F.col("tag_title"))
    found = probe([("the merged product-detail map", F.size(details) > 0, origin_in_map(details)),
                   ("the page DOM and og:/meta tags", F.size(nodes) > 0, origin_of(nodes))])
    printed = first_label(details, ["country of origin", "country/region of origin"])
    asin = isbn.asin_of_url(url)
    proses = [prose_of(nodes, first(select(nodes, *chain))) for chain in (
        [el(attrs={"id": "bookDescription_feature_div"}), el("div", ["a-expander-content", "a-expander-partial-collapse-content"])],
        [el(attrs={"id": "bookDescription_feature_div"})],
        [el(attrs={"id": "editorialReviews_feature_div"}), el("div", "a-expander-content")])]
    described = meta(nodes, "og:description", "description")
    blurb = F.coalesce(*[let(p, lambda x: F.when(F.length(x) >= 40, x)) for p in proses],
                       F.when(~F.startswith(F.lower(described), F.lit("amazon.com:")), described))
    landing = first(select(nodes, el("img", attrs={"id": "landingImage"})))
    physical = lambda e: F.concat(F.lit("https://m.media-amazon.com/images/I/"), raw_text(e, "physicalIdForMedia"), F.lit(".jpg"))
    island = F.transform(elements(F.col("images")), lambda e: F.coalesce(
        *[blank_to_null(raw_text(e, k)) for k in ("hiRes", "large", "thumb")], physical(e)))
    shown = F.concat(F.array(attr(landing, "data-old-hires")), F.coalesce(
        object_keys(attr(landing, "data-a-dynamic-image")), F.array().cast("array<string>")), F.array(attr(landing, "src")))
    df = compute_once(df, _title=title, _origin=found, _asin=asin)
    return shaped(
        df, "amazon", book_url=url, title=F.col("_title"), authors=authors(nodes, F.col("tag_authors")),
        publisher=first_label(details, ["publisher"]), language=first_label(details, ["language"]),
        date_of_publication=iso_date(first_label(details, ["publication date", "release date"])),
        origin=F.coalesce(printed, F.col("_origin.origin")), origin_layers=F.col("_origin.searched"),
        genres=genres(nodes, rows), blurb=blurb, reviews=reviews(nodes),
        covers=first_collected("amazon", url, island, shown, offers(meta(nodes, "og:image", "twitter:image"))),
        hint_title=F.col("_title"), hint_isbn10=F.when(isbn.is_valid(F.col("_asin")), F.col("_asin")).otherwise(F.col("isbn10")),
        confirmed=F.col("_title").isNotNull())


def search_rows(pages: DataFrame) -> DataFrame:
    """Result pages ``(isbn13, rung, html)`` to candidate rows in the shop's order."""
    nodes = F.col("nodes")
    found = F.filter(nodes, lambda n: (n["tag"] == "div") & attr(n, "data-asin").isNotNull() & (
        (attr(n, "data-component-type") == "s-search-result") | attr(n, "data-index").isNotNull()))
    df = parsed(pages).select("isbn13", "rung", "nodes", F.posexplode(found).alias("pos", "row"))
    name = F.coalesce(first(select_in(nodes, F.col("row"), el("h2"), el("span"))), first(select_in(nodes, F.col("row"), el("h2"))))
    return df.select("isbn13", "rung", F.col("pos").cast("bigint").alias("pos"),
                     F.upper(F.trim(attr(F.col("row"), "data-asin"))).alias("asin"), text_of(nodes, name).alias("title")).where(
        F.col("asin").rlike("^[A-Z0-9]{10}$"))


def sibling_links(pages: DataFrame) -> DataFrame:
    """Links to other editions ``(page_id, url, format)``, for ``artefacts.sibling_editions``."""
    nodes = F.col("nodes")
    swatches = select(nodes, el(attrs={"id": "tmmSwatches"}), el(attrs={"id": "^tmm-grid-swatch-"}))
    links = F.flatten(F.transform(swatches, lambda s: F.transform(select_in(nodes, s, el("a")), lambda a: F.struct(
        attr(a, "href").alias("href"), F.regexp_replace(attr(s, "id"), "^tmm-grid-swatch-", "").alias("format")))))
    return parsed(pages).select(F.col("isbn13").alias("page_id"), "url", F.explode(links).alias("l")).select(
        "page_id", F.when(F.startswith("l.href", F.lit("javascript:")), F.col("l.href")).otherwise(
            absolute(F.col("url"), F.col("l.href"))).alias("url"), "l.format")
