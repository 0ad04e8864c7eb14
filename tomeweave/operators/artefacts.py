"""Covers, reviews and genres of each (book, source)."""

from __future__ import annotations

from functools import reduce

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import (AMAZON_COVER_CAP, ARTEFACT_INFIX, COVER_CAP, IMAGE_CONTENT_TYPES, IMAGE_MAGIC,
                     MIN_COVER_BYTES, MIN_REVIEW_CHARS, PLACEHOLDER_WORDS, PRINT_FORMATS,
                     SIBLING_EDITIONS, SOURCE_ORDER)
from ..functions.core import alternation, lookup
from ..functions.text import casefold, file_name, fold
from ..functions.urls import absolute, full_size, image_key
from ..session import checkpoint_folder
from .skew import SPAN, first_per_key, numbered, top_per_key

PAIR = ["isbn13", "source"]

#: identity rule, full-size rule and cap of each source's cover collection
COLLECTORS = {s: (image_key, full_size, AMAZON_COVER_CAP if s == "amazon" else COVER_CAP)
              for s in SOURCE_ORDER}


def by_source(source: Column, build) -> Column:
    """One expression per source, chosen by the source column."""
    return reduce(lambda acc, s: acc.when(source == s, build(s)), SOURCE_ORDER[1:],
                  F.when(source == SOURCE_ORDER[0], build(SOURCE_ORDER[0])))


# ------------------------------------------------------------------ covers
def is_placeholder(url: Column) -> Column:
    return F.lower(url).rlike(alternation(PLACEHOLDER_WORDS))


def catalogue_has_cover(url: Column) -> Column:
    """The catalogue marks "no cover" by an image id that is not positive."""
    number = F.regexp_extract(url, r"(?i)/b/id/(-?\d+)-[LMS]\.jpg", 1)
    return (number == "") | (F.nullif(number, F.lit("")).try_cast("bigint") > 0)


def collect_covers(offered: DataFrame, collectors: dict = COLLECTORS) -> DataFrame:
    """Offered image URLs to kept covers: one per artwork, first offer wins, capped by source.

    ``offered(isbn13, source, pos, base, url)``.  Both steps are per-key limits, so a hot pair
    shrinks before each shuffle.
    """
    source = F.col("source")
    identity = by_source(source, lambda s: collectors[s][0](s, F.col("url")))
    cap = by_source(source, lambda s: F.lit(collectors[s][2]))
    usable = (offered.withColumn("url", absolute(F.col("base"), F.col("url")))
              .where((F.col("url") != "") & ~is_placeholder(F.col("url")))
              .withColumn("url", by_source(source, lambda s: collectors[s][1](s, F.col("url"))))
              .withColumn("image_key", identity).where(F.coalesce("image_key", F.lit("")) != ""))
    distinct = first_per_key(usable, [*PAIR, "image_key"], ["pos"])
    most = max(c[2] for c in collectors.values())
    return top_per_key(distinct, PAIR, ["pos"], most, "n").where(F.col("n") <= cap)


def first_usable(covers: DataFrame, fetches: DataFrame) -> DataFrame:
    """Among equivalent URLs the first that arrived whole and is no placeholder pixel.

    ``covers(isbn13, source, cover_no, alternatives)``, ``fetches(url, ok, bytes)`` with one
    row per URL.  A cover without a usable URL marks its pair incomplete.
    """
    tries = covers.select(*PAIR, "cover_no", F.posexplode("alternatives").alias("alt", "url"))
    known = tries.join(fetches, "url", "left")
    good = F.coalesce(F.col("ok") & (F.col("bytes") >= MIN_COVER_BYTES), F.lit(False))
    return known.groupBy(*PAIR, "cover_no").agg(
        F.min_by("url", F.when(good, F.col("alt"))).alias("url"),
        F.coalesce(F.min(F.when(good, F.col("alt"))) > 0, F.lit(False)).alias("used_fallback"),
        (F.count_if(good) == 0).alias("incomplete"))


def image_ext(content: Column, content_type: Column, url: Column) -> Column:
    """File extension from the bytes, then the content type, then the URL, else jpg."""
    head = F.hex(F.substring(content, 1, 512))
    magic = reduce(lambda acc, m: acc.when(head.startswith(m[0]), F.lit(m[1])), IMAGE_MAGIC[1:],
                   F.when(head.startswith(IMAGE_MAGIC[0][0]), F.lit(IMAGE_MAGIC[0][1])))
    at = lambda start, size: F.substring(head, 2 * start + 1, 2 * size)
    is_svg = (head.rlike("^(?:20|09|0A|0B|0C|0D)*(?:3C737667|3C3F786D6C)")
              & head.rlike("^(?:..)*?3C737667"))
    by_bytes = (magic.when((at(0, 4) == "52494646") & (at(8, 4) == "57454250"), F.lit("webp"))
                .when((at(4, 4) == "66747970") & at(8, 12).rlike("^(?:..)*?61766966"), F.lit("avif"))
                .when(is_svg, F.lit("svg")))
    subtype = F.lower(F.trim(F.get(F.split(F.coalesce(content_type, F.lit("")), ";"), 0)))
    suffix = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")),
                                      r"(?i)\.(jpe?g|png|gif|webp|avif|bmp|tiff?|svg)(?:[?#]|$)", 1))
    by_url = F.when(suffix == "jpeg", "jpg").when(suffix == "tif", "tiff").otherwise(F.nullif(suffix, F.lit("")))
    return F.coalesce(by_bytes, lookup(IMAGE_CONTENT_TYPES, subtype), by_url, F.lit("jpg"))


def prefer_named_image(images: DataFrame) -> DataFrame:
    """Per page the image whose alternative text names the book, else the first image.

    ``images(page_id, pos, url, alt, title)``.
    """
    shown = F.regexp_extract("alt", r"(?i)^\s*Book cover for\s+(.+?)\s+by\s+.+?\s*$", 1)
    names_book = (shown != "") & (fold(shown) == fold(F.col("title")))
    return first_per_key(images.withColumn("names_book", names_book), ["page_id"],
                         [F.desc("names_book"), "pos"])


def sibling_editions(links: DataFrame) -> DataFrame:
    """Other print editions of a page, best format first, two at most.

    ``links(page_id, url, format)``.
    """
    rank = lookup({k: str(v) for k, v in PRINT_FORMATS.items()}, F.upper(F.col("format"))).cast("int")
    kept = links.where(~F.startswith(F.col("url"), F.lit("javascript:"))).withColumn("format_rank", rank)
    return top_per_key(kept.where(F.col("format_rank").isNotNull()), ["page_id"], ["format_rank", "url"],
                       SIBLING_EDITIONS, "n")


# ------------------------------------------------------------------ reviews
def usable_reviews(reviews: DataFrame) -> DataFrame:
    """Reviews whose clean text reaches the length its source asks for."""
    least = by_source(F.col("source"), lambda s: F.lit(MIN_REVIEW_CHARS[s]))
    return reviews.where(F.length("text") >= F.greatest(F.lit(1), F.coalesce(least, F.lit(1))))


def review_key(source: Column) -> Column:
    """What makes two reviews the same, for the sources with a single key."""
    text = F.col("text")
    collapsed = F.trim(F.regexp_replace(text, "\\s+", " "))
    own_id = F.nullif(F.trim(F.coalesce("review_id", F.lit(""))), F.lit(""))
    amazon = F.coalesce(own_id, F.concat(F.lit("body:"), casefold(F.substring(text, 1, 160))))
    kobo = F.concat_ws("\x01", casefold(F.trim(F.coalesce("reviewer", F.lit("")))),
                       F.trim(F.coalesce("date", F.lit(""))), F.substring(casefold(collapsed), 1, 180))
    audible = F.substring(fold(text), 1, 400)
    return F.when(source == "amazon", amazon).when(source == "kobo", kobo).when(source == "audible", audible).otherwise(
        F.coalesce(own_id, text))


def dedupe_reviews(reviews: DataFrame) -> DataFrame:
    """First review of each key per (book, source), by the key of its source."""
    keyed = reviews.withColumn("_key", review_key(F.col("source")))
    return first_per_key(keyed, [*PAIR, "_key"], ["pos"]).drop("_key")


def body_words(text: Column) -> Column:
    """The first 200 characters as lower-case words."""
    return F.lower(F.trim(F.regexp_replace(F.substring(text, 1, 200), r"(?U)\W+", " ")))


ROUNDS, GROUP_EDGES = 3, 200_000


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(*PAIR, "pos", F.explode(F.array(F.concat(F.lit("id "), "_id"), F.concat(F.lit("words "), "_words"))).alias("end"))


def _in_order(table: pa.Table) -> pa.Table:
    """The rule itself over the edges of one pair: an edge stays unless an earlier kept one has its id or words."""
    table = table.sort_by("pos")
    claimed, stays = set(), []
    for name, words in zip(table.column("_id").to_pylist(), table.column("_words").to_pylist()):
        free = ("i", name) not in claimed and ("w", words) not in claimed
        if free:
            claimed |= {("i", name), ("w", words)}
        stays.append(free)
    return table.select([*PAIR, "pos"]).filter(pa.array(stays, pa.bool_()))


def dedupe_reviews_either_key(reviews: DataFrame, rounds: int = ROUNDS, group_edges: int = GROUP_EDGES) -> DataFrame:
    """Keep a review unless its id *or* its opening words belong to an earlier kept one.

    Only kept reviews claim their keys, so this is a matching over (id, words) edges in review
    order.  Edges alone at both ends are settled at once.  In a round the edges that are first at
    both ends stay, and every edge that touches a claimed end leaves.  What is left of a pair after
    ``rounds`` rounds, chains mostly, is settled in order by one task if it has at most
    ``group_edges`` edges (short keys, no texts); a larger rest goes on in rounds until it has.
    """
    checkpoint_folder(reviews.sparkSession)
    named = F.nullif(F.trim(F.coalesce("review_id", F.lit(""))), F.lit(""))
    keyed = reviews.select(*PAIR, "pos", named.alias("_id"), body_words(F.col("text")).alias("_words"))
    # of equal (id, words) pairs only the first can ever stay
    edges = (keyed.withColumn("_id", F.coalesce(F.concat(F.lit("i:"), "_id"), F.concat(F.lit("w:"), "_words")))
             .groupBy(*PAIR, "_id", "_words").agg(F.min("pos").alias("pos")).checkpoint())
    shared = _ends(edges).groupBy(*PAIR, "end").agg(F.count(F.lit(1)).alias("_n"), F.min("pos").alias("_a"), F.max("pos").alias("_b")).where("_n > 1")
    meets = _ends(edges).join(shared.select(*PAIR, "end"), [*PAIR, "end"], "left_semi").select(*PAIR, "pos").distinct()
    left = edges.join(meets, [*PAIR, "pos"], "left_semi").checkpoint()
    kept = [edges.join(meets, [*PAIR, "pos"], "left_anti").select(*PAIR, "pos")]
    done = 0
    while not left.isEmpty():
        if done >= rounds:
            small = left.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") <= group_edges).select(*PAIR).checkpoint()
            kinds = ", ".join(f"{c} {left.schema[c].dataType.simpleString()}" for c in [*PAIR, "pos"])
            kept.append(left.join(small, PAIR, "left_semi").groupBy(*PAIR).applyInArrow(_in_order, kinds))
            left = left.join(small, PAIR, "left_anti").checkpoint()
            if left.isEmpty():
                break
        ends = _ends(left)
        first = (ends.groupBy(*PAIR, "end").agg(F.min("pos").alias("pos")).groupBy(*PAIR, "pos").agg(F.count(F.lit(1)).alias("_ends"))
                 .where("_ends = 2").drop("_ends").checkpoint())
        kept.append(first)
        claimed = ends.join(first, [*PAIR, "pos"], "left_semi").select(*PAIR, "end")
        lost = ends.join(claimed, [*PAIR, "end"], "left_semi").select(*PAIR, "pos").distinct()
        left = left.join(lost, [*PAIR, "pos"], "left_anti").checkpoint()
        done += 1
    return reviews.join(reduce(DataFrame.unionByName, kept), [*PAIR, "pos"], "left_semi")


def render_review() -> Column:
    """Headers that exist, a blank line, the text."""
    line = lambda label, c: F.concat(F.lit(f"{label}: "), F.nullif(F.col(c), F.lit("")))
    header = F.concat_ws("\n", line("Reviewer", "reviewer"), line("Rating", "rating"), line("Date", "date"),
                         line("URL", "url"))
    return F.when(header != "", F.concat(header, F.lit("\n\n"), F.col("text"))).otherwise(F.col("text"))


def number_reviews(reviews: DataFrame, cap: int | None = None) -> DataFrame:
    """Dense 1-based numbers per (book, source), with an optional cap.

    The numbering runs in buckets of positions; rows without a position come first.  Under a cap
    each task sends its first ``cap`` rows of a pair, and the reviews are read and parsed once: the
    buckets' sizes would ask for a second pass over them.
    """
    if cap is not None:
        return top_per_key(reviews, PAIR, ["pos"], cap, "n").withColumn("n", F.col("n").cast("bigint"))
    return numbered(reviews, PAIR, F.col("pos") / SPAN, ["pos"], "n")


def review_counts(numbered_reviews: DataFrame, least: int = 25) -> DataFrame:
    """Reviews per pair and whether they fall short of the asked minimum."""
    return numbered_reviews.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("reviews")).withColumn(
        "short", F.col("reviews") < least)


# ------------------------------------------------------------------ stored artefacts
def artefact_name(kind: str, ext: Column) -> Column:
    return file_name(F.col("isbn13"), ARTEFACT_INFIX[kind], F.col("source"), F.col("n"), ext)


def replace_artefacts(stored: DataFrame, new: DataFrame) -> DataFrame:
    """A fresh result replaces all earlier rows of its (book, source); others stay.

    A pair without new rows keeps its old ones.
    """
    fresh = new.select(*PAIR).distinct()
    return stored.join(fresh, PAIR, "left_anti").unionByName(new)


def fill_from_editions(records: DataFrame, editions: DataFrame) -> DataFrame:
    """Missing publisher, date and language from the edition list, first value wins.

    ``editions(work_id, pos, publisher, date, language)``.
    """
    names = {"publisher": "publisher", "date": "date_of_publication", "language": "language"}
    first = editions.groupBy("work_id").agg(*[
        F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("pos"))).alias(f"_{c}") for c in names])
    filled = records.join(first, "work_id", "left")
    for found, target in names.items():
        filled = filled.withColumn(target, F.coalesce(F.nullif(target, F.lit("")), f"_{found}")).drop(f"_{found}")
    return filled


