"""Covers and reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import artefacts
from ..stores import review_pages
from .base import Catalog, Tables
from .derive import source_of, sql_source
from .texts import sql_fold

catalog = Catalog()


@catalog.query(f"""WITH o AS (SELECT CAST(page_id // 2 AS VARCHAR) AS isbn13, {sql_source("(page_id // 2)")} AS source, page_id * 100 + i AS pos, i, 'a' || (i * 5 % 9) AS kk,
    CASE WHEN i = 5 THEN regexp_extract(url, '^[a-z]+://[^/?#]*') ELSE 'https://c.example' END || '/images/I/a' || (i * 5 % 9) || '._SL' || (i * 10) || '_.jpg' AS url
    FROM (SELECT page_id, url, unnest(generate_series(0, 13)) AS i FROM pages)),
  k AS (SELECT *, CASE WHEN source IN ('amazon', 'audible', 'bookbub') THEN kk ELSE lower(url) END AS key,
    CASE source WHEN 'amazon' THEN regexp_replace(url, '\\._SL[0-9]+_', '') WHEN 'audible' THEN regexp_replace(url, '_SL[0-9]+_', '_SL500_') ELSE url END AS full_url FROM o WHERE i <> 4),
  d AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY isbn13, source, key ORDER BY pos) = 1),
  n AS (SELECT isbn13, source, full_url AS url, row_number() OVER (PARTITION BY isbn13, source ORDER BY pos) AS n FROM d)
  SELECT isbn13, source, url, n FROM n WHERE n <= CASE WHEN source = 'amazon' THEN 12 ELSE 6 END""")
def image_dedupe_cap(t: Tables):
    """Fourteen image links per page: repeats of one artwork, a placeholder, a relative link."""
    links = t.pages.select("page_id", "url", F.explode(F.sequence(F.lit(0), F.lit(13))).alias("i"))
    name = F.expr("concat('/images/I/a', i * 5 % 9, '._SL', i * 10, '_.jpg')")
    offered = links.select(
        F.expr("string(page_id div 2)").alias("isbn13"), source_of(F.expr("page_id div 2")).alias("source"), (F.col("page_id") * 100 + F.col("i")).alias("pos"),
        F.col("url").alias("base"), F.when(F.col("i") == 4, F.lit("https://c.example/no-cover.jpg")).when(F.col("i") == 5, name)
        .otherwise(F.concat(F.lit("https://c.example"), name)).alias("url"))
    return artefacts.collect_covers(offered).select("isbn13", "source", "url", "n")


@catalog.query("""SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'L' WHEN 1 THEN 'M' WHEN 2 THEN 'M' WHEN 3 THEN 'S' END || page_id AS url, page_id % 5 IN (1, 2, 3) AS used_fallback, page_id % 5 = 4 AS incomplete FROM pages""")
def cover_alternatives(t: Tables):
    """Three sizes per cover: failed fetches, a placeholder pixel, or nothing usable."""
    size = lambda s: F.concat(F.lit(s), F.col("page_id").cast("string"))
    covers = t.pages.select(F.col("page_id").cast("string").alias("isbn13"), F.lit("shop").alias("source"), F.lit(1).alias("cover_no"), F.array(size("L"), size("M"), size("S")).alias("alternatives"))
    fetched = t.pages.select("page_id", F.explode(F.array(F.lit("L"), F.lit("M"), F.lit("S"))).alias("s"))
    good = F.expr("CASE page_id % 5 WHEN 0 THEN true WHEN 1 THEN s <> 'L' WHEN 2 THEN s <> 'L' WHEN 3 THEN s = 'S' ELSE false END")
    fetches = fetched.select(F.concat("s", F.col("page_id").cast("string")).alias("url"), (good | (F.pmod("page_id", F.lit(5)) == 2)).alias("ok"),
                             F.when(good, F.lit(4000)).otherwise(F.lit(43)).alias("bytes"))
    return artefacts.first_usable(covers, fetches).select(F.col("isbn13").cast("bigint").alias("page_id"), "url", "used_fallback", "incomplete")


@catalog.query("""SELECT page_id, (['png','jpg','gif','webp','avif','svg','webp','tiff','png','jpg'])[CAST(page_id % 10 AS INTEGER) + 1] AS ext FROM pages""")
def image_types(t: Tables):
    """Type from magic bytes, then content type, then the URL, over generated file heads."""
    heads = ["89504E470D0A1A0A", "FFD8FFE000", "474946383961", "52494646000000005745425056", "00000020667479706176696600000000", "20203C737667", "00", "49492A00", "00", "00"]
    kinds = ["image/jpeg", "image/png", "", "", "", "", "image/webp; q=1", "", "", ""]
    ends = ["x.jpg", "", "", "", "", "", "x.png", "", "x.PNG?v=2", ""]
    pick = lambda v: F.element_at(F.array(*[F.lit(x) for x in v]), (F.pmod("page_id", F.lit(10)) + 1).cast("int"))
    content = F.concat(F.unhex(pick(heads)), F.encode("html", "UTF-8"))
    return t.pages.select("page_id", artefacts.image_ext(content, pick(kinds), pick(ends)).alias("ext"))


@catalog.query("SELECT page_id, page_id % 4 <> 1 AS kept, page_id % 3 = 0 AS placeholder FROM pages")
def cover_sentinels(t: Tables):
    url = F.expr("concat('https://c.example/b/id/', CASE page_id % 4 WHEN 1 THEN -1 ELSE page_id + 1 END, '-L.jpg')")
    other = F.expr("concat('https://c.example/', CASE page_id % 3 WHEN 0 THEN 'NoPhoto' ELSE 'photo' END, '.png')")
    return t.pages.select("page_id", artefacts.catalogue_has_cover(url).alias("kept"), artefacts.is_placeholder(other).alias("placeholder"))


# ------------------------------------------------------------------ reviews
def _turns(t: Tables):
    return t.conversations.selectExpr("string(conv_id div 4) AS isbn13", "'amazon' AS source", "conv_id * 1000 + turn AS pos", "conv_id", "turn", "text", "role AS reviewer",
                                      "IF(turn % 2 = 0, concat(turn, '/5'), NULL) AS rating", "IF(turn % 3 = 0, '2020-01-02', '') AS date", "string(NULL) AS url")


@catalog.query("""SELECT conv_id, turn, md5('Reviewer: ' || role || chr(10) || CASE WHEN turn % 2 = 0 THEN 'Rating: ' || turn || '/5' || chr(10) ELSE '' END ||
  CASE WHEN turn % 3 = 0 THEN 'Date: 2020-01-02' || chr(10) ELSE '' END || chr(10) || text) AS digest FROM conversations""")
def review_render(t: Tables):
    return _turns(t).select("conv_id", "turn", F.md5(artefacts.render_review()).alias("digest"))


@catalog.query("""SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id // 4 ORDER BY conv_id * 1000 + turn) AS n FROM conversations""")
def review_number(t: Tables):
    return artefacts.number_reviews(_turns(t)).select("conv_id", "turn", "n")


@catalog.query("""WITH n AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id // 4 ORDER BY conv_id * 1000 + turn) AS n FROM conversations)
  SELECT conv_id // 4 AS book, least(count(*), 5) AS reviews, least(count(*), 5) < 4 AS short FROM n GROUP BY 1""")
def review_number_cap(t: Tables):
    counted = artefacts.review_counts(artefacts.number_reviews(_turns(t), 5), 4)
    return counted.select(F.col("isbn13").cast("bigint").alias("book"), "reviews", "short")


_REVIEW_SOURCES = ["amazon", "kobo", "audible"]


def _document_reviews(t: Tables):
    shop = F.element_at(F.array(*[F.lit(s) for s in _REVIEW_SOURCES]), (F.pmod("doc_id", F.lit(3)) + 1).cast("int"))
    return t.documents.select(
        F.expr("string(doc_id % 20)").alias("isbn13"), shop.alias("source"), F.col("doc_id").alias("pos"), "doc_id",
        F.expr("concat('Review ', upper(lang), ', ', doc_id div 3 % 7, ' of ', left(text, 0))").alias("text"),
        F.expr("IF(doc_id % 4 = 0, concat('R', doc_id % 12), '')").alias("review_id"), F.expr("IF(doc_id % 2 = 0, source, upper(source))").alias("reviewer"),
        F.expr("concat('2020-01-0', doc_id % 2 + 1)").alias("date"))


@catalog.query("""WITH r AS (SELECT doc_id, doc_id % 20 AS b, (['amazon','kobo','audible'])[CAST(doc_id % 3 AS INTEGER) + 1] AS s, 'review ' || lang || ', ' || (doc_id // 3 % 7) || ' of ' AS t, source, lang FROM documents)
  SELECT doc_id FROM r QUALIFY row_number() OVER (PARTITION BY b, s, CASE s WHEN 'amazon' THEN CASE WHEN doc_id % 4 = 0 THEN 'R' || (doc_id % 12) ELSE 'body:' || t END
    WHEN 'kobo' THEN source || '|' || (doc_id % 2) || '|' || t ELSE t END ORDER BY doc_id) = 1""")
def review_dedupe(t: Tables):
    return artefacts.dedupe_reviews(_document_reviews(t)).select("doc_id")


@catalog.query(r"""
WITH RECURSIVE r AS (SELECT doc_id, doc_id % 5 AS b, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE CAST(doc_id * 7 % 61 AS VARCHAR) END AS i,
    lower(trim(regexp_replace(substr('Opening words ' || (doc_id * 13 % 83) || ' of ' || lang || ' ' || repeat('- ', 100) || text, 1, 200), '[^\p{L}\p{N}_]+', ' ', 'g'))) AS w
  FROM documents WHERE length(text) >= 0),
n AS (SELECT *, coalesce('i:' || i, 'w:' || w) AS k, row_number() OVER (PARTITION BY b ORDER BY doc_id) AS n FROM r),
s(b, n, ids, words, doc_id, kept) AS (
  SELECT DISTINCT b, 0::BIGINT, []::VARCHAR[], []::VARCHAR[], NULL::BIGINT, false FROM n
  UNION ALL
  SELECT s.b, n.n, CASE WHEN list_contains(ids, k) OR list_contains(words, w) THEN ids ELSE list_append(ids, k) END,
         CASE WHEN list_contains(ids, k) OR list_contains(words, w) THEN words ELSE list_append(words, w) END,
         n.doc_id, NOT (list_contains(ids, k) OR list_contains(words, w))
  FROM s JOIN n ON n.b = s.b AND n.n = s.n + 1)
SELECT s.doc_id, CASE WHEN s.doc_id % 9 = 0 THEN '' ELSE CAST(s.doc_id * 7 % 61 AS VARCHAR) END AS review_id, length(text) AS chars
FROM s JOIN documents USING (doc_id) WHERE kept""")
def review_dedupe_either_key(t: Tables):
    """Order decides: only a kept review claims its id and its opening words; the whole texts come along."""
    opening = F.expr("concat('Opening words ', doc_id * 13 % 83, ' of ', lang, ' ', repeat('- ', 100), text)")
    reviews = t.documents.select(F.expr("string(doc_id % 5)").alias("isbn13"), F.lit("goodreads").alias("source"), F.col("doc_id").alias("pos"), "doc_id",
                                 F.expr("IF(doc_id % 9 = 0, '', string(doc_id * 7 % 61))").alias("review_id"), opening.alias("text"), F.length("text").cast("bigint").alias("chars"))
    return artefacts.dedupe_reviews_either_key(artefacts.usable_reviews(reviews)).select("doc_id", "review_id", "chars")


@catalog.query(f"""SELECT source, count(*) AS kept, CAST(sum(n) AS BIGINT) AS chars FROM (
  SELECT {sql_source("doc_id")} AS source, length(trim(CASE WHEN doc_id % 3 = 0 THEN substr(text, 1, CAST(doc_id % 31 AS INTEGER)) ELSE text END)) AS n FROM documents)
  WHERE n >= CASE source WHEN 'goodreads' THEN 20 WHEN 'openlibrary' THEN 1 WHEN 'bookbub' THEN 1 ELSE 2 END GROUP BY 1""")
def review_min_chars(t: Tables):
    """Whole texts; every third is cut short, so that each shop's least length decides some rows."""
    body = F.expr("IF(doc_id % 3 = 0, substr(text, 1, int(doc_id % 31)), text)")
    reviews = t.documents.select(source_of(F.col("doc_id")).alias("source"), F.trim(body).alias("text"))
    return artefacts.usable_reviews(reviews).groupBy("source").agg(F.count(F.lit(1)).alias("kept"), F.sum(F.length("text")).cast("bigint").alias("chars"))


# ------------------------------------------------------------------ captured review pages
_PAGED = r"""WITH p AS (SELECT doc_id % 40 AS b, doc_id // 40 AS page_no, doc_id, source AS author,
    trim(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g')) AS t FROM documents),
k AS (SELECT *, {key} AS k FROM p WHERE length(t) >= 2),
f AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY b, k ORDER BY page_no) = 1)
SELECT b AS book, row_number() OVER (PARTITION BY b ORDER BY page_no) AS n, md5('Reviewer: ' || author || chr(10) || chr(10) || t) AS digest FROM f
QUALIFY row_number() OVER (PARTITION BY b ORDER BY page_no) <= 20"""


def _paged(t: Tables, source: str, body: str) -> DataFrame:
    """Every document as the one review of a captured reply; its whole text passes the reader."""
    safe = "replace(replace(text, '&', '&amp;'), '<', '&lt;')"
    pages = t.documents.select(F.expr("string(doc_id % 40)").alias("isbn13"), F.lit(source).alias("source"), F.expr("doc_id div 40").alias("page_no"),
                               F.expr(body.format(safe=safe)).alias("body"))
    first = spark_empty(t)
    done = review_pages.review_path(review_pages.with_pages(first, pages), 20)
    return done.select(F.col("isbn13").cast("bigint").alias("book"), "n", F.md5("body").alias("digest"))


def spark_empty(t: Tables) -> DataFrame:
    """No first page: all reviews come from the captured replies."""
    return t.spark.createDataFrame([], "isbn13 string, source string, pos bigint, review_id string, text string, reviewer string, rating string, date string, url string")


@catalog.query(_PAGED.format(key="lower(author) || '|' || substr(lower(regexp_replace(t, '\\s+', ' ', 'g')), 1, 180)"))
def review_pages_kobo(t: Tables):
    return _paged(t, "kobo", "concat('<div class=\"review-item\"><span class=\"review-author\">', source, '</span><p class=\"review-text\">', {safe}, '</p></div>')")


@catalog.query(_PAGED.format(key=f"substr({sql_fold('t')}, 1, 400)"))
def review_pages_audible(t: Tables):
    return _paged(t, "audible", "concat('<adbl-review-tile reviewer=\"', source, '\"><adbl-text-block slot=\"review-summary\">', {safe}, '</adbl-text-block></adbl-review-tile>')")


@catalog.query(_PAGED.format(key=r"lower(trim(regexp_replace(substr(t, 1, 200), '[^\p{L}\p{N}_]+', ' ', 'g')))").replace("length(t) >= 2", "length(t) >= 20 AND doc_id % 9 <> 0"))
def review_pages_goodreads(t: Tables):
    """Ids differ, so the opening words decide; every ninth reply reports an error and holds nothing."""
    body = ("IF(doc_id % 9 = 0, '{{\"errors\": [1]}}', to_json(named_struct('data', named_struct('getReviews', named_struct('edges', array(named_struct('node', "
            "named_struct('id', concat('r', doc_id), 'text', {safe}, 'creator', named_struct('name', source)))))))))")
    return _paged(t, "goodreads", body)
