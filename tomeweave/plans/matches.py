"""Record linkage: candidate rows are derived from each wanted book, then scored and ranked."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixed import GOODREADS_FLOOR
from ..operators import matching, similar
from ..operators.skew import spread_rows
from .base import Catalog, Tables
from .derive import book_isbn13, sql_check10, sql_isbn13

catalog = Catalog()

_KINDS = """array(
  named_struct('pos', 1L, 'title', concat(p_name, ' ', lower(p_type), ' edition'), 'authors', array(p_brand), 'ebook', true),
  named_struct('pos', 2L, 'title', split(p_name, ' ')[0], 'authors', array(p_brand), 'ebook', false),
  named_struct('pos', 3L, 'title', upper(p_name), 'authors', array('Ann', p_brand), 'ebook', p_size % 2 = 0),
  named_struct('pos', 4L, 'title', concat('Summary of ', p_name), 'authors', array(p_brand), 'ebook', true),
  named_struct('pos', 5L, 'title', p_name, 'authors', array('Nobody Else'), 'ebook', true),
  named_struct('pos', 6L, 'title', 'qqqq zzzz xxxx jjjj', 'authors', array(p_brand), 'ebook', true))"""

# scores of containment follow from the lengths alone
_SCORES_SQL = f"""base AS (SELECT {sql_isbn13("p_partkey")} AS isbn13, p_size, length(p_name) AS w, length(p_name) + 1 + length(p_type) + 8 AS c1, length(string_split(p_name, ' ')[1]) AS c2 FROM part),
scored AS (SELECT isbn13, p_size, 1 AS pos, c1 AS len, greatest(2.0 * w / (w + c1), 0.85) AS score, TRUE AS ebook FROM base
  UNION ALL SELECT isbn13, p_size, 2, c2, greatest(2.0 * c2 / (w + c2), 0.85), FALSE FROM base
  UNION ALL SELECT isbn13, p_size, 3, w, 1.0, p_size % 2 = 0 FROM base)"""


# the longest common block of a[al:ah] and b[bl:bh]: longest, then first in a, then first in b
_BLOCK_SQL = """list_max(flatten([[{'k': len(list_filter(range(1, least(ah - i, bh - j) + 1), lambda k: a[i + 1:i + k] = b[j + 1:j + k])), 'i': -i, 'j': -j}
  FOR j IN range(bl, bh)] FOR i IN range(al, ah)]))"""


def sql_ratios(pairs: str) -> str:
    """CTEs ``ratios(a, b, ratio)``: matching blocks left and right of the longest one, for each pair of texts of ``pairs(a, b)``."""
    return f"""blocks(a, b, al, ah, bl, bh, m) AS (
  SELECT *, {_BLOCK_SQL} FROM (SELECT DISTINCT a, b, 0 AS al, length(a) AS ah, 0 AS bl, length(b) AS bh FROM {pairs})
  UNION ALL SELECT *, {_BLOCK_SQL} FROM (
    SELECT a, b, CASE side WHEN 0 THEN al ELSE m.k - m.i END AS al, CASE side WHEN 0 THEN -m.i ELSE ah END AS ah,
           CASE side WHEN 0 THEN bl ELSE m.k - m.j END AS bl, CASE side WHEN 0 THEN -m.j ELSE bh END AS bh
    FROM blocks, (SELECT unnest([0, 1]) AS side) WHERE m.k > 0) WHERE al < ah AND bl < bh),
ratios AS (SELECT a, b, 2.0 * sum(m.k) / (length(a) + length(b)) AS ratio FROM blocks GROUP BY a, b)"""


def _pairs(t: Tables):
    parts = spread_rows(t.part).withColumn("isbn13", book_isbn13("p_partkey"))
    wanted = parts.selectExpr("isbn13", "p_name AS title", "array(p_brand) AS authors")
    candidates = parts.select("isbn13", "p_size", F.explode(F.expr(_KINDS)).alias("c")).select("isbn13", "p_size", "c.*")
    return matching.pair_up(wanted, candidates)


def _rounded(picked):
    return picked.withColumn("score", F.round("score", 6))


@catalog.query(f"""WITH {_SCORES_SQL} SELECT isbn13, pos, round(score, 6) AS score, row_number() OVER (PARTITION BY isbn13 ORDER BY score DESC, len, pos) AS rank FROM scored""")
def match_rank(t: Tables):
    """Best first: a vetoed summary, another author and a stranger are gone."""
    return _rounded(matching.best(_pairs(t), 3)).select("isbn13", "pos", "score", "rank")


@catalog.query(f"""WITH {_SCORES_SQL} SELECT isbn13, pos, round(score, 6) AS score FROM scored QUALIFY row_number() OVER (PARTITION BY isbn13 ORDER BY score DESC, len, pos) <= 3""")
def pick_goodreads(t: Tables):
    return _rounded(matching.goodreads_pick(_pairs(t))).select("isbn13", "pos", "score")


@catalog.query(f"""WITH {_SCORES_SQL} SELECT isbn13, pos, round(score, 6) AS score FROM scored WHERE score >= 0.86 QUALIFY row_number() OVER (PARTITION BY isbn13 ORDER BY ebook DESC, score DESC, len, pos) = 1""")
def pick_kobo(t: Tables):
    return _rounded(matching.kobo_pick(_pairs(t))).select("isbn13", "pos", "score")


@catalog.query(f"""SELECT {sql_isbn13("p_partkey")} AS isbn13, CASE WHEN p_size % 2 = 0 THEN 6 ELSE 2 END AS pos, p_size % 2 = 0 AS isbn_match FROM part""")
def pick_audible(t: Tables):
    """An id that is the ISBN-10 wins over every title; else a dropped subtitle is exact, first row wins."""
    own = F.expr("lpad(string(bigint(substr(isbn13, 4, 9))), 9, '0')")
    from ..functions.isbn import check10
    asin = F.when((F.col("pos") == 6) & (F.col("p_size") % 2 == 0), F.concat(own, check10("substr(isbn13, 4, 9)"))).otherwise(F.lit("B000000000"))
    return matching.audible_pick(_pairs(t).withColumn("asin", asin)).select("isbn13", "pos", "isbn_match")


@catalog.query(f"""SELECT {sql_isbn13("p_partkey")} AS isbn13, CASE p_size % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS rung, CASE p_size % 4 WHEN 0 THEN 0 WHEN 1 THEN 3 ELSE 3 END AS pos FROM part WHERE p_size % 4 <> 3""")
def pick_amazon(t: Tables):
    """Own code page, else the ISBN search, else a plausible title match; the rest is refused."""
    parts = spread_rows(t.part).withColumn("isbn13", book_isbn13("p_partkey"))
    wanted = parts.selectExpr("isbn13", "p_name AS title", "array(p_name) AS authors")
    rows = """array(named_struct('rung', 1, 'pos', 0L, 'title', p_name, 'page_ok', p_size % 4 = 0, 'verdict', 'fuzzy'),
      named_struct('rung', 2, 'pos', 1L, 'title', concat('Summary of ', p_name), 'page_ok', true, 'verdict', 'isbn'),
      named_struct('rung', 2, 'pos', 2L, 'title', 'other', 'page_ok', true, 'verdict', 'mismatch'),
      named_struct('rung', 2, 'pos', 3L, 'title', 'other', 'page_ok', true, 'verdict', IF(p_size % 4 = 1, 'isbn', 'mismatch')),
      named_struct('rung', 3, 'pos', 1L, 'title', 'qqqq zzzz', 'page_ok', true, 'verdict', 'fuzzy'),
      named_struct('rung', 3, 'pos', 2L, 'title', p_name, 'page_ok', false, 'verdict', 'isbn'),
      named_struct('rung', 3, 'pos', 3L, 'title', concat(p_name, ' x'), 'page_ok', true, 'verdict', IF(p_size % 4 = 2, 'fuzzy', 'mismatch')),
      named_struct('rung', 3, 'pos', 4L, 'title', p_name, 'page_ok', true, 'verdict', 'isbn'))"""
    candidates = parts.select("isbn13", F.explode(F.expr(rows)).alias("c")).select("isbn13", "c.*")
    return matching.amazon_pick(matching.pair_up(wanted, candidates)).select("isbn13", "rung", "pos")


@catalog.query(f"""SELECT {sql_isbn13("p_partkey")} AS isbn13, CASE p_size % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS rung,
  round(CASE p_size % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.6 + 0.4 * 0.8 ELSE 0.6 * 0.8 + 0.4 END, 6) AS score, p_size % 3 <> 2 AS confident FROM part""")
def pick_bookbub(t: Tables):
    """Lowest strong rung, else the best blend of title and author; added words are capped."""
    parts = spread_rows(t.part).withColumn("isbn13", book_isbn13("p_partkey"))
    wanted = parts.selectExpr("isbn13", "p_name AS title", "array(p_brand) AS authors")
    rows = """CASE p_size % 3 WHEN 0 THEN array(named_struct('rung', 0, 'title', concat(p_name, ' x'), 'authors', array(p_brand)), named_struct('rung', 1, 'title', p_name, 'authors', array('Ann', p_brand)),
        named_struct('rung', 2, 'title', p_name, 'authors', array(p_brand)))
      WHEN 1 THEN array(named_struct('rung', 2, 'title', p_name, 'authors', array(concat(p_brand, ' Jr'))), named_struct('rung', 1, 'title', concat(p_name, ' x'), 'authors', array(concat(p_brand, ' Jr'))))
      ELSE array(named_struct('rung', 0, 'title', concat(p_name, ' x'), 'authors', array(p_brand)), named_struct('rung', 1, 'title', 'qqqq', 'authors', array('zzzz'))) END"""
    candidates = parts.select("isbn13", F.explode(F.expr(rows)).alias("c")).select("isbn13", "c.*")
    return _rounded(matching.bookbub_pick(matching.pair_up(wanted, candidates))).select("isbn13", "rung", "score", "confident")


@catalog.query(f"""WITH RECURSIVE p AS (SELECT p_partkey, lower(p_name || ' of ' || p_type) AS a,
  lower(reverse(string_split(p_name, ' ')[1]) || ' ' || string_split(p_name, ' ')[2] || ' or ' || p_type) AS b FROM part),
{sql_ratios("p")} SELECT p_partkey, round(CASE WHEN a = b THEN 1.0 ELSE ratio END, 6) AS score FROM p JOIN ratios USING (a, b)""")
def title_scores(t: Tables):
    """Real text ratios: each name against a neighbouring spelling."""
    pairs = t.part.selectExpr("p_partkey", "concat(p_name, ' of ', p_type) AS wanted", "concat(reverse(split(p_name, ' ')[0]), ' ', split(p_name, ' ')[1], ' or ', p_type) AS candidate")
    return matching.add_title_score(pairs, "wanted", "candidate").select("p_partkey", F.round("score", 6).alias("score"))


# a catalogue of other spellings: as it is, a letter lost, words turned, a letter changed, words added, words dropped
_SPELLINGS = ["{n}", "concat(substring({n}, 1, 3), substring({n}, 5))", "concat({n}, ' tales')", "replace({n}, 'e', 'a')", "concat(reverse({n}), ' x')", "concat(substring({n}, 1, 1), {n})"]


def _spelling(name: str, number: str) -> str:
    return f"CASE {number} " + " ".join(f"WHEN {i} THEN {s.format(n=name)}" for i, s in enumerate(_SPELLINGS)) + " END"


_AUTHOR = "concat('Ann ', translate(p_brand, '#0123456789', 'xabcdefghij'))"

@catalog.query(f"""WITH RECURSIVE wanted AS (SELECT min(p_partkey) AS wanted_id, lower(p_name) AS a, lower(translate(p_brand, '#0123456789', 'xabcdefghij')) AS s FROM part GROUP BY p_name, p_brand),
raw AS (SELECT {_spelling("p_name", "p_size % 6")} AS title, p_brand, p_partkey FROM part),
catalogue AS (SELECT min(p_partkey) AS candidate_id, lower(title) AS b, lower(translate(p_brand, '#0123456789', 'xabcdefghij')) AS t FROM raw GROUP BY title, p_brand),
pairs AS (SELECT * FROM (SELECT DISTINCT a FROM wanted), (SELECT DISTINCT b FROM catalogue)),
{sql_ratios("pairs")},
scored AS (SELECT a, b, CASE WHEN a = b THEN 1.0 WHEN contains(a, b) OR contains(b, a) THEN greatest(ratio, 0.85) ELSE ratio END AS score FROM ratios)
SELECT wanted_id, candidate_id, round(score, 6) AS score FROM scored JOIN wanted USING (a) JOIN catalogue USING (b) WHERE score >= 0.8 AND contains('ann ' || t, s)""")
def similar_titles(t: Tables):
    """Wanted books against a catalogue without a shared identifier; the oracle scores the cross product of different titles."""
    wanted = t.part.groupBy("p_name", "p_brand").agg(F.min("p_partkey").alias("wanted_id"))
    wanted = wanted.selectExpr("wanted_id", "p_name AS title", f"array({_AUTHOR}) AS authors")
    catalogue = t.part.selectExpr(f"{_spelling('p_name', 'p_size % 6')} AS title", "p_brand", "p_partkey").groupBy("title", "p_brand").agg(F.min("p_partkey").alias("candidate_id"))
    catalogue = catalogue.selectExpr("candidate_id", "title", f"array({_AUTHOR}) AS authors")
    return similar.similar(wanted, catalogue, GOODREADS_FLOOR).select("wanted_id", "candidate_id", F.round("score", 6).alias("score"))
