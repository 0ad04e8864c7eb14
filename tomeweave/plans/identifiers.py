"""Identifier list queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import isbn
from ..operators import ingest
from ..operators.skew import SPAN, numbered
from .base import Catalog, Tables
from .derive import RAW_SQL, raw_identifiers, sql_check10, sql_check13

catalog = Catalog()
_ISBN10 = f"CASE WHEN isbn13 LIKE '978%' THEN substr(isbn13,4,9) || {sql_check10('substr(isbn13,4,9)')} END"


@catalog.query(f'WITH {RAW_SQL} SELECT "row", code, isbn13, {_ISBN10} AS isbn10 FROM checked')
def isbn_normalize(t: Tables):
    return ingest.normalize_identifiers(raw_identifiers(t), "raw").select("row", "code", "isbn13", "isbn10")


@catalog.query(f"""WITH {RAW_SQL} SELECT "row", CASE
  WHEN raw = '' THEN 'column 3 is empty'
  WHEN length(code) = 13 THEN '''' || raw || ''' -> ''' || code || ''': check digit should be ''' || {sql_check13("code")} || ''''
  ELSE '''' || raw || ''' -> ''' || code || ''' is ' || length(code) || ' characters; an ISBN is 10 or 13' END AS reason
  FROM checked WHERE isbn13 IS NULL""")
def isbn_invalid_reasons(t: Tables):
    return ingest.ingest(raw_identifiers(t), "column 3").problems


@catalog.query(f"""WITH {RAW_SQL} SELECT substr(isbn13,1,3) AS prefix, count(*) AS n,
  count({_ISBN10}) AS with_isbn10, count({_ISBN10}) AS back_again FROM checked WHERE isbn13 IS NOT NULL GROUP BY 1""")
def isbn_roundtrip(t: Tables):
    valid = ingest.normalize_identifiers(raw_identifiers(t), "raw").where("isbn13 is not null")
    again = valid.withColumn("again", isbn.isbn13_of("isbn10"))
    return again.groupBy(F.substring("isbn13", 1, 3).alias("prefix")).agg(
        F.count(F.lit(1)).alias("n"), F.count("isbn10").alias("with_isbn10"),
        F.count_if(F.col("again") == F.col("isbn13")).alias("back_again"))


@catalog.query(f"""WITH {RAW_SQL} SELECT isbn13, "row", label FROM checked WHERE isbn13 IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY isbn13 ORDER BY "row") = 1""")
def isbn_dedupe_first(t: Tables):
    return ingest.ingest(raw_identifiers(t)).entries


@catalog.query(f"""WITH {RAW_SQL} SELECT count(DISTINCT isbn13) AS entries, count(isbn13) - count(DISTINCT isbn13) AS duplicates,
  count(*) FILTER (WHERE isbn13 IS NULL) AS skipped FROM checked""")
def ingest_summary(t: Tables):
    return ingest.ingest(raw_identifiers(t)).summary


@catalog.query(f"""WITH {RAW_SQL} SELECT CAST(2 AS INTEGER) AS chosen, count(DISTINCT isbn13) AS entries,
  count(isbn13) - count(DISTINCT isbn13) AS duplicates, count(*) FILTER (WHERE isbn13 IS NULL) AS skipped FROM checked""")
def pick_id_column(t: Tables):
    """The header names the wrong column, so the data decides; then the whole list is read by it."""
    raw = raw_identifiers(t)
    rows = raw.select("row", F.array(F.col("row").cast("string"), "label", "raw").alias("cells"))
    chosen, _ = ingest.choose_columns(rows, ["isbn", "title", "code"])
    picked = rows.select("row", F.get("cells", chosen).alias("raw"), F.get("cells", 1).alias("label"))
    return ingest.ingest(picked).summary.select(F.lit(chosen).alias("chosen"), "entries", "duplicates", "skipped")


@catalog.query("""SELECT position // 1000 AS shard, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key
  FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS position FROM orders) GROUP BY 1""")
def row_slice(t: Tables):
    """Every entry's dense position, as shards of a thousand that tile the list."""
    placed = numbered(t.orders.select("o_orderkey"), [], F.col("o_orderkey") / SPAN, ["o_orderkey"], "position", start=0)
    return placed.groupBy(F.floor(F.col("position") / 1000).alias("shard")).agg(
        F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))


@catalog.query("""SELECT o_orderkey AS "row" FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders)
  WHERE p >= 250 AND p < 12250""")
def row_range(t: Tables):
    entries = t.orders.select(F.col("o_orderkey").alias("row"))
    return ingest.row_slice(entries, 250, 12250).select("row")


@catalog.query("SELECT p_partkey, regexp_replace(lower(p_name || '-' || p_type), '[^a-z0-9]+', '', 'g') AS header_key FROM part")
def header_keys(t: Tables):
    return t.part.select("p_partkey", isbn.header_key(F.concat_ws("-", "p_name", "p_type")).alias("header_key"))


@catalog.query("""SELECT page_id, substr(regexp_replace(regexp_replace(regexp_replace(url, '[^A-Za-z0-9._ -]+', '-', 'g'),
  '-{2,}', '-', 'g'), '^[ .-]+|[ .-]+$', '', 'g'), 1, 120) AS segment FROM pages""")
def safe_segments(t: Tables):
    return t.pages.select("page_id", isbn.safe_segment(F.col("url")).alias("segment"))


@catalog.query(f"""WITH {RAW_SQL}, pairs AS (SELECT "row", isbn13, CASE WHEN "row" % 3 = 0 THEN {_ISBN10}
    WHEN "row" % 3 = 1 THEN 'B00' || lpad(CAST("row" AS VARCHAR), 7, '0') ELSE '' END AS asin FROM checked WHERE isbn13 LIKE '978%')
  SELECT "row", asin, "row" % 3 = 0 AS isbn_match FROM pairs""")
def asin_match(t: Tables):
    """A product id in an address that is itself the ISBN-10 of the wanted book."""
    valid = ingest.normalize_identifiers(raw_identifiers(t), "raw").where("isbn13 like '978%'")
    made = F.concat(F.lit("B00"), F.lpad(F.col("row").cast("string"), 7, "0"))
    kind = F.pmod("row", F.lit(3))
    url = F.when(kind == 0, F.concat(F.lit("https://x.example/dp/"), "isbn10")).when(
        kind == 1, F.concat(F.lit("https://x.example/gp/product/"), made, F.lit("?x=1"))).otherwise(F.lit("https://x.example/s"))
    found = valid.withColumn("asin", isbn.asin_of_url(url)).withColumn("as13", isbn.isbn13_of("asin"))
    return found.select("row", "asin", F.coalesce(F.col("as13") == F.col("isbn13"), F.lit(False)).alias("isbn_match"))
