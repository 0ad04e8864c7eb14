"""Inputs derived from the given tables by fixed rules, in Spark and (as text) in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import SOURCE_ORDER
from ..functions.core import literal_array
from ..functions.isbn import check10, check13
from ..operators.skew import first_per_key
from .base import Tables


# ------------------------------------------------------------------ identifiers
def book_isbn13(key: str) -> Column:
    """A valid ISBN-13 for a whole-number key column."""
    stem = f"concat('978', lpad(string({key}), 9, '0'))"
    return F.concat(F.expr(stem), check13(stem))


def raw_identifiers(t: Tables) -> DataFrame:
    """``(row, raw, label)``: eight spellings by key, valid, invalid and repeated."""
    base = t.part.selectExpr("p_partkey AS row", "p_name AS label", "lpad(string(p_partkey), 9, '0') AS b",
                             "lpad(string(greatest(p_partkey - 6, 0)), 9, '0') AS e")
    checked = base.withColumns({"c10": check10("b"), "c13": check13("concat('978', b)"), "c979": check13("concat('979', b)"),
                                "e10": check10("e")})
    return checked.selectExpr("row", """CASE row % 8
        WHEN 0 THEN concat('978', b, c13)
        WHEN 1 THEN concat(b, c10)
        WHEN 2 THEN concat('ISBN-10: ', left(b, 1), '-', substr(b, 2, 3), '-', right(b, 5), '-', lower(c10))
        WHEN 3 THEN concat_ws('-', '978', left(b, 1), substr(b, 2, 3), right(b, 5), c13)
        WHEN 4 THEN concat('978', b, string((int(c13) + 1) % 10))
        WHEN 5 THEN if(row % 16 = 5, '', 'nonsense')
        WHEN 6 THEN concat(e, e10)
        ELSE concat('979', b, c979) END AS raw""", "label")


def sql_check10(x: str) -> str:
    total = " + ".join(f"CAST(substr({x},{i + 1},1) AS INTEGER)*{10 - i}" for i in range(9))
    return f"CASE (11 - ({total}) % 11) % 11 WHEN 10 THEN 'X' ELSE CAST((11 - ({total}) % 11) % 11 AS VARCHAR) END"


def sql_check13(x: str) -> str:
    total = " + ".join(f"CAST(substr({x},{i + 1},1) AS INTEGER)*{1 if i % 2 == 0 else 3}" for i in range(12))
    return f"CAST((10 - ({total}) % 10) % 10 AS VARCHAR)"


def sql_isbn13(key: str) -> str:
    stem = f"('978' || lpad(CAST({key} AS VARCHAR), 9, '0'))"
    return f"({stem} || {sql_check13(stem)})"


_B, _E = "lpad(CAST(k AS VARCHAR), 9, '0')", "lpad(CAST(k - 6 AS VARCHAR), 9, '0')"
RAW_SQL = f"""
raw_ids AS (SELECT k AS "row", label, CASE k % 8
  WHEN 0 THEN '978' || b || {sql_check13("('978' || b)")}
  WHEN 1 THEN b || {sql_check10("b")}
  WHEN 2 THEN 'ISBN-10: ' || substr(b,1,1) || '-' || substr(b,2,3) || '-' || substr(b,5,5) || '-' || lower({sql_check10("b")})
  WHEN 3 THEN '978-' || substr(b,1,1) || '-' || substr(b,2,3) || '-' || substr(b,5,5) || '-' || {sql_check13("('978' || b)")}
  WHEN 4 THEN '978' || b || CAST((CAST({sql_check13("('978' || b)")} AS INTEGER) + 1) % 10 AS VARCHAR)
  WHEN 5 THEN CASE WHEN k % 16 = 5 THEN '' ELSE 'nonsense' END
  WHEN 6 THEN e || {sql_check10("e")}
  ELSE '979' || b || {sql_check13("('979' || b)")} END AS raw
 FROM (SELECT p_partkey AS k, p_name AS label, lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS b,
       lpad(CAST(greatest(p_partkey - 6, 0) AS VARCHAR), 9, '0') AS e FROM part)),
coded AS (SELECT *, upper(regexp_replace(regexp_replace(raw, '^\\s*e?isbn(?:[\\s\\-_]*1[03])?\\s*[:=]?\\s*', '', 'i'),
                     '[\\s\\-_]+', '', 'g')) AS code FROM raw_ids),
checked AS (SELECT *, CASE
   WHEN regexp_full_match(code, '97[89][0-9]{{10}}') THEN
     CASE WHEN {sql_check13("code")} = substr(code,13,1) THEN code END
   WHEN regexp_full_match(code, '[0-9]{{9}}[0-9X]') THEN
     CASE WHEN {sql_check10("code")} = substr(code,10,1) THEN '978' || substr(code,1,9) || {sql_check13("('978' || substr(code,1,9))")} END
   END AS isbn13 FROM coded)
"""

# ------------------------------------------------------------------ outcomes
SOURCES_SQL = "['" + "','".join(SOURCE_ORDER) + "']"


def source_of(number: Column) -> Column:
    """One of the six source names by number modulo six."""
    return F.element_at(literal_array(SOURCE_ORDER), (F.pmod(number, F.lit(6)) + 1).cast("int"))


def sql_source(number: str) -> str:
    return f"({SOURCES_SQL})[CAST({number} % 6 AS INTEGER) + 1]"


def outcomes(t: Tables, keep: list[str] = ()) -> DataFrame:
    """One pass per (book, source) from the order lines, with every field the reports read."""
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
                              "l_returnflag", "l_linestatus", "l_shipdate").withColumn("_s", F.pmod("l_suppkey", F.lit(6)))
    order = ["l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice"]
    first = first_per_key(lines, ["l_partkey", "_s"], order)
    quantity = F.col("l_quantity").cast("bigint")
    has = F.col("l_returnflag") == "A"
    warnings = F.filter(F.array(F.when(F.pmod(quantity, F.lit(5)) == 0, F.lit("no cover image URLs found")),
                                F.when(F.pmod(quantity, F.lit(7)) == 0, F.lit("no genres found"))), lambda w: w.isNotNull())
    first = first.withColumn("q", quantity)
    return first.select(
        *keep, F.concat(F.lit("978"), F.lpad(F.col("l_partkey").cast("string"), 10, "0")).alias("isbn13"),
        source_of(F.col("_s")).alias("source"), F.col("l_orderkey").alias("seq"), F.col("l_orderkey").alias("pos"),
        has.alias("has_metadata"), (has | (F.pmod(quantity, F.lit(11)) == 0)).alias("has_payload"),
        F.when(F.col("l_returnflag") == "R", F.lit("HTTP 403 wall")).alias("block_reason"),
        F.when(F.col("l_linestatus") == "F", F.lit(1)).otherwise(F.lit(0)).alias("responded_hosts"),
        F.when(has & (F.pmod(quantity, F.lit(3)) == 0), F.array().cast("array<string>")).otherwise(F.array(F.lit("origin"))).alias("missing"),
        warnings.alias("warnings"), F.when(has, quantity).otherwise(F.lit(0)).alias("reviews"),
        F.when(has, F.pmod(quantity, F.lit(4))).otherwise(F.lit(0)).alias("covers"),
        (has & (F.pmod(quantity, F.lit(9)) == 0)).alias("incomplete"),
        F.when(F.pmod(quantity, F.lit(13)) == 0, F.lit("already holds it")).alias("skip_reason"),
        F.round(F.col("l_extendedprice") / 1000, 3).alias("seconds"))


OUTCOMES_SQL = f"""
firsts AS (SELECT *, l_suppkey % 6 AS s FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey % 6
    ORDER BY l_orderkey, l_linenumber, l_suppkey, l_shipdate, l_quantity, l_extendedprice) = 1),
raw_outcomes AS (SELECT '978' || lpad(CAST(l_partkey AS VARCHAR), 10, '0') AS isbn13, {sql_source("s")} AS source,
  l_orderkey AS pos, CAST(l_quantity AS BIGINT) AS q, l_returnflag = 'A' AS has_metadata,
  (l_returnflag = 'A' OR CAST(l_quantity AS BIGINT) % 11 = 0) AS has_payload,
  CASE WHEN l_returnflag = 'R' THEN 'HTTP 403 wall' END AS block_reason,
  CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS responded_hosts,
  round(l_extendedprice / 1000, 3) AS seconds FROM firsts),
outcomes AS (SELECT *,
  CASE WHEN q % 13 = 0 THEN 'skipped'
       WHEN NOT has_payload AND block_reason IS NOT NULL THEN 'blocked'
       WHEN NOT has_payload THEN 'empty'
       WHEN NOT (has_metadata AND q % 3 = 0) OR q % 5 = 0 OR q % 7 = 0 THEN 'partial' ELSE 'ok' END AS status,
  CASE WHEN q % 13 = 0 OR has_payload THEN TRUE ELSE block_reason IS NULL AND responded_hosts > 0 END AS trustworthy,
  CASE WHEN has_metadata THEN q ELSE 0 END AS reviews, CASE WHEN has_metadata THEN q % 4 ELSE 0 END AS covers,
  (has_metadata AND q % 9 = 0) AS incomplete,
  CASE WHEN q % 5 = 0 THEN 'no cover image URLs found' WHEN q % 7 = 0 THEN 'no genres found' END AS first_warning
  FROM raw_outcomes)
"""


# ------------------------------------------------------------------ fetch log
def fetch_log(t: Tables) -> DataFrame:
    """Host responses in time order from the event stream."""
    e = t.events
    return e.select(
        F.concat(F.lit("978"), F.lpad(F.pmod("event_id", F.lit(997)).cast("string"), 10, "0")).alias("isbn13"),
        source_of(F.col("event_id")).alias("source"), F.concat(F.lit("h"), F.col("user_id").cast("string")).alias("host"),
        "ts", F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("ok"),
        (F.pmod("event_id", F.lit(4)) != 0).alias("responded"),
        F.when((F.col("event_type") == "error") & (F.pmod("event_id", F.lit(3)) == 0),
               F.concat(F.lit("HTTP 403 wall "), F.pmod("event_id", F.lit(10)).cast("string"))).alias("block_reason"))


FETCH_SQL = f"""
log AS (SELECT '978' || lpad(CAST(event_id % 997 AS VARCHAR), 10, '0') AS isbn13, {sql_source("event_id")} AS source,
  'h' || CAST(user_id AS VARCHAR) AS host, ts, event_id AS seq, event_type <> 'error' AS ok, event_id % 4 <> 0 AS responded,
  CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'HTTP 403 wall ' || CAST(event_id % 10 AS VARCHAR) END AS block_reason
  FROM events)
"""
