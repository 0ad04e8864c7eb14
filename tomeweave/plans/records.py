"""Work lists, hints, ledgers, keyed metadata and place of publication."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledger, origin, outcomes, upsert, worklist
from ..operators.artefacts import artefact_name, replace_artefacts
from .base import Catalog, Tables
from .derive import OUTCOMES_SQL, SOURCES_SQL, outcomes as derived_outcomes, source_of, sql_source

catalog = Catalog()


# ------------------------------------------------------------------ work list
def _book(key: str):
    return F.concat(F.lit("978"), F.lpad(F.col(key).cast("string"), 10, "0"))


def _states(t: Tables):
    lines = t.lineitem.select(_book("l_partkey").alias("isbn13"), source_of(F.col("l_suppkey")).alias("source"),
                              "l_returnflag", "l_linestatus", F.col("l_quantity").cast("bigint").alias("q"))
    bits = worklist.answered_bits(lines.where("l_returnflag = 'A'"), lines.where("l_returnflag = 'R' and l_linestatus = 'F'"),
                                  lines.where("q % 10 = 0"))
    return worklist.pair_states(t.part.select(_book("p_partkey").alias("isbn13")), bits)


_STATES_SQL = f"""pairs AS (SELECT '978' || lpad(CAST(p_partkey AS VARCHAR),10,'0') AS isbn13, unnest({SOURCES_SQL}) AS source FROM part),
facts AS (SELECT '978' || lpad(CAST(l_partkey AS VARCHAR),10,'0') AS isbn13, {sql_source("l_suppkey")} AS source,
  bool_or(l_returnflag = 'A') AS scraped, bool_or(l_returnflag = 'R' AND l_linestatus = 'F') AS no_data,
  bool_or(CAST(l_quantity AS BIGINT) % 10 = 0) AS incomplete FROM lineitem GROUP BY 1, 2),
states AS (SELECT p.isbn13, p.source, CASE WHEN coalesce(incomplete, FALSE) THEN NULL
  WHEN scraped THEN p.source || '_metadata already holds it' WHEN no_data THEN p.source || '_no_data records no such book' END AS skip_reason
  FROM pairs p LEFT JOIN facts f ON p.isbn13 = f.isbn13 AND p.source = f.source)"""


@catalog.query(f"WITH {_STATES_SQL} SELECT isbn13, source, list_position({SOURCES_SQL}, source) AS source_rank FROM states WHERE skip_reason IS NULL")
def work_list(t: Tables):
    return worklist.worklist(_states(t)).select("isbn13", "source", "source_rank")


@catalog.query(f"WITH {_STATES_SQL} SELECT isbn13, source, skip_reason FROM states WHERE skip_reason IS NOT NULL")
def skip_reasons(t: Tables):
    return worklist.skipped(_states(t)).select("isbn13", "source", "skip_reason")


@catalog.query(f"""SELECT s_suppkey, name, NULLIF(list_position({SOURCES_SQL}, name), 0) AS source_rank, list_contains({SOURCES_SQL}, name) AS known
  FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 6 THEN lower(s_name) ELSE {sql_source("s_suppkey")} END AS name FROM supplier)""")
def source_selection(t: Tables):
    name = F.when(F.pmod("s_suppkey", F.lit(7)) == 6, F.lower("s_name")).otherwise(source_of(F.col("s_suppkey")))
    return worklist.rank_sources(t.supplier.select("s_suppkey", name.alias("name")), "name")


# ------------------------------------------------------------------ hints
@catalog.query("""SELECT h.o_orderkey, coalesce(CASE WHEN h.o_orderkey % 2 = 0 THEN 'Own ' || h.o_orderkey END, s.title) AS title,
  CASE WHEN h.o_orderkey % 3 = 0 THEN 'Own Author' ELSE coalesce(s.author, '') END AS authors
  FROM orders h LEFT JOIN (SELECT o_orderkey AS k, 'Stored ' || o_orderpriority AS title, o_orderstatus || ' Author' AS author FROM orders
    WHERE o_orderkey % 5 < 4) s ON h.o_orderkey = s.k""")
def hint_recover(t: Tables):
    key, text = F.col("o_orderkey"), F.array().cast("array<string>")
    hints = t.orders.select(key.alias("isbn13"), F.when(key % 2 == 0, F.concat(F.lit("Own "), key.cast("string"))).alias("title"),
                            F.when(key % 3 == 0, F.array(F.lit("Own Author"))).otherwise(text).alias("authors"))
    stored = t.orders.where(key % 5 < 4).select(
        key.alias("isbn13"), F.concat(F.lit("Stored "), "o_orderpriority").alias("title"),
        F.array(F.concat("o_orderstatus", F.lit(" Author")), F.lit("")).alias("authors"))
    return worklist.recover_hints(hints, stored).select(
        F.col("isbn13").alias("o_orderkey"), "title", F.array_join("authors", ", ").alias("authors"))


@catalog.query(f"""WITH {OUTCOMES_SQL}, found AS (SELECT isbn13, list_position({SOURCES_SQL}, source) AS r,
    CASE WHEN q % 2 = 0 THEN 'Title ' || pos END AS title, CASE WHEN q % 3 = 0 THEN 'Author ' || pos END AS author,
    CASE WHEN q % 5 = 0 THEN CAST(pos AS VARCHAR) END AS isbn10 FROM outcomes WHERE block_reason IS NULL)
  SELECT isbn13, arg_min(title, r) FILTER (WHERE title IS NOT NULL) AS title, coalesce(arg_min(author, r) FILTER (WHERE author IS NOT NULL), '') AS authors,
    arg_min(isbn10, r) FILTER (WHERE isbn10 IS NOT NULL) AS isbn10 FROM found GROUP BY 1""")
def hint_fold(t: Tables):
    raw = _with_quantity(t)
    tagged = lambda label: F.concat(F.lit(label), F.col("pos").cast("string"))
    found = raw.select(
        "isbn13", "source", F.col("block_reason").isNull().alias("confirmed"), F.when(F.col("q") % 2 == 0, tagged("Title ")).alias("title"),
        F.when(F.col("q") % 3 == 0, F.array(tagged("Author "))).otherwise(F.array().cast("array<string>")).alias("authors"),
        F.when(F.col("q") % 5 == 0, F.col("pos").cast("string")).alias("isbn10"))
    return worklist.fold_hints(found).select("isbn13", "title", F.coalesce(F.array_join("authors", ", "), F.lit("")).alias("authors"), "isbn10")


def _with_quantity(t: Tables):
    """Derived outcomes with the line quantity they came from."""
    return derived_outcomes(t, keep=["q"])


@catalog.query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name || ': ' || p_type WHEN 2 THEN p_name || ': ' || p_type
    ELSE CASE WHEN p_partkey % 8 = 3 THEN p_name || ': ' || p_type END END AS title,
  CASE WHEN p_partkey % 4 = 0 THEN '' WHEN p_partkey % 8 = 7 THEN '' ELSE p_brand END AS authors,
  CASE p_partkey % 4 WHEN 0 THEN 'hint' WHEN 1 THEN 'seed_isbn13' WHEN 2 THEN 'seed_isbn10' ELSE CASE WHEN p_partkey % 8 = 3 THEN 'search_index' ELSE 'none' END END AS provenance
  FROM part""")
def search_terms(t: Tables):
    base = t.part.selectExpr("p_partkey AS k", "concat('13-', p_partkey) AS isbn13", "concat('10-', p_partkey) AS isbn10", "p_name", "p_type", "p_brand")
    hints = base.selectExpr("isbn13", "isbn10", "IF(k % 4 = 0, p_name, NULL) AS title", "cast(array() AS array<string>) AS authors")
    found = ["p_name AS title", "p_type AS subtitle", "array(p_brand) AS authors"]
    seed = base.where("k % 4 = 1").selectExpr("isbn13 AS isbn", *found).unionByName(base.where("k % 4 = 2").selectExpr("isbn10 AS isbn", *found))
    index = base.where("k % 8 = 3").selectExpr("isbn13", *found)
    out = worklist.search_terms(hints, seed, index, subtitle=True)
    return out.select(F.substring("isbn13", 4, 20).cast("bigint").alias("p_partkey"), "title", F.array_join("authors", ", ").alias("authors"), "provenance")


# ------------------------------------------------------------------ ledgers
def _ledger_lines(t: Tables):
    kind = F.when(F.col("l_partkey") % 2 == 0, F.lit("no_data")).otherwise(F.lit("incomplete"))
    return t.lineitem.select(
        source_of(F.col("l_suppkey")).alias("source"), kind.alias("kind"), _book("l_partkey").alias("isbn13"), "l_linenumber",
        F.when(F.col("l_returnflag") == "R", F.lit("discard")).otherwise(F.lit("note")).alias("op"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("bigint").alias("seq"))


_LEDGER_SQL = f"""lines AS (SELECT {sql_source("l_suppkey")} AS source, CASE WHEN l_partkey % 2 = 0 THEN 'no_data' ELSE 'incomplete' END AS kind,
  '978' || lpad(CAST(l_partkey AS VARCHAR),10,'0') AS isbn13, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'discard' ELSE 'note' END AS op,
  l_orderkey * 10 + l_linenumber AS seq FROM lineitem),
last_change AS (SELECT source, kind, isbn13, op FROM lines WHERE l_linenumber > 2
  QUALIFY row_number() OVER (PARTITION BY source, kind, isbn13 ORDER BY seq DESC, op DESC) = 1),
stored AS (SELECT DISTINCT source, kind, isbn13 FROM lines WHERE l_linenumber <= 2)"""


@catalog.query(f"""WITH {_LEDGER_SQL} SELECT source, kind, isbn13 FROM last_change WHERE op = 'note'
  UNION ALL SELECT source, kind, isbn13 FROM stored s WHERE NOT EXISTS (SELECT 1 FROM last_change c
    WHERE c.source = s.source AND c.kind = s.kind AND c.isbn13 = s.isbn13)""")
def ledger_merge(t: Tables):
    lines = _ledger_lines(t)
    return ledger.merge(lines.where("l_linenumber <= 2"), lines.where("l_linenumber > 2"))


@catalog.query(f"""WITH {_LEDGER_SQL} SELECT c.source, c.kind, count(*) AS recorded FROM last_change c ANTI JOIN stored s
  ON c.source = s.source AND c.kind = s.kind AND c.isbn13 = s.isbn13 WHERE c.op = 'note' GROUP BY 1, 2""")
def ledger_recorded(t: Tables):
    lines = _ledger_lines(t)
    return ledger.newly_noted(lines.where("l_linenumber <= 2"), lines.where("l_linenumber > 2"))


@catalog.query(f"""WITH {OUTCOMES_SQL} SELECT source, 'no_data' AS kind, isbn13, 'note' AS op, pos AS seq FROM outcomes
    WHERE status = 'empty' AND trustworthy
  UNION ALL SELECT source, 'incomplete', isbn13, CASE WHEN incomplete THEN 'note' ELSE 'discard' END, pos FROM outcomes
    WHERE status <> 'skipped' AND (incomplete OR has_metadata)""")
def ledger_rules(t: Tables):
    return ledger.changes_from_outcomes(outcomes.classify(derived_outcomes(t)))


@catalog.query(f"""SELECT {sql_source("p_partkey")} AS source, count(*) AS queued FROM part WHERE p_partkey % 3 = 0 GROUP BY 1""")
def missing_covers(t: Tables):
    records = t.part.select(_book("p_partkey").alias("isbn13"), source_of(F.col("p_partkey")).alias("source"), "p_partkey")
    queued = ledger.missing_covers(records, records.where("p_partkey % 3 <> 0"))
    return queued.groupBy("source").agg(F.count(F.lit(1)).alias("queued"))


# ------------------------------------------------------------------ metadata
@catalog.query("""SELECT o_custkey, o_orderkey, o_orderstatus FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def metadata_latest(t: Tables):
    log = t.orders.select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    return upsert.latest(log, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@catalog.query("""WITH latest AS (SELECT o_custkey, o_orderkey, o_orderkey % 2 AS half, o_orderstatus FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderkey % 2 ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
  SELECT 'shop' AS source, o_custkey, o_orderkey, o_orderstatus FROM latest l WHERE half = 1
    OR NOT EXISTS (SELECT 1 FROM latest n WHERE n.half = 1 AND n.o_custkey = l.o_custkey)""")
def metadata_upsert(t: Tables):
    log = t.orders.select(F.lit("shop").alias("source"), "o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    keys, order = ["source", "o_custkey"], ["o_orderdate", "o_orderkey"]
    stored = upsert.latest(log.where("o_orderkey % 2 = 0"), keys, order)
    new = upsert.latest(log.where("o_orderkey % 2 = 1"), keys, order)
    return upsert.upsert(stored, new, keys).drop("o_orderdate")


@catalog.query("""SELECT p_partkey, p_name AS title, CASE WHEN p_size % 4 = 0 THEN '' ELSE p_brand END AS authors,
  CASE WHEN p_size % 5 <> 0 THEN p_brand END AS publisher, NULLIF(CASE WHEN p_size % 3 = 0 THEN '' ELSE p_type || ', ' || p_brand END, '') AS genre FROM part""")
def canonical_record(t: Tables):
    return outcomes.canonical(_part_records(t)).select(
        F.col("isbn13").cast("bigint").alias("p_partkey"), "title", F.array_join("authors", ", ").alias("authors"), "publisher", "genre")


def _part_records(t: Tables):
    return t.part.selectExpr(
        "string(p_partkey) AS isbn13", "p_name AS title", "IF(p_size % 4 = 0, cast(array() AS array<string>), array(p_brand)) AS authors",
        "IF(p_size % 5 <> 0, p_brand, NULL) AS publisher", "IF(p_partkey % 3 = 0, p_type, NULL) AS origin",
        "IF(p_size % 2 = 0, '', '2001') AS date_of_publication", "string(NULL) AS language",
        "IF(p_size % 3 = 0, cast(array() AS array<string>), array(p_type, p_brand)) AS genres")


@catalog.query("""WITH s AS (SELECT *, count(*) OVER () AS n FROM part)
  SELECT field, found, n - found AS missing FROM (
  SELECT 'title' AS field, count(*) AS found, count(*) AS n FROM part UNION ALL SELECT 'authors', count(*) FILTER (WHERE p_size % 4 <> 0), count(*) FROM part
  UNION ALL SELECT 'publisher', count(*) FILTER (WHERE p_size % 5 <> 0), count(*) FROM part UNION ALL SELECT 'origin', count(*) FILTER (WHERE p_partkey % 3 = 0), count(*) FROM part
  UNION ALL SELECT 'date_of_publication', count(*) FILTER (WHERE p_size % 2 <> 0), count(*) FROM part UNION ALL SELECT 'language', 0, count(*) FROM part
  UNION ALL SELECT 'genres', count(*) FILTER (WHERE p_size % 3 <> 0), count(*) FROM part)""")
def field_completeness(t: Tables):
    return outcomes.completeness_report(_part_records(t))


@catalog.query("""SELECT p_partkey, array_to_string(list_filter(['title', CASE WHEN p_size % 4 <> 0 THEN 'authors' END, CASE WHEN p_size % 5 <> 0 THEN 'publisher' END,
  CASE WHEN p_partkey % 3 = 0 THEN 'origin' END, CASE WHEN p_size % 2 <> 0 THEN 'date_of_publication' END, CASE WHEN p_size % 3 <> 0 THEN 'genres' END], lambda x: x IS NOT NULL), ',') AS found,
  7 - (1 + CAST(p_size % 4 <> 0 AS INT) + CAST(p_size % 5 <> 0 AS INT) + CAST(p_partkey % 3 = 0 AS INT) + CAST(p_size % 2 <> 0 AS INT) + CAST(p_size % 3 <> 0 AS INT)) AS missing FROM part""")
def fields_found(t: Tables):
    marked = outcomes.completeness(_part_records(t))
    return marked.select(F.col("isbn13").cast("bigint").alias("p_partkey"), F.array_join("found", ",").alias("found"), F.size("missing").alias("missing"))


# ------------------------------------------------------------------ artefacts as tables
def _document_artefacts(t: Tables):
    return t.documents.select(F.pmod("doc_id", F.lit(97)).cast("string").alias("isbn13"), "source", (F.floor(F.col("doc_id") / 97) + 1).alias("n"), "doc_id")


@catalog.query("""WITH a AS (SELECT doc_id % 97 AS b, source, doc_id FROM documents)
  SELECT doc_id FROM a WHERE doc_id % 6 = 3 UNION ALL SELECT doc_id FROM a o WHERE doc_id % 2 = 0 AND NOT EXISTS (
    SELECT 1 FROM a n WHERE n.doc_id % 6 = 3 AND n.b = o.b AND n.source = o.source)""")
def artefact_replace(t: Tables):
    rows = _document_artefacts(t)
    return replace_artefacts(rows.where("doc_id % 2 = 0"), rows.where("doc_id % 6 = 3")).select("doc_id")


@catalog.query("""SELECT doc_id, (doc_id % 97) || '_r_' || source || '_' || (doc_id // 97 + 1) || '.txt' AS review, (doc_id % 97) || '_cp_' || source || '_' || (doc_id // 97 + 1) || '.png' AS cover FROM documents""")
def artefact_names(t: Tables):
    return _document_artefacts(t).select("doc_id", artefact_name("reviews", F.lit("txt")).alias("review"), artefact_name("covers", F.lit("png")).alias("cover"))


# ------------------------------------------------------------------ place of publication
_PLACES = ["London", "New York", "None", "", "Paris"]


def _seed_origins(t: Tables):
    place = F.element_at(F.array(*[F.lit(p) for p in _PLACES]), (F.pmod("p_size", F.lit(5)) + 1).cast("int"))
    return t.part.select(F.concat(F.lit("b"), F.floor(F.col("p_partkey") / 2).cast("string")).alias("isbn13"), F.col("p_partkey").alias("pos"),
                         F.when(F.col("p_partkey") % 3 == 0, place).alias("origin"))


_ORIGIN_SQL = f"""seed AS (SELECT 'b' || CAST(p_partkey // 2 AS VARCHAR) AS isbn13, p_partkey AS pos,
  CASE WHEN p_partkey % 3 = 0 THEN (['{"','".join(_PLACES)}'])[p_size % 5 + 1] END AS origin FROM part),
origins AS (SELECT isbn13, arg_max(origin, pos) AS origin, min(pos) AS first_pos FROM seed WHERE origin IS NOT NULL AND origin NOT IN ('', 'None') GROUP BY 1)"""


@catalog.query(f"WITH {_ORIGIN_SQL} SELECT isbn13, origin FROM origins")
def origin_map(t: Tables):
    return origin.origin_map(_seed_origins(t)).select("isbn13", "origin")


@catalog.query(f"""WITH {_ORIGIN_SQL} SELECT (SELECT count(*) FROM seed) AS total, count(*) AS with_origin, count(DISTINCT origin) AS spellings,
  round(100.0 * count(*) / (SELECT count(*) FROM seed), 1) AS percent FROM origins""")
def origin_coverage(t: Tables):
    seed = _seed_origins(t)
    return origin.coverage(seed, origin.origin_map(seed))


@catalog.query(f"WITH {_ORIGIN_SQL} SELECT origin, count(*) AS books FROM origins GROUP BY 1 ORDER BY 2 DESC, min(first_pos) LIMIT 5")
def origin_top(t: Tables):
    return origin.top_spellings(origin.origin_map(_seed_origins(t)))


@catalog.query(f"""WITH {_ORIGIN_SQL}, target AS (SELECT 'b' || CAST(p_partkey AS VARCHAR) AS isbn13, CASE WHEN p_partkey % 10 = 0 THEN 'Oslo' WHEN p_partkey % 10 = 5 THEN 'None' END AS origin FROM part)
  SELECT t.isbn13, CASE WHEN o.origin IS NOT NULL AND (t.origin IS NULL OR t.origin IN ('', 'None')) THEN o.origin ELSE t.origin END AS origin,
  CASE WHEN o.origin IS NULL THEN 'absent' WHEN t.origin IS NULL OR t.origin IN ('', 'None') THEN 'fill' ELSE 'keep' END AS action
  FROM target t LEFT JOIN origins o ON t.isbn13 = o.isbn13""")
def origin_backfill(t: Tables):
    own = F.when(F.col("p_partkey") % 10 == 0, F.lit("Oslo")).when(F.col("p_partkey") % 10 == 5, F.lit("None"))
    targets = t.part.select(F.concat(F.lit("b"), F.col("p_partkey").cast("string")).alias("isbn13"), own.alias("origin"))
    return origin.backfill(targets, origin.origin_map(_seed_origins(t)))


@catalog.query(f"WITH {_ORIGIN_SQL} SELECT isbn13, origin, 'openlibrary' AS origin_source FROM origins")
def origin_sidecar(t: Tables):
    return origin.sidecar(origin.origin_map(_seed_origins(t)))
