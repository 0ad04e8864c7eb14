"""Outcomes, reports, walls and host health."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import duration_text, rating_text
from ..functions.urls import host_of
from ..operators import hosts, outcomes, passes, report, walls
from .base import Catalog, Tables
from .derive import FETCH_SQL, OUTCOMES_SQL, SOURCES_SQL, fetch_log, source_of, sql_source
from .derive import outcomes as derived_outcomes

catalog = Catalog()


def _classified(t: Tables):
    return outcomes.classify(derived_outcomes(t))


# ------------------------------------------------------------------ outcomes
@catalog.query(f"WITH {OUTCOMES_SQL} SELECT isbn13, source, status, trustworthy FROM outcomes")
def outcome_status(t: Tables):
    return _classified(t).select("isbn13", "source", "status", "trustworthy")


_SUMMARY_SQL = f"""{FETCH_SQL}, ends AS (SELECT isbn13, source, ts AS e_ts, seq AS e_seq FROM log
    QUALIFY row_number() OVER (PARTITION BY isbn13, source ORDER BY ts DESC, seq DESC) = 1),
contacts AS (SELECT isbn13, source, host, bool_or(responded) AS responded FROM log GROUP BY ALL),
known AS (SELECT c.isbn13, c.source, c.host, c.responded, l.block_reason AS registered FROM contacts c JOIN ends e USING (isbn13, source)
    LEFT JOIN log l ON l.host = c.host AND l.block_reason IS NOT NULL AND (l.ts < e.e_ts OR (l.ts = e.e_ts AND l.seq <= e.e_seq))
    QUALIFY row_number() OVER (PARTITION BY c.isbn13, c.source, c.host ORDER BY l.ts DESC NULLS LAST, l.seq DESC NULLS LAST) = 1),
summary AS (SELECT isbn13, source, count(*) AS attempted_hosts, count(*) FILTER (WHERE responded) AS responded_hosts,
    arg_min(registered, host) FILTER (WHERE registered IS NOT NULL) AS block_reason FROM known GROUP BY ALL)"""


@catalog.query(f"WITH {_SUMMARY_SQL} SELECT * FROM summary")
def fetch_log_summary(t: Tables):
    return outcomes.pair_summary(fetch_log(t))


@catalog.query(f"WITH {_SUMMARY_SQL} SELECT isbn13, source, block_reason IS NULL AND responded_hosts > 0 AS trustworthy, CASE WHEN block_reason IS NULL THEN 'empty' ELSE 'blocked' END AS status FROM summary")
def outcome_trust(t: Tables):
    """Pairs that brought nothing back: which of them may be called absent."""
    nothing = outcomes.pair_summary(fetch_log(t)).withColumns({
        "has_metadata": F.lit(False), "has_payload": F.lit(False), "missing": F.array().cast("array<string>"),
        "warnings": F.array().cast("array<string>")})
    return outcomes.classify(nothing).select("isbn13", "source", "trustworthy", "status")


@catalog.query(f"""WITH {FETCH_SQL} SELECT host, seq, last_value(block_reason IGNORE NULLS) OVER (PARTITION BY host ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS registered FROM log""")
def block_registry(t: Tables):
    return outcomes.block_registry(fetch_log(t)).select("host", "seq", "registered")


_RUN_SQL = f"""{_SUMMARY_SQL}, books AS (SELECT DISTINCT event_id % 997 AS n FROM events),
pairs AS (SELECT n, '978' || lpad(CAST(n AS VARCHAR), 10, '0') AS isbn13, unnest({SOURCES_SQL}) AS source FROM books),
before AS (SELECT 'no_data' AS kind, isbn13, source FROM pairs WHERE source = {sql_source("(n + 1)")} AND n % 2 = 0
  UNION ALL SELECT 'incomplete', isbn13, source FROM pairs WHERE source = {sql_source("n")} AND n % 3 = 0),
found AS (SELECT '978' || lpad(CAST(doc_id % 997 AS VARCHAR), 10, '0') AS isbn13, {sql_source("doc_id")} AS source, min(doc_id) AS d FROM documents GROUP BY ALL),
passes AS (SELECT p.isbn13, p.source, f.d IS NOT NULL AS has, f.d % 2 = 1 AS flawed, coalesce(f.d % 4 = 0, false) AS incomplete,
    s.block_reason, coalesce(s.responded_hosts, 0) AS responded,
    NOT EXISTS (FROM before b WHERE b.kind = 'incomplete' AND b.isbn13 = p.isbn13 AND b.source = p.source)
    AND (p.source = {sql_source("p.n")} OR EXISTS (FROM before b WHERE b.kind = 'no_data' AND b.isbn13 = p.isbn13 AND b.source = p.source)) AS skipped
  FROM pairs p LEFT JOIN found f USING (isbn13, source) LEFT JOIN summary s USING (isbn13, source)),
run_outcomes AS (SELECT *, CASE WHEN skipped THEN 'skipped' WHEN NOT has AND block_reason IS NOT NULL THEN 'blocked' WHEN NOT has THEN 'empty' WHEN flawed THEN 'partial' ELSE 'ok' END AS status,
  skipped OR has OR (block_reason IS NULL AND responded > 0) AS trustworthy FROM passes)"""


def _run(t: Tables):
    """Books of the fetch log, records of the documents, and a state before made of both."""
    number = F.pmod("event_id", F.lit(997))
    pairs = (t.events.select(number.alias("n")).distinct()
             .select("n", F.concat(F.lit("978"), F.lpad(F.col("n").cast("string"), 10, "0")).alias("isbn13")))
    stored = pairs.select("n", "isbn13", source_of(F.col("n")).alias("source"))
    absent = pairs.where("n % 2 = 0").select("isbn13", source_of(F.col("n") + 1).alias("source"), F.lit("no_data").alias("kind"))
    ledgers = absent.unionByName(stored.where("n % 3 = 0").select("isbn13", "source", F.lit("incomplete").alias("kind")))
    book = F.concat(F.lit("978"), F.lpad(F.pmod("doc_id", F.lit(997)).cast("string"), 10, "0"))
    least = t.documents.groupBy(book.alias("isbn13"), source_of(F.col("doc_id")).alias("source")).agg(F.min("doc_id").alias("d"), F.min_by("text", "doc_id").alias("title"))
    one = F.array(F.lit("x"))
    records = least.select("isbn13", "source", "title", one.alias("authors"), F.expr("IF(d % 2 = 1, '', 'p')").alias("publisher"), F.lit("o").alias("origin"),
                           F.lit("2020").alias("date_of_publication"), F.lit("en").alias("language"), one.alias("genres"), (F.col("d") % 4 == 0).alias("incomplete"))
    return passes.run(pairs, stored, ledgers, records, fetch_log(t))


@catalog.query(f"WITH {_RUN_SQL} SELECT isbn13, source, status, trustworthy FROM run_outcomes")
def run_outcomes(t: Tables):
    return _run(t).outcomes.select("isbn13", "source", "status", "trustworthy")


@catalog.query(f"""WITH {_RUN_SQL}, changes AS (SELECT source, 'no_data' AS kind, isbn13, 'note' AS op FROM run_outcomes WHERE status = 'empty' AND trustworthy
    UNION ALL SELECT source, 'incomplete', isbn13, CASE WHEN incomplete THEN 'note' ELSE 'discard' END FROM run_outcomes WHERE status <> 'skipped' AND (incomplete OR has))
  SELECT source, kind, isbn13 FROM changes WHERE op = 'note' UNION SELECT source, kind, isbn13 FROM before ANTI JOIN changes USING (source, kind, isbn13)""")
def run_ledgers(t: Tables):
    return _run(t).ledgers


# ------------------------------------------------------------------ reports
@catalog.query(f"""WITH {OUTCOMES_SQL} SELECT source, count(*) AS seen, count(*) FILTER (WHERE has_metadata) AS metadata, CAST(sum(reviews) AS BIGINT) AS reviews,
  CAST(sum(covers) AS BIGINT) AS covers, count(*) FILTER (WHERE status='ok') AS ok, count(*) FILTER (WHERE status='partial') AS partial, count(*) FILTER (WHERE status='empty') AS empty,
  count(*) FILTER (WHERE status='blocked') AS blocked, count(*) FILTER (WHERE status='error') AS error, count(*) FILTER (WHERE status='skipped') AS skipped FROM outcomes GROUP BY 1""")
def report_sources(t: Tables):
    return report.per_source(_classified(t))


@catalog.query(f"""WITH {OUTCOMES_SQL} SELECT source, count(*) FILTER (WHERE has_metadata) AS succeeded, count(*) AS attempted,
  round(100.0 * count(*) FILTER (WHERE has_metadata) / greatest(1, count(*)), 4) AS rate, round(sum(seconds) / greatest(1, count(*)), 4) AS mean_seconds
  FROM outcomes WHERE status <> 'skipped' GROUP BY 1""")
def report_rates(t: Tables):
    return report.rates(_classified(t))


@catalog.query(f"""WITH {OUTCOMES_SQL}, books AS (SELECT isbn13, bool_or(has_metadata) AS has, sum(reviews) AS r, sum(covers) AS c, count(*) FILTER (WHERE incomplete) AS i,
  count(*) FILTER (WHERE status='empty' AND NOT trustworthy) AS u FROM outcomes GROUP BY 1)
  SELECT count(*) AS books, count(*) FILTER (WHERE has) AS with_metadata, count(*) FILTER (WHERE NOT has) AS failed, CAST(sum(r) + sum(c) AS BIGINT) AS files,
  CAST(sum(r) AS BIGINT) AS reviews, CAST(sum(c) AS BIGINT) AS covers, CAST(sum(i) AS BIGINT) AS incomplete, CAST(sum(u) AS BIGINT) AS untrusted_empty FROM books""")
def report_totals(t: Tables):
    return report.totals(_classified(t))


@catalog.query(f"WITH {OUTCOMES_SQL} SELECT source, count(*) AS skipped FROM outcomes WHERE status = 'skipped' GROUP BY 1")
def report_skips(t: Tables):
    return report.skips(_classified(t))


@catalog.query(f"WITH {OUTCOMES_SQL} SELECT string_agg(source, ', ' ORDER BY source) AS blocked FROM (SELECT DISTINCT source FROM outcomes WHERE status = 'blocked')")
def blocked_sources(t: Tables):
    return report.blocked_sources(_classified(t))


@catalog.query(f"""WITH {OUTCOMES_SQL} SELECT source, pos, isbn13, CASE WHEN has_metadata THEN 'succeeded' WHEN trustworthy THEN 'failed' ELSE 'untrusted' END AS section,
  CASE WHEN has_metadata THEN 3 WHEN trustworthy THEN 1 ELSE 2 END AS section_rank, status,
  CASE WHEN NOT has_metadata THEN CASE WHEN status = 'blocked' THEN 'the site was blocking automated access' WHEN NOT trustworthy THEN 'no host was successfully reached'
    ELSE coalesce(first_warning, 'no metadata parsed from the page') END END AS reason FROM outcomes WHERE status <> 'skipped'""")
def report_reasons(t: Tables):
    return report.detail_rows(_classified(t))


@catalog.query(f"WITH {OUTCOMES_SQL} SELECT CASE WHEN bool_or(has_metadata) OR bool_and(status = 'skipped') THEN 0 ELSE 1 END AS exit_code FROM outcomes")
def run_state(t: Tables):
    return report.run_state(_classified(t))


@catalog.query("""SELECT l_orderkey, CASE WHEN s >= 3600 THEN (s // 3600) || 'h' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || 'm' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || 's'
  WHEN s >= 60 THEN (s // 60) || 'm' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || 's' ELSE s || 's' END AS elapsed
  FROM (SELECT l_orderkey, CAST(sum(CAST(l_quantity AS BIGINT) * l_linenumber * 7) AS BIGINT) AS s FROM lineitem GROUP BY 1)""")
def report_duration(t: Tables):
    seconds = F.sum(F.col("l_quantity").cast("bigint") * F.col("l_linenumber") * 7)
    return t.lineitem.groupBy("l_orderkey").agg(seconds.alias("s")).select("l_orderkey", duration_text(F.col("s")).alias("elapsed"))


@catalog.query("SELECT rating, count(*) AS n FROM (SELECT CASE WHEN CAST(l_quantity AS BIGINT) % 6 <> 0 THEN (CAST(l_quantity AS BIGINT) % 6) || '/5' END AS rating FROM lineitem) GROUP BY 1")
def rating_texts(t: Tables):
    stars = F.pmod(F.col("l_quantity").cast("bigint"), F.lit(6))
    return t.lineitem.groupBy(rating_text(stars).alias("rating")).agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ walls
_BODY = """CASE page_id % 7 WHEN 1 THEN '<div class="g-recaptcha"></div>' || html WHEN 2 THEN '<p>Access Denied</p>' || html
    WHEN 3 THEN '<title>Just a moment...</title>' ELSE html END"""


@catalog.query(f"""WITH r AS (SELECT page_id, {_BODY} AS body, CASE page_id % 5 WHEN 4 THEN 403 WHEN 3 THEN 429 WHEN 2 THEN 503 ELSE 200 END AS status,
  CASE page_id % 11 WHEN 0 THEN 'challenge' WHEN 1 THEN 'allow' END AS waf, CASE page_id % 13 WHEN 0 THEN 'image/png' WHEN 1 THEN NULL ELSE 'text/html' END AS kind FROM pages),
 m AS (SELECT *, CASE WHEN kind = 'image/png' THEN '' ELSE substr(lower(body), 1, 8192) END AS head, CASE WHEN kind = 'image/png' THEN 0 ELSE length(body) END AS size FROM r),
 h AS (SELECT *, CASE WHEN contains(head, 'g-recaptcha') THEN 'g-recaptcha' END AS hard, CASE WHEN contains(head, 'just a moment...') THEN 'just a moment...' WHEN contains(head, 'access denied') THEN 'access denied' END AS soft FROM m)
 SELECT page_id, CASE WHEN waf = 'challenge' THEN 'AWS WAF challenge response (HTTP ' || status || ')'
  WHEN hard IS NOT NULL THEN 'anti-bot interstitial detected (matched ''' || hard || ''')'
  WHEN soft IS NOT NULL AND size BETWEEN 1 AND 20480 THEN 'anti-bot interstitial detected (''' || soft || ''', body only ' || size || ' chars)'
  WHEN soft IS NOT NULL AND status >= 400 THEN 'anti-bot interstitial detected (''' || soft || ''', HTTP ' || status || ')'
  WHEN status = 403 THEN 'HTTP 403 wall' WHEN status = 429 THEN 'HTTP 429 rate limit' END AS reason,
  CASE WHEN contains(substr(lower(body), 1, 8192), 'g-recaptcha') THEN 'anti-bot interstitial in rendered DOM (''g-recaptcha'')'
   WHEN contains(substr(lower(body), 1, 8192), 'just a moment...') THEN 'anti-bot interstitial in rendered DOM (''just a moment...'')'
   WHEN contains(substr(lower(body), 1, 8192), 'access denied') THEN 'anti-bot interstitial in rendered DOM (''access denied'')' END AS rendered FROM h""")
def page_walls(t: Tables):
    """Captured responses with a wall marker planted in some of them."""
    r = t.pages.select(
        "page_id", F.expr(_BODY).alias("body"), F.expr("CASE page_id % 5 WHEN 4 THEN 403 WHEN 3 THEN 429 WHEN 2 THEN 503 ELSE 200 END").alias("status"),
        F.expr("CASE page_id % 11 WHEN 0 THEN 'challenge' WHEN 1 THEN 'allow' END").alias("waf"),
        F.expr("CASE page_id % 13 WHEN 0 THEN 'image/png' WHEN 1 THEN NULL ELSE 'text/html' END").alias("kind"))
    return r.select("page_id", walls.classify(F.col("status"), F.col("waf"), F.col("kind"), F.col("body")).alias("reason"),
                    walls.in_rendered(F.col("body")).alias("rendered"))


@catalog.query("""SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'notfound' WHEN 1 THEN 'signin' WHEN 2 THEN 'challenge' WHEN 3 THEN 'challenge' WHEN 4 THEN 'notfound'
  WHEN 5 THEN 'throttle' WHEN 6 THEN 'wrong-host' ELSE 'missing-anchor' END AS page_class FROM pages""")
def page_classes(t: Tables):
    """One planted sign of each site's refusal page, found in whole pages."""
    signs = ["<title>Page Not Found</title>", "<input id=\"ap_email_login\">", "<title>challenged | kobo.com</title>", "<script>window._cf_chl_opt={}</script>",
             "<h1>Page not found</h1>", "<img src=\"crackedegg.jpg\">", "", ""]
    shops = ["amazon", "amazon", "kobo", "bookbub", "bookbub", "audible", "audible", "amazon"]
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod("page_id", F.lit(8)) + 1).cast("int"))
    made = t.pages.select("page_id", pick(shops).alias("source"), F.concat(pick(signs), "html").alias("html"),
                          F.when(F.pmod("page_id", F.lit(8)) == 5, F.lit("https://www.audible.com/pd/x")).otherwise(
                              F.lit("https://www.example.com/dp/x")).alias("url"))
    return made.select("page_id", walls.page_class(F.col("source"), F.col("url"), F.col("html"), F.lit(False)).alias("page_class"))


# ------------------------------------------------------------------ hosts
_STREAK_SQL = f"""{FETCH_SQL}, islands AS (SELECT *, count(*) FILTER (WHERE ok) OVER (PARTITION BY host ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS island FROM log),
runs AS (SELECT host, seq, CASE WHEN ok THEN 0 ELSE count(*) FILTER (WHERE NOT ok) OVER (PARTITION BY host, island ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) END AS strikes FROM islands)"""


@catalog.query(f"WITH {_STREAK_SQL} SELECT host, seq, strikes FROM runs")
def host_streaks(t: Tables):
    return hosts.streaks(fetch_log(t)).select("host", "seq", "strikes")


@catalog.query(f"""WITH {_STREAK_SQL} SELECT host, max(strikes) AS longest, CAST(sum(CASE WHEN strikes < 3 THEN 0 ELSE 30 * least(strikes - 2, 4) END) AS BIGINT) AS pause_seconds FROM runs GROUP BY 1""")
def host_cooldown(t: Tables):
    runs = hosts.streaks(fetch_log(t))
    return runs.groupBy("host").agg(F.max("strikes").alias("longest"), F.sum(hosts.pause_seconds(F.col("strikes"))).alias("pause_seconds"))


@catalog.query("""WITH h AS (SELECT page_id, CASE page_id % 4 WHEN 1 THEN 'covers.openlibrary.org' WHEN 2 THEN 'ia' || page_id || '.us.archive.org' WHEN 3 THEN 'openlibrary.org'
   ELSE lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) END AS host FROM pages)
  SELECT page_id, host, CASE page_id % 4 WHEN 1 THEN 3.5 WHEN 2 THEN 3.5 WHEN 3 THEN 2.5 ELSE 1.0 END AS min_delay, CASE page_id % 4 WHEN 1 THEN 45 WHEN 2 THEN 60 WHEN 3 THEN 30 ELSE 25 END AS timeout FROM h""")
def host_limits(t: Tables):
    kind = F.pmod("page_id", F.lit(4))
    host = (F.when(kind == 1, F.lit("covers.openlibrary.org")).when(kind == 2, F.concat(F.lit("ia"), F.col("page_id").cast("string"), F.lit(".us.archive.org")))
            .when(kind == 3, F.lit("openlibrary.org")).otherwise(host_of(F.col("url"))))
    found = t.pages.select("page_id", host.alias("host"))
    return found.withColumn("limits", hosts.host_limits(F.col("host"), 1.0, 2.0, 25)).select("page_id", "host", "limits.min_delay", "limits.timeout")
