"""Text, list and date queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixed import DERIVATIVE_MARKERS, LANGUAGE_NAMES
from ..functions import dates, lists, text
from .base import Catalog, Tables

catalog = Catalog()


def sql_fold(x: str) -> str:
    return f"trim(regexp_replace(strip_accents(lower(replace({x}, 'ß', 'ss'))), '[^a-z0-9]+', ' ', 'g'))"


# ------------------------------------------------------------------ cleaning
@catalog.query("""WITH d AS (SELECT doc_id, '  ' || replace(text, '. ', ' & ' || chr(10) || chr(10) || chr(10) || chr(10)) || chr(9) || 'é…< z – ’’ {,¬it; ' || CASE WHEN doc_id % 50 = 0 THEN '½⟺' ELSE '' END AS s FROM documents),
  c AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(s, '[ \\t]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS s FROM d)
  SELECT doc_id, md5(s) AS digest, length(s) AS chars FROM c""")
def clean_text(t: Tables):
    """Documents dirtied with entities, carriage returns, control and zero-width characters."""
    dirty = F.concat(F.lit("  "), F.replace("text", F.lit(". "), F.lit(" &amp;\x07 \r\n\r\n\n\n")), F.lit("\t&eacute;&hellip;&#60;​&nbsp;&#x7a; &#150; &#146;&#x92; &#123;&#44;&notit; "),
                     F.expr("IF(doc_id % 50 = 0, '&half;&#x1;&Longleftrightarrow;', '')"))
    cleaned = text.clean_rows(t.documents.select("doc_id", dirty.alias("s")), "s")
    return cleaned.select("doc_id", F.md5("s").alias("digest"), F.length("s").cast("bigint").alias("chars"))


@catalog.query(f"SELECT doc_id, md5({sql_fold('text')}) AS digest FROM documents")
def fold_text(t: Tables):
    return t.documents.select("doc_id", F.md5(text.fold(F.col("text"))).alias("digest"))


@catalog.query(f"""SELECT conv_id, turn, {sql_fold("regexp_split_to_array(text, '\\s*(?::|;|\\s[-–—]\\s|\\(|\\[)\\s*')[1]")} AS main FROM (
  SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN role || ': ' || text WHEN 1 THEN replace(text, '. ', ' (') ELSE replace(text, ', ', ' - ') END AS text FROM conversations)""")
def main_parts(t: Tables):
    made = F.expr("CASE turn % 3 WHEN 0 THEN concat(role, ': ', text) WHEN 1 THEN replace(text, '. ', ' (') ELSE replace(text, ', ', ' - ') END")
    return t.conversations.select("conv_id", "turn", text.main_part(made).alias("main"))


@catalog.query("""SELECT conv_id, turn, md5(regexp_replace(regexp_replace(text || chr(10) || 'tail', '^\\s+|\\s+$', '', 'g'), '\\n+', chr(10), 'g') || chr(10)) AS digest FROM conversations""")
def file_text(t: Tables):
    """What a text file of each turn would hold."""
    raw = F.concat(F.regexp_replace("text", "\\n+", "\r\n"), F.lit("\r\ntail \r\n"))
    return t.conversations.select("conv_id", "turn", F.md5(text.utf8_lines(raw)).alias("digest"))


@catalog.query("""SELECT doc_id, length(replace(text, '*', '')) + length(regexp_replace(regexp_replace(text, '\\*{2,}', '', 'g'), '[^*]', '', 'g')) AS kept FROM (
  SELECT doc_id, replace(text, ', ', '** *') AS text FROM documents)""")
def bold_marks(t: Tables):
    made = F.replace("text", F.lit(", "), F.lit("** *"))
    return t.documents.select("doc_id", F.length(text.drop_bold_marks(made)).cast("bigint").alias("kept"))


@catalog.query("""WITH d AS (SELECT doc_id, text || ' ' || text AS s, split_part(text || ' ' || text, chr(10), 1) AS f FROM documents),
  p AS (SELECT *, instr(substr(s, length(f) + 1), f) AS again FROM d)
  SELECT doc_id, md5(CASE WHEN length(f) >= 40 AND again > 0 THEN regexp_replace(substr(s, 1, length(f) + again - 1), '^\\s+|\\s+$', '', 'g') ELSE s END) AS digest FROM p""")
def blurb_repair(t: Tables):
    twice = F.concat("text", F.lit(" "), "text")
    return t.documents.select("doc_id", F.md5(text.repair_repeated(twice)).alias("digest"))


@catalog.query("""WITH c AS (SELECT conv_id, turn, text, CASE turn % 2 WHEN 0 THEN upper(substr(text, 1, 15)) ELSE role END AS h FROM conversations)
  SELECT conv_id, turn, md5(CASE WHEN starts_with(lower(text), lower(h)) THEN text ELSE h || chr(10) || chr(10) || text END) AS digest FROM c""")
def review_headings(t: Tables):
    heading = F.when(F.col("turn") % 2 == 0, F.upper(F.substring("text", 1, 15))).otherwise(F.col("role"))
    return t.conversations.select("conv_id", "turn", F.md5(text.with_heading(heading, F.col("text"))).alias("digest"))


@catalog.query("""SELECT conv_id, turn, md5(CASE turn % 3 WHEN 0 THEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') WHEN 1 THEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') ELSE text END) AS digest FROM conversations""")
def editorial_notes(t: Tables):
    made = F.expr("CASE turn % 3 WHEN 0 THEN concat(text, ' Librarian\\'s note: x') WHEN 1 THEN concat('Librarians note: skip\\n\\n', text) ELSE text END")
    return t.conversations.select("conv_id", "turn", F.md5(text.drop_librarian_note(made)).alias("digest"))


# ------------------------------------------------------------------ titles and people
@catalog.query(f"""SELECT c_custkey, coalesce(list_filter(string_split({sql_fold("c_mktsegment || ' é ' || c_name")}, ' '), lambda x: length(x) > 2)[-1], '') AS surname FROM customer""")
def surname_keys(t: Tables):
    return t.customer.select("c_custkey", text.surname_of(text.fold(F.concat("c_mktsegment", F.lit(" é "), "c_name"))).alias("surname"))


@catalog.query("SELECT c_custkey, c_custkey % 4 <> 1 AS agree FROM customer")
def authors_agree(t: Tables):
    name = F.concat(F.initcap("c_mktsegment"), F.lit(" Müller"), F.col("c_custkey").cast("string"))
    other = F.element_at(F.array(
        F.array(F.concat(F.lit("J. K. Muller"), F.col("c_custkey").cast("string"))), F.array(F.lit("Nobody Else")),
        F.array().cast("array<string>"), F.array(F.lit("Nobody Else"), F.upper(name))), (F.pmod("c_custkey", F.lit(4)) + 1).cast("int"))
    return t.customer.select("c_custkey", text.authors_agree(F.array(name), other).alias("agree"))


@catalog.query("SELECT p_partkey, p_partkey % 4 = 0 AS sequel FROM part")
def sequel_veto(t: Tables):
    right = F.expr("concat(p_name, CASE p_partkey % 4 WHEN 0 THEN ' Two' WHEN 1 THEN ' 1' WHEN 2 THEN ' One' ELSE ' Messiah' END)")
    return t.part.select("p_partkey", text.is_sequel(text.fold(F.concat("p_name", F.lit(" One"))), text.fold(right)).alias("sequel"))


_MARKERS_SQL = "['" + "','".join(DERIVATIVE_MARKERS) + "']"


@catalog.query(f"""WITH c AS (SELECT item_id, {sql_fold("CASE item_id % 4 WHEN 0 THEN 'Summary of ' || text WHEN 1 THEN 'A Guide to ' || text WHEN 2 THEN text || ' (Boxed Set)' ELSE text END")} AS cand,
    {sql_fold("CASE item_id % 8 WHEN 1 THEN 'a guide to ' || text ELSE text END")} AS want FROM benchmark)
  SELECT item_id, len(list_filter({_MARKERS_SQL}, lambda m: contains(cand, m) AND NOT contains(want, m))) > 0 AS derivative FROM c""")
def derivative_veto(t: Tables):
    cand = F.expr("CASE item_id % 4 WHEN 0 THEN concat('Summary of ', text) WHEN 1 THEN concat('A Guide to ', text) WHEN 2 THEN concat(text, ' (Boxed Set)') ELSE text END")
    want = F.expr("CASE item_id % 8 WHEN 1 THEN concat('a guide to ', text) ELSE text END")
    return t.benchmark.select("item_id", text.is_derivative(text.fold(cand), text.fold(want)).alias("derivative"))


@catalog.query("""SELECT p_partkey, replace(p_name, ' ', '-') || '-and-' || lower(p_type) || '-e-' || p_size AS slug, replace(p_name, ' ', '-') || '-' || lower(p_type) AS plain FROM part""")
def slugs(t: Tables):
    return t.part.select("p_partkey", text.slug(F.concat_ws(" ", "p_name", F.lit("&"), "p_type", F.lit("É!"), "p_size")).alias("slug"),
                         text.plain_slug(F.concat("p_name", F.lit(" & "), "p_type")).alias("plain"))


@catalog.query("""WITH b AS (SELECT item_id, text AS t, trim(regexp_split_to_array(text, '\\s*(?::|;|\\s[-–—]\\s|\\(|\\[)\\s*')[1]) AS head,
    list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM (SELECT item_id, replace(text, '. ', ': ') AS text FROM benchmark))
  SELECT DISTINCT item_id, variant FROM (SELECT item_id, unnest([t, CASE WHEN head <> '' THEN head END, CASE WHEN len(w) > 3 THEN array_to_string(w[1:3], ' ') END,
    CASE WHEN length(w[1]) >= 4 THEN w[1] END]) AS variant FROM b) WHERE variant IS NOT NULL""")
def title_variants(t: Tables):
    made = F.replace("text", F.lit(". "), F.lit(": "))
    return t.benchmark.select("item_id", F.explode(text.title_variants(made)).alias("variant"))


@catalog.query("SELECT p_partkey, p_name || ' ' || p_brand AS one, array_to_string([p_name, p_name || ' and ' || p_brand], '|') AS authors FROM part")
def search_titles(t: Tables):
    made = F.concat("p_name", F.lit(" "), "p_brand", F.lit(" ("), "p_type", F.lit(" Saga #"), "p_size", F.lit(")"))
    return t.part.select("p_partkey", text.search_title(made).alias("one"),
                         F.array_join(text.author_variants(F.array("p_name", "p_brand", "p_type")), "|").alias("authors"))


# ------------------------------------------------------------------ lists
@catalog.query("""SELECT p_partkey, array_to_string(CASE WHEN p_size % 2 = 0 THEN [p_name, p_type, p_brand] ELSE [p_name, p_brand, p_type] END, '|') AS items FROM part""")
def split_lists(t: Tables):
    made = F.expr("concat(p_name, IF(p_size % 2 = 0, concat(', ', p_type, ' & ', p_brand), concat(' and ', p_brand, ' / ', p_type)), '; ', upper(p_name), ' .')")
    return t.part.select("p_partkey", F.array_join(lists.split_list(made), "|").alias("items"))


@catalog.query("""WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents),
  f AS (SELECT doc_id, lower(replace(trim(word), 'ß', 'ss')) AS k, arg_min(word, i) AS word, min(i) AS i FROM w WHERE trim(word) <> '' GROUP BY 1, 2)
  SELECT doc_id, count(*) AS words, md5(string_agg(word, ' ' ORDER BY i)) AS digest FROM f GROUP BY 1""")
def ordered_dedupe(t: Tables):
    kept = t.documents.select("doc_id", lists.dedupe(F.split("text", " ")).alias("w"))
    return kept.select("doc_id", F.size("w").cast("bigint").alias("words"), F.md5(F.array_join("w", " ")).alias("digest")).where("words > 0")


_LANGS_SQL = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in LANGUAGE_NAMES.items()) + "}"


@catalog.query(f"""SELECT name, count(*) AS n FROM (SELECT CASE WHEN doc_id % 5 = 4 THEN 'Klingonese' ELSE coalesce({_LANGS_SQL}[lang], lang) END AS name FROM documents) GROUP BY 1""")
def language_names(t: Tables):
    raw = F.expr("CASE doc_id % 5 WHEN 0 THEN lang WHEN 1 THEN concat(upper(lang), '-XX') WHEN 2 THEN concat(lang, '_AT') WHEN 3 THEN concat(' ', lang, ' ') ELSE 'klingonese' END")
    return t.documents.select(text.language_name(raw).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@catalog.query("""SELECT doc_id, array_to_string(CASE WHEN lang = source THEN [lang] ELSE [lang, source, 'Fiction'] END, ', ') AS genre FROM documents""")
def genre_union(t: Tables):
    own = F.array("lang", F.concat(F.lit(" "), "source", F.lit(" ")), F.upper("lang"))
    record = F.array(F.upper("source"), F.lit(""), F.lit("Fiction"), F.lit("fiction"))
    return t.documents.select("doc_id", lists.genre_text(lists.union_genres(own, record)).alias("genre"))


@catalog.query("""SELECT p_partkey, p_brand AS publisher, p_type AS "language", 'n' || p_size AS pages FROM part""")
def label_pairs(t: Tables):
    lines = F.split(F.concat(F.lit("Publisher: "), "p_brand", F.lit("\nLanguage:\n"), "p_type", F.lit("\n\nPages : n"), F.col("p_size").cast("string"),
                             F.lit("\nPublisher: second\nPublisher Description: none\nno label\n"), F.repeat(F.lit("x"), 41), F.lit(": long")), "\n")
    pairs = lists.colon_pairs(lines, 40, ["description"])
    at = lambda k: F.try_element_at(pairs, F.lit(k))
    return t.part.select("p_partkey", at("publisher").alias("publisher"), at("language").alias("language"), at("pages").alias("pages"))


# ------------------------------------------------------------------ dates
@catalog.query("""SELECT o_orderkey, CASE o_orderkey % 12
   WHEN 3 THEN strftime(o_orderdate, '%Y-%m') WHEN 4 THEN strftime(o_orderdate, '%Y') WHEN 7 THEN strftime(o_orderdate, '%Y-%m')
   WHEN 9 THEN CASE WHEN day(o_orderdate) <= 12 THEN strftime(o_orderdate, '%Y-%d-%m') ELSE strftime(o_orderdate, '%Y-%m-%d') END
   WHEN 10 THEN o_orderpriority WHEN 11 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS iso,
  CASE o_orderkey % 12 WHEN 3 THEN 'month' WHEN 4 THEN 'year' WHEN 7 THEN 'month' WHEN 10 THEN 'text' WHEN 11 THEN NULL ELSE 'day' END AS precision FROM orders""")
def iso_dates(t: Tables):
    day = F.col("o_orderdate").cast("date")
    shape = lambda p: F.date_format(day, p)
    forms = [shape("MMMM d, yyyy"), shape("yyyy-MM-dd"), F.concat(F.lit("Published: "), shape("d"), F.lit("th "), shape("MMMM yyyy")), shape("MMMM yyyy"),
             F.concat(F.lit("c. "), shape("yyyy")), shape("dd/MM/yyyy"), shape("yyyy/M/d"), shape("yyyy-M"), shape("d MMM yyyy"), shape("MM/dd/yyyy"),
             F.concat(F.lit(" "), "o_orderpriority"), F.lit("  ")]
    raw = F.element_at(F.array(*forms), (F.pmod("o_orderkey", F.lit(12)) + 1).cast("int"))
    dated = t.orders.select("o_orderkey", dates.iso_date(raw).alias("iso"))
    return dated.select("o_orderkey", "iso", dates.date_precision(F.col("iso")).alias("precision"))


@catalog.query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS utc_day FROM events")
def epoch_dates(t: Tables):
    return t.events.select("event_id", dates.epoch_date(F.unix_millis(F.col("ts").cast("timestamp"))).alias("utc_day"))


@catalog.query("SELECT event_id, strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Los_Angeles', '%Y-%m-%d') AS pacific_day FROM events")
def pacific_dates(t: Tables):
    return t.events.select("event_id", dates.published_date(F.unix_millis(F.col("ts").cast("timestamp"))).alias("pacific_day"))


@catalog.query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS short, strftime(o_orderdate, '%Y-%m-%d') AS stamp FROM orders")
def short_dates(t: Tables):
    day = F.col("o_orderdate").cast("date")
    return t.orders.select("o_orderkey", dates.us_short_date(F.date_format(day, "MM-dd-yy")).alias("short"),
                           dates.stamp_date(F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T00:00:00Z"))).alias("stamp"))


@catalog.query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS reviewed, strftime(o_orderdate, '%Y-%m') AS published, o_orderpriority AS publisher FROM orders")
def phrase_dates(t: Tables):
    day = F.col("o_orderdate").cast("date")
    reviewed = F.concat(F.lit("Reviewed in the United States on "), F.date_format(day, "MMMM d, yyyy"))
    made = F.concat(F.lit("Published "), F.date_format(day, "MMMM yyyy"), F.lit(" by "), "o_orderpriority")
    parts = t.orders.select("o_orderkey", dates.iso_date(dates.reviewed_on(reviewed)).alias("reviewed"), dates.published_by(made).alias("p"))
    return parts.select("o_orderkey", "reviewed", F.col("p.date").alias("published"), F.col("p.publisher").alias("publisher"))
