"""The registered queries of the numbered operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeweave.llm._store import small_batches
from tomeweave.llm.chat_format import digests, format_conversations
from tomeweave.llm.class_lm import class_scores
from tomeweave.llm.collocations import collocations
from tomeweave.llm.decontaminate import contamination
from tomeweave.llm.language_id import languages
from tomeweave.llm.minhash_dedup import near_duplicates
from tomeweave.llm.pack import pack
from tomeweave.llm.periodic_runs import periodic_runs, respelled
from tomeweave.llm.quality_classifier import quality_scores
from tomeweave.llm.robust_outliers import quality_outliers
from tomeweave.llm.substring_dedup import substring_dedup
from tomeweave.llm.tier_pack import tier_pack
from tomeweave.llm.token_counts import token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(job: Callable[[SparkSession, str], DataFrame]):
        QUERIES[job.__name__] = job
        if sql:
            ORACLES[job.__name__] = sql
        return job
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return small_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


@query(r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY md5(array_to_string(w[i:i + 34], ' '))) AS n FROM s),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM h WHERE n > 1),
g AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM c GROUP BY doc_id),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS q FROM d),
k AS (SELECT p.doc_id, string_agg(w[q], ' ' ORDER BY q) AS kept FROM p LEFT JOIN c ON c.doc_id = p.doc_id AND c.p = q
      WHERE c.p IS NULL GROUP BY p.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN k USING (doc_id)""")
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (substring_dedup(table(spark, sf_dir, "documents"), min_words=35)
            .select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")))


@query(r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
             ELSE [array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 85 * (a.n + b.n - i)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.x, r.c FROM r JOIN e ON e.y = r.doc_id WHERE r.c < e.x),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM d JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)""")
def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


@query(r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 10 THEN [array_to_string(w, ' ')]
             ELSE [array_to_string(w[i:i + 9], ' ') FOR i IN range(1, len(w) - 8)] END) AS g,
             least(len(w), 10) AS n FROM b),
s AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
l AS (SELECT DISTINCT n FROM p),
x AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM s, l WHERE i + n - 1 <= len(w)),
o AS (SELECT x.doc_id, x.i, x.n, p.item_id FROM x JOIN p ON x.g = p.g AND x.n = p.n),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS q FROM o) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS h
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM o) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items, coalesce(t.h, sha256('')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)""")
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def word_bpe() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


@query()
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), word_bpe(), limit=2048)


@query()
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), word_bpe(), capacity=4096, end_id=1)


@query()
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


@query()
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents"))


@query()
def op8_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_scores(table(spark, sf_dir, "documents")).drop("perplexity")


@query()
def op2_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_outliers(table(spark, sf_dir, "documents"))


TRICKY = "\\### Assistant: </turn> ok"


@query(r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') AS x FROM c),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS t,
             coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS l,
             sum(length(role) + length(x) + 14) AS formatted_chars FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(t) AS turns_sha256, CAST(len(l) AS BIGINT) AS loss_chars, sha256(l) AS loss_sha256,
       CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g""")
def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], rows.schema)
    return digests(format_conversations(rows.unionByName(tricky)))


@query(r"""
WITH c AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w,
                  xor(4294967295, list_reduce([ord(x) FOR x IN string_split(CAST(doc_id AS VARCHAR), '')],
                      lambda h, b: list_reduce(range(8), lambda r, i: xor(r >> 1, 3988292384 * (r & 1)), xor(h, b)), 4294967295)) AS h FROM documents),
g AS (SELECT doc_id, w, len(w) AS n, h, h // 10 AS g FROM c),
a AS (SELECT *, CASE WHEN n > 0 AND h % 10 = 0 THEN g % n END AS a, CASE WHEN n > 0 AND h % 10 = 0 THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM g),
d AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE [w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1] FOR i IN range(n)] END AS w FROM a),
s AS (SELECT doc_id, i, w[i + 1:i + 16] AS g FROM (SELECT doc_id, w, unnest(range(n - 15)) AS i FROM d WHERE n >= 24)),
h AS (SELECT doc_id, i, hash(g) AS k, g FROM s),
m AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM h x JOIN h y ON x.doc_id = y.doc_id AND x.k = y.k AND x.g = y.g AND x.i < y.i),
e AS (SELECT doc_id, q, min(i) AS start, max(i) + 16 + q - min(i) AS length
      FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS v FROM m) GROUP BY doc_id, q, v),
r AS (SELECT doc_id, start, length, min(q) AS period FROM e WHERE length >= greatest(24, 3 * q) GROUP BY doc_id, start, length),
o AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS t FROM r GROUP BY doc_id),
b AS (SELECT x.* FROM r x WHERE NOT EXISTS (SELECT 1 FROM r y WHERE y.doc_id = x.doc_id AND (y.length * x.period > x.length * y.period OR
      (y.length * x.period = x.length * y.period AND (y.start, y.period) < (x.start, x.period))))),
z AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
k AS (SELECT p.doc_id, string_agg(x, ' ' ORDER BY p.i) AS t FROM (SELECT doc_id, unnest(w) AS x, unnest(range(n)) AS i FROM d) p
      ANTI JOIN z ON z.doc_id = p.doc_id AND z.i = p.i GROUP BY p.doc_id)
SELECT d.doc_id, coalesce(o.n_runs, 0) AS n_runs, b.start, b.length, b.period, 1000 * b.length // b.period AS exponent_milli,
       sha256(coalesce(o.t, '')) AS runs_sha256, sha256(coalesce(k.t, '')) AS collapsed_sha256
FROM d LEFT JOIN o USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN k USING (doc_id)""")
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), min_words=24, powers=3, rule=respelled, spans=False)


@query()
def op11_tier_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tier_pack(table(spark, sf_dir, "documents"), word_bpe(), end_id=2, with_ids=False)


@query(r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(coalesce(t, ''), '[.,;:!?\x0A-\x0D]')) AS t FROM d),
w AS (SELECT lang, regexp_extract_all(t, '[^\x20\x09]+') AS w FROM p),
c AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS g FROM w, (SELECT unnest(range(1, 5)) AS k)),
f AS (SELECT lang, k, g, count(*) AS f FROM g GROUP BY ALL),
b AS (SELECT lang, k, g, f, string_split(g, ' ') AS w FROM f WHERE k > 1 AND f >= 30),
x AS (SELECT lang, k, g, f, unnest(range(1, k)) AS cut, w FROM b),
y AS (SELECT x.lang, x.k, x.g, x.f AS a, x.cut, l.f AS l, r.f AS r, CAST(2000000 * CAST(x.f AS HUGEINT) // (l.f + r.f) AS BIGINT) AS score
      FROM x JOIN f l ON l.lang = x.lang AND l.g = array_to_string(w[1:cut], ' ') JOIN f r ON r.lang = x.lang AND r.g = array_to_string(w[cut + 1:], ' ')),
s AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
i AS (SELECT lang, f, g, unnest(flatten([[array_to_string(w[j:j + m - 1], ' ') FOR j IN range(1, k - m + 2)] FOR m IN range(2, k)])) AS part FROM b WHERE k > 2),
m AS (SELECT lang, part AS g, max(f) AS longer FROM i GROUP BY ALL),
t AS (SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, encode(g)) AS rank FROM s LEFT JOIN m USING (lang, g)
      WHERE m.longer IS NULL OR 100 * longer < 80 * a)
SELECT lang, rank, g AS phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM t JOIN c USING (lang) WHERE rank <= 2000""")
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"), least=30, top=2000, covered=80)
