"""Quality rules by robust multivariate outliers, in DataFrame functions alone.

Each text gives whole-text statistics; transformed, they are its vector.  Per language and source
the minimum-covariance-determinant estimate is sought by concentration steps: from a start, take
the share ``H`` of rows with the least distance, estimate centre and covariance from them, repeat.
Two starts run side by side (coordinate medians with median deviations, and Spearman-like tanh
scores), and the one with the smaller determinant is kept.  Rows beyond a chi-square quantile of
the squared Mahalanobis distance are rejected.

A component that does not vary among a cell's rows has a floor instead of its spread: a third of
what one mark, doubled line or repeated window makes in a text of median length, and for lengths a
hundredth of the median deviation over all rows.

A step needs one quantile and the first two moments per group: both combine before the shuffle,
so a group of any size is never together in a task.  Distances come from a Cholesky factor
written out as column expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeweave.llm._store import Scratch

SPACE = r"[\x20\x09-\x0D]"
STATISTICS = ("v_length", "v_word", "v_symbols", "v_lines", "v_repeats")
#: The square of what one event makes in a text of one word; the share of that, and of a spread over all rows, that counts as none.
EVENTS = {"v_symbols": 1, "v_lines": 10, "v_repeats": 10}
STEP, DEGENERATE, ROUNDING = 1 / 3, 0.01, 1e-6
H, STEPS, LEAST_ROWS, QUANTILE = 0.75, 4, 40, 0.9999


def chi_square(p: int, q: float) -> float:
    """Quantile of the chi-square distribution (Wilson and Hilferty)."""
    from statistics import NormalDist
    return p * (1 - 2 / (9 * p) + NormalDist().inv_cdf(q) * math.sqrt(2 / (9 * p))) ** 3


def _bound(value: Column, body: str) -> Column:
    """Evaluate SQL text over ``value`` bound once as ``v``."""
    return F.get(F.call_function("transform", F.array(value), F.expr(f"v -> {body}")), 0)


def statistics(text: Column) -> Column:
    """Base statistics of a text as a struct; a null text has none of anything."""
    text = F.coalesce(text, F.lit(""))
    words = _bound(F.split(F.regexp_replace(text, f"^{SPACE}+", ""), f"{SPACE}+"), "filter(v, x -> x <> '')")
    hashed = "transform(v, x -> xxhash64(x))"
    grams = ("CASE WHEN size(v) < 5 THEN CAST(array() AS array<bigint>) ELSE transform(sequence(0, size(v) - 5), "
             "i -> xxhash64(v[i], v[i + 1], v[i + 2], v[i + 3], v[i + 4])) END")
    # places of the windows that stand twice, in order; only for the few texts that have any
    twice = ("CASE WHEN size(array_distinct(v)) = size(v) THEN 0 ELSE transform(array(array_sort(transform(v, (x, i) -> named_struct('x', x, 'i', i)))), "
             "s -> transform(array(array_sort(transform(filter(s, (e, j) -> (j > 0 AND get(s, j - 1).x = e.x) OR get(s, j + 1).x = e.x), e -> e.i))), "
             "p -> aggregate(transform(p, (a, j) -> least(5, coalesce(get(p, j + 1) - a, 5))), 0, (n, x) -> n + x))[0])[0] END")
    lines = F.split(text, "\n")
    full = _bound(lines, r"filter(v, x -> x RLIKE '[^\\x20\\x09-\\x0D]')")
    return F.struct(
        F.size(words).cast("bigint").alias("n_words"),
        F.length(F.array_join(words, "")).cast("bigint").alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        _bound(full, "CAST(size(v) - size(array_distinct(v)) AS bigint)").alias("n_dup_lines"),
        _bound(_bound(_bound(words, hashed), grams), twice).cast("bigint").alias("n_repeat_words"))


def _vector() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return {"v_length": F.log(F.lit(1.0) + F.col("n_words")), "v_word": F.log(F.lit(0.5) + F.col("word_chars") / n),
            "v_symbols": F.sqrt(F.col("n_symbols") / n), "v_lines": F.sqrt(F.col("n_dup_lines") / n * 10),
            "v_repeats": F.sqrt(F.col("n_repeat_words") / n)}


def _names() -> list[str]:
    return list(STATISTICS)


def _moments() -> list[Column]:
    names = _names()
    means = [F.avg(c).alias(f"m_{c}") for c in names]
    products = [F.covar_pop(a, b).alias(f"c_{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if j <= i]
    return means + products


def floors(rows: DataFrame) -> dict[str, float]:
    """The least spread of each component, from all rows; a few numbers."""
    lengths = [c for c in _names() if c not in EVENTS]
    middle = rows.agg(*[F.percentile_approx(c, 0.5, 1000).alias(c) for c in lengths]).first()
    away = rows.agg(*[F.percentile_approx(F.abs(F.col(c) - F.lit(middle[c] or 0.0)), 0.5, 1000).alias(c) for c in lengths]).first()
    words = max(1.0, math.expm1(middle["v_length"] or 0.0))
    return {**{c: max(ROUNDING, DEGENERATE * 1.4826 * (away[c] or 0.0)) for c in lengths}, **{c: STEP * math.sqrt(n / words) for c, n in EVENTS.items()}}


def _factor(df: DataFrame, least: dict[str, float]) -> DataFrame:
    """Cholesky factor ``l_i_j`` of the covariance and the logarithm of its determinant.

    A component that varies less than its floor counts as if it varied by that.
    """
    names = _names()
    for i, name in enumerate(names):
        for j in range(i + 1):
            rest = F.col(f"c_{i}_{j}")
            for k in range(j):
                rest = rest - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            if i == j:
                df = df.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(rest, F.lit(least[name] ** 2))))
            else:
                df = df.withColumn(f"l_{i}_{j}", rest / F.col(f"l_{j}_{j}"))
    return df.withColumn("log_det", sum((F.log(F.col(f"l_{i}_{i}")) for i in range(len(names))), F.lit(0.0)))


def _distance() -> Column:
    """Squared Mahalanobis distance by forward substitution, over ``m_*`` and ``l_*``."""
    solved: list[Column] = []
    for i, name in enumerate(_names()):
        rest = F.col(name) - F.col(f"m_{name}")
        for k in range(i):
            rest = rest - F.col(f"l_{i}_{k}") * solved[k]
        solved.append(rest / F.col(f"l_{i}_{i}"))
    return sum((z * z for z in solved), F.lit(0.0))


def _estimates(df: DataFrame, keys: list[str], least: dict[str, float]) -> DataFrame:
    return _factor(df.groupBy(*keys).agg(*_moments()), least)


def minimum_covariance(rows: DataFrame, scratch: Scratch, group: str = "cell", share: float = H, steps: int = STEPS) -> DataFrame:
    """Estimate per group: centre ``m_*``, factor ``l_*``, ``log_det``, and ``scale`` of the distances."""
    names, least = _names(), floors(rows)
    medians = scratch.table(rows.groupBy(group).agg(*[F.percentile_approx(c, 0.5, 1000).alias(f"d_{c}") for c in names]), "medians")
    spread = scratch.table(rows.join(medians, group).groupBy(group).agg(
        *[F.percentile_approx(F.abs(F.col(c) - F.col(f"d_{c}")), 0.5, 1000).alias(f"s_{c}") for c in names]).join(medians, group), "spread")
    robust = {c: (F.col(c) - F.col(f"d_{c}")) / F.greatest(F.col(f"s_{c}") * 1.4826, F.lit(least[c])) for c in names}
    first = sum((z * z for z in robust.values()), F.lit(0.0))
    # the second start orders rows by tanh scores, which no far row can stretch
    second = F.greatest(*[F.abs(F.tanh(z)) for z in robust.values()])
    base = rows.join(spread, group).select(group, *names, F.explode(F.array(
        F.struct(F.lit(1).alias("start"), first.alias("d")), F.struct(F.lit(2).alias("start"), second.alias("d")))).alias("o")).select(group, *names, "o.*")
    keys = [group, "start"]
    near, estimate = base, None
    for _ in range(steps):
        limits = scratch.table(near.groupBy(*keys).agg(F.percentile_approx("d", share, 1000).alias("limit")), "limits")
        estimate = scratch.table(_estimates(near.join(limits, keys).where(F.col("d") <= F.col("limit")), keys, least), "estimate")
        near = rows.join(estimate, group).select(group, "start", *names, _distance().alias("d"))
    best = estimate.groupBy(group).agg(F.min_by(F.struct(*[c for c in estimate.columns if c != group]), F.struct("log_det", "start")).alias("b")).select(group, "b.*")
    best = scratch.table(best, "best")
    # the chosen rows are the inner ones: distances are scaled so that their median is the expected one
    middle = rows.join(best, group).groupBy(group).agg((F.percentile_approx(_distance(), 0.5, 1000) / F.lit(chi_square(len(names), 0.5))).alias("scale"))
    return scratch.table(best.join(middle, group), "fitted")


def quality_outliers(docs: DataFrame, text: str = "text", id_col: str = "doc_id", lang: str = "lang", source: str = "source",
                     quantile: float = QUANTILE, least_rows: int = LEAST_ROWS, scratch: Scratch | None = None) -> DataFrame:
    """Base statistics, ``base_failed``, ``distance`` and ``kept`` of every whole text.

    Rows that fail the base rules (fewer than 10 words, or over a fifth of them in repeated
    windows) are no part of any estimate and are rejected.  Cells of fewer than ``least_rows``
    other rows are pooled by language, and those still too small all together; if that is too
    small as well, its rows are kept, with a null ``distance``.

    * Null and empty texts have no words: all statistics are 0, and they fail the base rules.
    * A null language or source is a value like any other.
    * Repeated rows count as often as they stand; ids may be null or repeated.
    * Other columns of ``docs`` are left out, so their names cannot clash.
    * An empty table gives an empty table.
    """
    scratch = scratch or Scratch(docs.sparkSession, "robust-outliers")
    base = docs.select(F.col(id_col).alias("id"), F.struct(F.col(lang).cast("string").alias("a"), F.col(source).cast("string").alias("b")).alias("key"),
                       statistics(F.col(text)).alias("s")).select("id", "key", "s.*")
    base = base.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    base = scratch.table(base.withColumns(_vector()), "statistics")
    sizes = base.where("not base_failed").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    pooled = (sizes.withColumn("big", F.col("n") >= least_rows)
              .withColumn("rest", F.sum(F.when(~F.col("big"), F.col("n")).otherwise(0)).over(_by(F.col("key.a"))))
              .select("key", "n", F.when(F.col("big"), F.to_json(F.array("key.a", "key.b")))
                      .when(F.col("rest") >= least_rows, F.to_json(F.array("key.a"))).otherwise(F.lit("[]")).alias("cell")))
    pooled = pooled.withColumn("total", F.sum("n").over(_by(F.col("cell")))).where(F.col("total") >= least_rows)
    pooled = scratch.table(pooled.select("key", "cell"), "cells")
    # stored, so that every aggregate by cell combines before its shuffle
    rows = scratch.table(base.where("not base_failed").join(pooled, base["key"].eqNullSafe(pooled["key"])).select("cell", *_names()), "rows")
    fitted = minimum_covariance(rows, scratch)
    cells = scratch.table(pooled.join(fitted, "cell"), "models").withColumnRenamed("key", "model_key")
    judged = base.join(cells, base["key"].eqNullSafe(cells["model_key"]), "left")
    far = F.col("distance") > F.lit(chi_square(len(STATISTICS), quantile))
    return (judged.withColumn("distance", F.when(~F.col("base_failed"), _distance() / F.greatest("scale", F.lit(1.0))))
            .select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance",
                    (~F.col("base_failed") & ~F.coalesce(far, F.lit(False))).alias("kept")))


def _by(key: Column):
    from pyspark.sql import Window
    return Window.partitionBy(key)
