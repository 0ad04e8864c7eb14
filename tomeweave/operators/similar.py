"""Wanted books against a whole catalogue that shares no identifier: an exact similarity join of titles.

``best candidates`` of a book are those ``matching.accepted`` would keep of the cross product.  No
pair of rows is formed for that; a pair meets only where a token of both says it may score:

* *Text ratio.*  A ratio of ``f`` or more matches ``M >= f (la + lb) / 2`` characters, in at most
  ``1 + la + lb - 2M`` blocks, so at least ``3M - la - lb - 1`` pairs of neighbouring letters are shared,
  counted with repeats.  Letter pairs are ordered from the rarest; with ``s`` shared ones needed,
  the first ``n - s + 1`` of the ``n`` of each title must meet (a prefix filter).  For totals so
  short that none need be shared, single letters are tokens.  Both the whole folded title and its
  main part are indexed.
* *Containment.*  The rarest letter pair of the contained title stands in the other.
* *Equality* of titles or main parts is a token of its own.

A token that more than ``block`` catalogue rows have is dealt into blocks of them, and the wanted
rows of that token go to each block, so no task holds a frequent token whole.  Pairs that meet
are cut down by the authors, the lengths and the shared letters, all exact, before the ratio.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import BEST_FLOOR
from ..functions.core import compute_once
from ..functions.text import fold, main_part, surname_of
from .matching import accepted

#: What a folded text may hold.
LETTERS = " 0123456789abcdefghijklmnopqrstuvwxyz"
BLOCK = 20_000


def _sql(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def shared_pairs_needed(length: str, floor: float) -> str:
    """SQL: letter pairs that a text of this length shares at least with any partner of that ratio."""
    least_partner = f"ceil({length} * {floor / (2 - floor)!r} - 1e-9)"
    return f"CAST(greatest(1, ceil({1.5 * floor - 1!r} * ({length} + {least_partner}) - 1 - 1e-9)) AS INT)"


def longest_without_pairs(floor: float) -> int:
    """The longest text that may reach the floor with a different one and share no letter pair."""
    longest = 0
    for total in range(2, 4000):
        matched = math.ceil(floor * total / 2 - 1e-9)
        if 3 * matched - total - 1 >= 1:
            if (1.5 * floor - 1) * total - 1 >= 1:
                break
            continue
        sides = [a for a in range(1, total) if matched <= min(a, total - a) and not (2 * a == total and matched == a)]
        longest = max([longest, *sides])
    return longest


def _pairs_sql(v: str) -> str:
    return f"IF(length({v}) < 2, CAST(array() AS ARRAY<STRING>), transform(sequence(1, length({v}) - 1), i -> substring({v}, i, 2)))"


def _titles(rows: DataFrame, key: str) -> DataFrame:
    """One row per row of a side: folded texts and what the author test reads."""
    blank = F.array().cast("array<string>")
    names = F.filter(F.transform(F.coalesce("authors", blank), fold), lambda n: n != "")
    ready = compute_once(rows.select(F.col(key).alias("_id"), "title", "authors"),
                         _full=fold(F.col("title")), _main=main_part(F.col("title")), _names=names)
    ready = ready.where("_full <> ''")
    return ready.withColumns({
        "_keys": F.transform("_names", lambda n: F.when(surname_of(n) != "", surname_of(n)).otherwise(n)),
        "_joined": F.array_join("_names", " ")})


def _letter_pair_ranks(sides: list[DataFrame]) -> str:
    """A text with one character per letter pair; a greater one is more frequent.  At most ``37 * 37`` counts are collected."""
    grams = sides[0].selectExpr(f"explode({_pairs_sql('_full')}) AS gram")
    for side in sides[1:]:
        grams = grams.unionAll(side.selectExpr(f"explode({_pairs_sql('_full')}) AS gram"))
    counts = {r["gram"]: r["n"] for r in grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()}
    every = [a + b for a in LETTERS for b in LETTERS]
    place = {g: i for i, g in enumerate(sorted(every, key=lambda g: (counts.get(g, 0), g)))}
    return "".join(chr(0x4E00 + place[g]) for g in every)


def _rank_sql(gram: str, ranks: str) -> str:
    at = lambda i: f"locate(substring({gram}, {i}, 1), {_sql(LETTERS)})"
    return f"substring({_sql(ranks)}, ({at(1)} - 1) * {len(LETTERS)} + {at(2)}, 1)"


def _ordered_sql(v: str, ranks: str) -> str:
    """Letter pairs from the rarest, each numbered among its equals."""
    return (f"transform(array(array_sort({_pairs_sql(v)})), g -> array_sort(transform(g, (x, i) -> "
            f"concat({_rank_sql('x', ranks)}, x, CAST(i - array_position(g, x) + 1 AS STRING)))))[0]")


def _ratio_tokens(v: str, kind: str, ranks: str, floor: float, short: int) -> str:
    prefix = f"slice({_ordered_sql(v, ranks)}, 1, greatest(length({v}) - {shared_pairs_needed(f'length({v})', floor)}, 0))"
    letters = f"IF(length({v}) <= {short}, array_distinct(split({v}, '')), CAST(array() AS ARRAY<STRING>))"
    return (f"concat(transform({prefix}, t -> concat('{kind}', t)), transform({letters}, c -> concat('{kind}.', c)), array(concat('{kind}=', {v})))")


def _contained_sql(ranks: str) -> str:
    """The token by which a contained title finds its containers."""
    return f"IF(length(_full) < 2, _full, substring({_ordered_sql('_full', ranks)}[0], 2, 2))"


def _tokens(side: DataFrame, ranks: str, floor: float, short: int, contained: str, container: str, keys: DataFrame) -> DataFrame:
    """Token rows of one side.  ``keys`` are the tokens by which the other side is contained, at most one per letter or letter pair."""
    kept = ["_id", "_keys", "_joined", F.length("_full").alias("_lf"), F.length("_main").alias("_lm")]
    ratio = f"concat({_ratio_tokens('_full', 'f', ranks, floor, short)}, {_ratio_tokens('_main', 'm', ranks, floor, short)}, array(concat('{contained}', {_contained_sql(ranks)})))"
    rows = side.select(*kept, F.explode(F.expr(ratio)).alias("token"))
    holds = side.select(*kept, F.explode(F.expr(f"array_distinct(concat({_pairs_sql('_full')}, split(_full, '')))")).alias("gram"))
    holds = holds.join(F.broadcast(keys), "gram", "left_semi").select(*[c for c in rows.columns if c != "token"], F.concat(F.lit(container), "gram").alias("token"))
    return rows.unionByName(holds)


def _shared_letters(a: Column, b: Column) -> Column:
    """Letters two texts have in common, with repeats: no ratio matches more."""
    count = lambda v, c: F.length(v) - F.length(F.replace(v, c))
    each = F.transform(F.array_distinct(F.split(a, "")), lambda c: F.least(count(a, c), count(b, c)))
    return F.aggregate(each, F.lit(0), lambda s, n: s + n)


def _reach(a: Column, b: Column) -> Column:
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * _shared_letters(a, b) / total)


def candidate_pairs(wanted: DataFrame, catalogue: DataFrame, floor: float = BEST_FLOOR, require_author: bool = True, block: int = BLOCK) -> DataFrame:
    """``(wanted_id, candidate_id)``: a superset of all pairs that score ``floor`` or more, each once."""
    if not 2 / 3 < floor <= 1:
        raise ValueError("the letter-pair filter holds for floors above two thirds")
    left, right = _titles(wanted, "wanted_id"), _titles(catalogue, "candidate_id")
    ranks, short = _letter_pair_ranks([left, right]), longest_without_pairs(floor)
    key = F.expr(_contained_sql(ranks)).alias("gram")
    left_tokens = _tokens(left, ranks, floor, short, "<", ">", right.select(key).distinct())
    right_tokens = _tokens(right, ranks, floor, short, ">", "<", left.select(key).distinct())
    blocks = (right_tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
              .select("token", F.ceil(F.col("n") / block).cast("int").alias("_blocks")))
    dealt = (right_tokens.join(blocks, "token", "left")
             .withColumn("_block", F.coalesce(F.pmod(F.xxhash64("_id"), F.col("_blocks")).cast("int"), F.lit(0))).drop("_blocks"))
    sent = (left_tokens.join(blocks, "token", "left")
            .withColumn("_block", F.explode(F.sequence(F.lit(0), F.coalesce("_blocks", F.lit(1)) - 1))).drop("_blocks"))
    r = dealt.select("token", "_block", *[F.col(c).alias(f"r{c}") for c in ("_id", "_keys", "_joined", "_lf", "_lm")])
    met = sent.join(r, ["token", "_block"])
    kind = F.substring("token", 1, 1)
    near = lambda a, b: 2.0 * F.least(a, b) >= floor * (F.col(a) + F.col(b)) - 1e-9
    met = met.where(F.when(kind == "f", near("_lf", "r_lf")).when(kind == "m", near("_lm", "r_lm")).otherwise(F.lit(True)))
    if require_author:
        met = met.where((F.size("_keys") == 0) | (F.col("r_joined") == "") | F.exists("_keys", lambda k: F.contains(F.col("r_joined"), k)))
    return met.select(F.col("_id").alias("wanted_id"), F.col("r_id").alias("candidate_id")).distinct()


def similar(wanted: DataFrame, catalogue: DataFrame, floor: float = BEST_FLOOR, require_author: bool = True, block: int = BLOCK, **rules) -> DataFrame:
    """All pairs of ``wanted(wanted_id, title, authors)`` and ``catalogue(candidate_id, title, authors)`` that ``accepted`` keeps.

    Adds ``score``.  Ids are unique on each side; titles that fold to nothing match nothing.
    """
    pairs = candidate_pairs(wanted, catalogue, floor, require_author, block)
    left = wanted.select("wanted_id", F.col("title").alias("wanted_title"), F.col("authors").alias("wanted_authors"))
    pairs = pairs.join(left, "wanted_id").join(catalogue.select("candidate_id", "title", "authors"), "candidate_id")
    pairs = compute_once(pairs, _a=fold(F.col("wanted_title")), _b=fold(F.col("title")), _am=main_part(F.col("wanted_title")), _bm=main_part(F.col("title")))
    a, b, am, bm = (F.col(c) for c in ("_a", "_b", "_am", "_bm"))
    may = F.contains(a, b) | F.contains(b, a) | (_reach(a, b) >= floor - 1e-9) | (_reach(am, bm) >= floor - 1e-9)
    return accepted(pairs.where(may).drop("_a", "_b", "_am", "_bm"), floor, require_author, **rules)
