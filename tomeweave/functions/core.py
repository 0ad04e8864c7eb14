"""Small building blocks shared by the column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a bound variable."""
    return F.try_element_at(F.transform(F.array(value), body), F.lit(1))


def literal_map(entries: dict[str, str]) -> Column:
    """A constant string map; Catalyst folds it to one literal."""
    packed = "\x02".join(f"{k}\x01{v}" for k, v in entries.items())
    return F.str_to_map(F.lit(packed), F.lit("\x02"), F.lit("\x01"))


def lookup(entries: dict[str, str], key: Column) -> Column:
    return F.try_element_at(literal_map(entries), key)


def literal_array(values: list[str]) -> Column:
    return F.split(F.lit("\x01".join(values)), "\x01") if values else F.array().cast("array<string>")


def blank_to_null(value: Column) -> Column:
    """Null for ''; ``nullif`` would evaluate a costly value twice wherever it stands in a branch or a lambda."""
    return let(value, lambda v: F.when(v != "", v))


def some(items: Column) -> Column:
    """Null for an empty list."""
    return let(items, lambda found: F.when(F.size(found) > 0, found))


def keep_nonblank(items: Column) -> Column:
    return F.filter(items, lambda x: F.coalesce(x, F.lit("")) != "")


def empty_strings() -> Column:
    return F.array().cast("array<string>")


def alternation(markers: list[str]) -> str:
    """A regular expression that matches any of the plain-text markers."""
    special = set("\\.[]{}()*+-?^$|")
    return "|".join("".join("\\" + c if c in special else c for c in m) for m in markers)


def sql_text(value: str) -> str:
    """A Python string as a SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def apply_sql(value: Column, body: str) -> Column:
    """Evaluate SQL text over ``value`` bound once as ``v``.

    Long expressions are written as SQL text: one parse instead of hundreds of column calls,
    and, unlike a function, usable inside lambdas.
    """
    return F.try_element_at(F.call_function("transform", F.array(value), F.expr(f"v -> {body}")), F.lit(1))


def first_of_each_sql(items: str, key: str) -> str:
    """SQL text: elements ``x`` of ``items`` whose ``key`` has not come before, in order.

    Sorts (key, index) pairs, so long lists stay cheap.
    """
    tagged = f"sort_array(transform({items}, (x, i) -> named_struct('k', {key}, 'i', i)))"
    return (f"transform(array({tagged}), r -> transform(sort_array(transform("
            f"filter(r, (e, j) -> j = 0 OR get(r, j - 1).k <> e.k), e -> e.i)), n -> get({items}, n)))[0]")


def first_of_each(items: Column, key: str) -> Column:
    return apply_sql(items, first_of_each_sql("v", key))


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are evaluated exactly once per row.

    A plain projection may be copied into every later filter and expression that uses it; the
    one-row generator here stops that, at no cost but the row it wraps.
    """
    packed = F.struct(*[c.alias(name) for name, c in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(packed)))
