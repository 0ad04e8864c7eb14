"""Expressions over small in-row lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import apply_sql, blank_to_null, first_of_each, first_of_each_sql, keep_nonblank, let, sql_text
from .text import clean_sql

LIST_SEPARATORS = r"(?i)\s*(?:[,;/|]|\band\b|&)\s*"
EDGE_NOISE = r"^[ .,\-|/]+|[ .,\-|/]+$"


def dedupe(items: Column) -> Column:
    """Ordered, case-insensitive de-duplication: first spelling wins, blanks go."""
    present = F.filter(items, lambda x: F.trim(F.coalesce(x, F.lit(""))) != "")
    return first_of_each(present, "lower(replace(trim(x), 'ß', 'ss'))")


def split_list(raw: Column) -> Column:
    """``Fiction, Fantasy & Young Adult`` to a clean, de-duplicated list."""
    return name_list(F.split(F.coalesce(raw, F.lit("")), LIST_SEPARATORS))


def name_list(items: Column) -> Column:
    """The same clean-up for values that are already a list (elements are not split)."""
    trimmed = f"regexp_replace({clean_sql('y')}, {sql_text(EDGE_NOISE)}, '')"
    kept = f"filter(transform(filter(v, y -> y IS NOT NULL), y -> {trimmed}), y -> length(y) BETWEEN 1 AND 120)"
    deduped = first_of_each_sql("w", "lower(replace(trim(x), 'ß', 'ss'))")
    return apply_sql(items, f"transform(array({kept}), w -> {deduped})[0]")


def union_genres(*lists: Column) -> Column:
    """Union of genre lists: trimmed, case-insensitive, first spelling wins."""
    blank = F.array().cast("array<string>")
    merged = F.concat(*[F.coalesce(x, blank) for x in lists])
    return dedupe(keep_nonblank(F.transform(merged, lambda x: F.trim(x))))


def genre_text(genres: Column) -> Column:
    return F.nullif(F.array_join(genres, ", "), F.lit(""))


def first_label(pairs: Column, labels: list[str]) -> Column:
    """First non-empty value under any of the labels; keys are lower case already."""
    return F.coalesce(*[blank_to_null(F.try_element_at(pairs, F.lit(label))) for label in labels])


def first_wins_map(pairs: Column) -> Column:
    """``array<struct<k,v>>`` to a map in which the first value of a key stays."""
    return F.map_from_entries(first_of_each(pairs, "x.k"))


def colon_pairs(lines: Column, longest_label: int | None = None,
                deny: list[str] | None = None) -> Column:
    """``Label: value`` lines to a map; the value may stand on the next line."""
    empty = F.array().cast("array<struct<k:string,v:string>>")

    def pair(line: Column, index: Column, all_lines: Column) -> Column:
        at = F.instr(line, ":")
        key = F.lower(F.trim(F.substring(line, F.lit(1), at - 1)))
        inline = F.trim(F.substring(line, at + 1, F.length(line)))
        following = F.coalesce(F.get(all_lines, index + 1), F.lit(""))
        value = F.when(inline != "", inline).otherwise(following)
        good = (at > 0) & (key != "") & (value != "")
        if longest_label is not None:
            good = good & (at - 1 <= longest_label)
        for word in deny or []:
            good = good & ~F.contains(key, F.lit(word)) & ~F.contains(F.lower(value), F.lit(word))
        return F.when(good, F.struct(key.alias("k"), value.alias("v")))

    def build(rows: Column) -> Column:
        found = F.filter(F.transform(rows, lambda x, i: pair(x, i, rows)), lambda p: p.isNotNull())
        return first_wins_map(F.coalesce(found, empty))

    return let(keep_nonblank(F.transform(lines, lambda x: F.trim(x))), build)
