"""Identifier expressions over a *normalised* identifier column.

Every function takes a column that already went through :func:`normalize`, so that a job
computes the two regular expressions once per row (see ``operators.ingest``).  Digits are
read with ``ascii`` so no cast can fail under ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed import ISBN_LABEL_PATTERN, ISBN_NOISE_PATTERN
from .core import let


def normalize(raw: Column) -> Column:
    bare = F.regexp_replace(F.coalesce(raw, F.lit("")), ISBN_LABEL_PATTERN, "")
    return F.upper(F.regexp_replace(bare, ISBN_NOISE_PATTERN, ""))


def _weighted(code: Column | str, weights: list[int]) -> Column:
    """Weighted digit sum.  SQL text unrolls into generated code; a column (which may be a
    lambda variable) folds over the positions."""
    if isinstance(code, str):
        return F.expr(" + ".join(f"(ascii(substring({code}, {i + 1}, 1)) - 48) * {w}" for i, w in enumerate(weights)))
    packed = F.split(F.lit(",".join(map(str, weights))), ",")
    return F.aggregate(packed, F.struct(
        F.lit(1).alias("at"), F.lit(0).alias("sum")), lambda acc, w: F.struct(
            (acc["at"] + 1).alias("at"),
            (acc["sum"] + (F.ascii(F.substring(code, acc["at"], F.lit(1))) - 48) * w.cast("int")).alias("sum")),
        lambda acc: acc["sum"])


def _col(code: Column | str) -> Column:
    return F.expr(code) if isinstance(code, str) else code


def check10(code: Column | str) -> Column:
    """Check character of an ISBN-10 body, from the first nine characters of ``code``."""
    rest = F.pmod(F.lit(0) - _weighted(code, list(range(10, 1, -1))), F.lit(11))
    return F.replace(rest.cast("string"), F.lit("10"), F.lit("X"))


def check13(code: Column | str) -> Column:
    """Check digit from the first twelve characters of ``code``."""
    return F.pmod(F.lit(0) - _weighted(code, [1, 3] * 6), F.lit(10)).cast("string")


def looks_13(code: Column) -> Column:
    return code.rlike("^97[89][0-9]{10}$")


def looks_10(code: Column) -> Column:
    return code.rlike("^[0-9]{9}[0-9X]$")


def isbn13_of(code: Column | str) -> Column:
    """The ISBN-13 of a normalised identifier, null when it is not valid."""
    if isinstance(code, str):
        stem = f"concat('978', substring({code}, 1, 9))"
    else:
        stem = F.concat(F.lit("978"), F.substring(code, 1, 9))
    text = _col(code)
    return (F.when(looks_13(text) & (check13(code) == F.substring(text, 13, 1)), text)
            .when(looks_10(text) & (check10(code) == F.substring(text, 10, 1)),
                  F.concat(_col(stem), check13(stem))))


def isbn10_of(isbn13: Column | str) -> Column:
    """The ISBN-10 of a valid ISBN-13; only the 978 range has one."""
    body = f"substring({isbn13}, 4, 9)" if isinstance(isbn13, str) else F.substring(isbn13, 4, 9)
    return F.when(_col(isbn13).startswith("978"), F.concat(_col(body), check10(body)))


def quoted(value: Column) -> Column:
    """Text in quotes for a message: double quotes when it holds a single quote."""
    safe = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    double = F.contains(value, F.lit("'")) & ~F.contains(value, F.lit('"'))
    return (F.when(double, F.concat(F.lit('"'), safe, F.lit('"')))
            .otherwise(F.concat(F.lit("'"), F.replace(safe, F.lit("'"), F.lit("\\'")), F.lit("'"))))


def reason_of(raw: Column, code: Column | str) -> Column:
    """Why the identifier is refused, null when it is valid."""
    text, given = _col(code), quoted(F.coalesce(raw, F.lit("")))
    lead = F.concat(given, F.lit(" -> "), quoted(text))
    size = F.length(text)

    def tail(expected: Column, at: int) -> Column:
        return F.when(expected != F.substring(text, at, 1),
                      F.concat(F.lit(": check digit should be '"), expected, F.lit("'")))

    ending = (F.when((size == 13) & ~looks_13(text), F.lit(": 13 digits must be numeric and start 978/979"))
              .when(size == 13, tail(check13(code), 13))
              .when((size == 10) & ~looks_10(text), F.lit(": an ISBN-10 is 9 digits then a digit or 'X'"))
              .when(size == 10, tail(check10(code), 10))
              .otherwise(F.concat(F.lit(" is "), size.cast("string"), F.lit(" characters; an ISBN is 10 or 13"))))
    return F.when(text == "", F.concat(F.lit("no ISBN found in "), given)).otherwise(F.concat(lead, ending))


def to_isbn13(raw: Column) -> Column:
    """Raw text to ISBN-13 in one expression, for use inside lambdas."""
    return let(normalize(raw), isbn13_of)


def to_isbn10(raw: Column) -> Column:
    return let(to_isbn13(raw), isbn10_of)


def is_valid(raw: Column) -> Column:
    return to_isbn13(raw).isNotNull()


def header_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "")


def uuid_or_blank(value: Column) -> Column:
    """A review id must be a UUID; anything else is no id."""
    shape = "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
    trimmed = F.trim(F.coalesce(value, F.lit("")))
    return F.when(trimmed.rlike(shape), trimmed).otherwise(F.lit(""))


def asin_of_url(url: Column) -> Column:
    """Product id in a product URL, '' when there is none."""
    return F.upper(F.regexp_extract(F.coalesce(url, F.lit("")),
                                    r"(?i)/(?:dp|gp/product)/([A-Z0-9]{10})", 1))


def asin_of_row(row_id: Column, impression: Column, href: Column) -> Column:
    """Product id of a search row: its own id, an impression attribute, then its link."""
    lead = "product-list-item-"
    own = F.when(row_id.startswith(lead), F.substring(row_id, len(lead) + 1, 1000))
    linked = F.regexp_extract(F.coalesce(href, F.lit("")),
                              r"(?i)/pd/(?:[^/]+/)?([A-Z0-9]{10})(?:[/?#]|$)", 1)
    return F.coalesce(own, F.nullif(F.trim(impression), F.lit("")), linked)


def safe_segment(value: Column, fallback: str = "unknown") -> Column:
    """One safe path segment: no separators, no dot-only names, 120 characters at most."""
    dashed = F.regexp_replace(F.coalesce(value, F.lit("")), "[^A-Za-z0-9._ -]+", "-")
    tidy = F.regexp_replace(F.regexp_replace(dashed, "-{2,}", "-"), "^[ .-]+|[ .-]+$", "")
    return F.substring(F.coalesce(F.nullif(tidy, F.lit("")), F.lit(fallback)), 1, 120)
