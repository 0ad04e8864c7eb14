"""Date expressions.  Results are strings: a partial date is a valid date here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed import MONTHS, PACIFIC
from .core import blank_to_null, let, lookup
from .text import clean


def _ymd(year: Column, month: Column, day: Column) -> Column:
    """ISO date from digit strings, null when there is no such day."""
    padded = F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return let(padded, lambda p: F.when(F.try_to_date(p, "yyyy-MM-dd").isNotNull() & ~p.startswith("0000")
                                        & (F.length(p) == 10), p))


def _part(text: Column, pattern: str, group: int) -> Column:
    return blank_to_null(F.regexp_extract(text, pattern, group))


def iso_date(raw: Column) -> Column:
    """A human date as ISO text where derivable, else the cleaned text.

    Slashed dates are read day first; a month without a day gives ``YYYY-MM``, a lone year
    ``YYYY``.
    """
    dashed, slashed = r"^(\d{4})-(\d{1,2})-(\d{1,2})$", r"^(\d{4})/(\d{1,2})/(\d{1,2})$"
    slashed_tail, year_month = r"^(\d{1,2})/(\d{1,2})/(\d{4})$", r"^(\d{4})-(0?[1-9]|1[0-2])$"
    phrase = r"\b(?:(\d{1,2})\s+)?([A-Za-z]{3,9})\.?\s+(?:(\d{1,2}),?\s+)?(\d{4})\b"
    months = {k: str(v) for k, v in MONTHS.items()}

    def from_phrase(c: Column) -> Column:
        parts = F.struct(lookup(months, F.lower(F.regexp_extract(c, phrase, 2))).alias("month"),
                         F.coalesce(_part(c, phrase, 1), _part(c, phrase, 3)).alias("day"),
                         F.regexp_extract(c, phrase, 4).alias("year"))
        return let(parts, lambda p: F.when(p["month"].isNotNull(), F.coalesce(
            _ymd(p["year"], p["month"], p["day"]),
            F.concat(p["year"], F.lit("-"), F.lpad(p["month"], 2, "0")))))

    def ladder(c: Column) -> Column:
        a, b, y = (F.regexp_extract(c, slashed_tail, i) for i in (1, 2, 3))
        # each rung tests its shape once before it takes anything apart
        return F.coalesce(
            _part(c, r"\b\d{4}-\d{2}-\d{2}\b", 0),
            F.when(c.rlike(dashed), _ymd(*(F.regexp_extract(c, dashed, i) for i in (1, 2, 3)))),
            F.when(c.rlike(slashed), _ymd(*(F.regexp_extract(c, slashed, i) for i in (1, 2, 3)))),
            F.when(c.rlike(slashed_tail), F.coalesce(_ymd(y, b, a), _ymd(y, a, b))),
            F.when(c.rlike(year_month), F.concat(F.regexp_extract(c, year_month, 1), F.lit("-"),
                                                 F.lpad(F.regexp_extract(c, year_month, 2), 2, "0"))),
            F.when(c.rlike(phrase), from_phrase(c)),
            _part(c, r"\b(1[0-9]{3}|20[0-9]{2})\b", 1),
            c)

    def prepared(found: Column) -> Column:
        c = F.regexp_replace(found, r"(?i)^(?:first\s+)?published[:\s]*", "")
        c = F.regexp_replace(c, r"(?i)\b(\d{1,2})(?:st|nd|rd|th)\b", "$1")
        return F.regexp_replace(c, "^[ ,.;]+|[ ,.;]+$", "")

    return let(clean(raw), lambda t: F.when(t != "", let(prepared(t), ladder)))


def date_precision(iso: Column) -> Column:
    return (F.when(iso.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit("day"))
            .when(iso.rlike(r"^\d{4}-\d{2}$"), F.lit("month"))
            .when(iso.rlike(r"^\d{4}$"), F.lit("year"))
            .when(iso.isNotNull(), F.lit("text")))


def _zoned_day(millis: Column, zone: str) -> Column:
    """Calendar day of an epoch-millisecond value in ``zone``, whatever the session zone."""
    utc = F.convert_timezone(F.lit("UTC"), F.lit(zone),
                             F.timestamp_add("MILLISECOND", millis, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")))
    return F.date_format(utc.cast("date"), "yyyy-MM-dd")


def epoch_date(millis: Column) -> Column:
    return _zoned_day(millis.try_cast("bigint"), "UTC")


def published_date(millis: Column, pacific: bool = True) -> Column:
    """Publication times are midnight Pacific; review times are UTC."""
    return _zoned_day(millis.try_cast("bigint"), PACIFIC if pacific else "UTC")


def us_short_date(raw: Column) -> Column:
    """``MM-DD-YY`` with the pivot at 70, else :func:`iso_date`."""
    shape = r"^(\d{2})-(\d{2})-(\d{2})$"

    def expand(text: Column) -> Column:
        year = F.regexp_extract(text, shape, 3)
        century = F.when(year < "70", F.lit("20")).otherwise(F.lit("19"))
        return F.when(text.rlike(shape), F.concat(
            century, year, F.lit("-"), F.regexp_extract(text, shape, 1), F.lit("-"),
            F.regexp_extract(text, shape, 2))).otherwise(iso_date(text))

    return let(clean(raw), expand)


def stamp_date(raw: Column) -> Column:
    """Day of a leading timestamp, else :func:`iso_date`."""
    shape = r"^\d{4}-\d{2}-\d{2}(?![\d-])"
    return let(clean(raw), lambda t: F.coalesce(_part(t, shape, 0), iso_date(t)))


def reviewed_on(raw: Column) -> Column:
    """The date inside ``Reviewed in <country> on <date>``, or the whole text."""
    inner = _part(raw, r"(?i)Reviewed in .+? on (.+?)\s*$", 1)
    return F.coalesce(inner, raw)


def published_by(raw: Column) -> Column:
    """``published <date> by <publisher>`` to ``struct<date, publisher>``."""
    shape = r"(?is)^published\s+(.*?)(?:\s+by\s+(.+))?$"
    return let(raw, lambda r: _published_by(r, shape))


def _published_by(raw: Column, shape: str) -> Column:
    return F.when(raw.rlike(shape), F.struct(
        iso_date(_part(raw, shape, 1)).alias("date"), clean(_part(raw, shape, 2)).alias("publisher")))
