"""URL expressions, by pattern so that one odd character never loses the whole URL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed import AUDIBLE_COVER_JUNK, KOBO_COVER_URL
from .core import alternation, let

_AUTHORITY = r"^([A-Za-z][A-Za-z0-9+.\-]*):(//[^/?#]*)?([^?#]*)"


def host_of(url: Column) -> Column:
    """Lower-case host name, '' when there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")),
                                    r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^:/?#]*)", 1))


def strip_query(url: Column) -> Column:
    return F.regexp_replace(url, "[?#].*$", "")


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def slug_base(url: Column) -> Column:
    """Last path segment in lower case without an edition number."""
    last = F.element_at(F.split(F.regexp_replace(path_of(url), "/+$", ""), "/"), -1)
    return F.regexp_replace(F.lower(last), r"-\d+$", "")


def _without_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of an absolute path."""
    parts = F.split(path, "/")
    folded = F.aggregate(
        F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(s))))
    tail = F.when(path.rlike(r"/\.{1,2}$"), F.lit("/")).otherwise(F.lit(""))
    joined = F.array_join(folded, "/")
    return F.concat(F.lit("/"), joined, F.when(joined == "", F.lit("")).otherwise(tail))


def absolute(base: Column, url: Column) -> Column:
    """Resolve a link against its page; script, data, mail and fragment links give ''."""

    def resolve(raw: Column) -> Column:
        root = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", 0)
        base_path = path_of(base)
        folder = F.regexp_replace(F.coalesce(F.nullif(base_path, F.lit("")), F.lit("/")), "[^/]*$", "")
        link_path = F.regexp_extract(raw, "^[^?#]*", 0)
        rest = F.substring(raw, F.length(link_path) + 1, F.length(raw))
        return (F.when((raw == "") | raw.rlike("^(?:javascript:|data:|#|mailto:)"), F.lit(""))
                .when(raw.startswith("//"), F.concat(F.lit("https:"), raw))
                .when(raw.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), raw)
                .when(root == "", raw)
                .when(raw.startswith("?"), F.concat(root, base_path, raw))
                .when(raw.startswith("/"), F.concat(root, _without_dots(link_path), rest))
                .otherwise(F.concat(root, _without_dots(F.concat(folder, link_path)), rest)))

    return let(F.trim(F.coalesce(url, F.lit(""))), resolve)


# ------------------------------------------------------------------ image identity and size
def image_key(source: str, url: Column) -> Column:
    """Identity of the artwork behind an image URL; '' refuses the image."""
    last = F.element_at(F.split(F.regexp_replace(F.regexp_replace(url, r"\?.*$", ""), "/+$", ""), "/"), -1)
    stem = F.get(F.split(last, r"\."), 0)
    rules = {
        "amazon": F.get(F.split(F.element_at(F.split(url, "/"), -1), r"\."), 0),
        "goodreads": F.lower(_or_whole(url, r"/books/(.+)$")),
        "audible": F.when(url.rlike(alternation(AUDIBLE_COVER_JUNK)), F.lit("")).otherwise(
            F.lower(_or_whole(url, r"/images/[A-Z]/([A-Za-z0-9%+\-]+)\."))),
        "kobo": F.lower(_or_whole(url, r"book-images/([0-9a-fA-F-]{36})/")),
        "bookbub": F.lower(stem),
    }
    return rules.get(source, F.lower(url))


def _or_whole(url: Column, pattern: str) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(url, pattern, 1), F.lit("")), url)


def full_size(source: str, url: Column) -> Column:
    """Rewrite an image URL to the largest rendition its shop serves."""
    kobo_id = F.lower(F.regexp_extract(url, r"book-images/([0-9a-fA-F-]{36})/", 1))
    head, tail = KOBO_COVER_URL.split("{}")
    rules = {
        "amazon": F.regexp_replace(url, r"(?i)\._[A-Za-z0-9_,%+\-]+_\.(jpe?g|png)$", ".$1"),
        "goodreads": F.regexp_replace(
            F.regexp_replace(url, r"\._S[XY]\d+_(?=\.[A-Za-z0-9]{2,5}$)", ""),
            r"(/books/\d+)[a-z](?=/)", "$1i"),
        "audible": F.regexp_replace(url, r"\._SL\d+_", "._SL500_"),
        "kobo": F.when(kobo_id != "", F.concat(F.lit(head), kobo_id, F.lit(tail))).otherwise(url),
        "bookbub": _without_transform(url),
    }
    return rules.get(source, url)


def _without_transform(url: Column) -> Column:
    """Drop the transformation segments between ``/upload/`` and the version or file."""
    parts = F.split(F.regexp_extract(url, r"/upload/(.*)$", 1), "/")
    is_start = lambda s: s.rlike(r"^v\d+$|\.[A-Za-z0-9]{2,5}$")
    first = F.array_position(F.transform(parts, is_start), True)
    kept = F.slice(parts, F.greatest(first, F.lit(1)).cast("int"), F.size(parts))
    head = F.get(F.split(url, "/upload/", 2), 0)
    return F.when(F.contains(url, F.lit("/upload/")) & (first > 0),
                  F.concat(head, F.lit("/upload/"), F.array_join(kept, "/"))).otherwise(url)


def without_modifier(pattern: str):
    """A rewrite that deletes a size directive given as a pattern."""
    return lambda url: F.regexp_replace(url, pattern, "")
