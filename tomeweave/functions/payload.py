"""Expressions over JSON payloads held as ``variant``; everything stays in the row.

Object keys of a variant come back in name order, not in document order.  Where document
order decides a result the caller works on the text (:func:`object_keys`).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed import JSONLD_WRAPPERS, ORIGIN_KEYS, PLACE_NAME_KEYS
from .core import blank_to_null, keep_nonblank, let, literal_array
from .text import clean, squash

_FOUND = "array<struct<path:string,node:variant>>"


def loads(raw: Column) -> Column:
    """JSON text to variant with two repairs (trailing commas, control characters)."""
    bare = F.regexp_replace(raw, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]", " ")
    repaired = F.regexp_replace(bare, ",\\s*([}\\]])", "$1")
    return F.coalesce(F.try_parse_json(F.trim(raw)), F.try_parse_json(repaired))


def loads_escaped(raw: Column) -> Column:
    """Attribute JSON that may still be entity-escaped."""
    from .text import unescape
    return F.coalesce(as_object(loads(raw)), as_object(loads(unescape(raw))))


def _path(keys: tuple[str, ...]) -> str:
    return "$" + "".join(f'["{k}"]' for k in keys)


def member(node: Column, *keys: str) -> Column:
    return F.try_variant_get(node, _path(keys), "variant")


def raw_text(node: Column, *keys: str) -> Column:
    """Scalar under a path as text; null for a missing or null member."""
    return F.try_variant_get(node, _path(keys), "string")


def text(node: Column, *keys: str) -> Column:
    """Cleaned scalar text, null when empty."""
    return blank_to_null(clean(raw_text(node, *keys)))


def elements(node: Column, *keys: str) -> Column:
    """Members of an array, an empty list when it is no array."""
    return F.coalesce(F.try_variant_get(node, _path(keys), "array<variant>"),
                      F.array().cast("array<variant>"))


def as_map(node: Column) -> Column:
    return F.try_variant_get(node, "$", "map<string,variant>")


def is_object(node: Column) -> Column:
    return as_map(node).isNotNull()


def as_object(node: Column) -> Column:
    """The node itself when it is an object, else null."""
    return let(node, lambda n: F.when(is_object(n), n))


def is_array(node: Column) -> Column:
    return F.try_variant_get(node, "$", "array<variant>").isNotNull()


def named(node: Column, *keys: str) -> Column:
    """A value that may be plain text or an object with a name."""
    return F.coalesce(text(node, *keys, "name"),
                      F.when(~is_object(member(node, *keys)), text(node, *keys)))


def names(node: Column, *keys: str) -> Column:
    """``[{"name": x}, ...]`` to the clean names."""
    return keep_nonblank(F.transform(elements(node, *keys), lambda e: clean(raw_text(e, "name"))))


def list_or_text(node: Column, *keys: str) -> Column:
    """A list field in any of its shapes: text, object with a name, list of either."""
    from .lists import LIST_SEPARATORS, name_list

    def items(value: Column) -> Column:
        each = F.transform(F.try_variant_get(value, "$", "array<variant>"),
                           lambda e: F.coalesce(raw_text(e, "name"), F.when(~is_object(e), raw_text(e))))
        named_one = F.when(is_object(value), F.array(F.coalesce(raw_text(value, "name"), raw_text(value, "@id"))))
        plain = F.split(F.coalesce(raw_text(value), F.lit("")), LIST_SEPARATORS)
        return F.coalesce(each, named_one, plain)

    return name_list(let(member(node, *keys), items))


def object_keys(raw: Column) -> Column:
    """Member names of a JSON object text, in document order."""
    return F.json_object_keys(raw)


# ------------------------------------------------------------------ JSON-LD
def jsonld_blocks(html: Column) -> Column:
    return F.regexp_extract_all(
        html, F.lit(r"(?is)<script\b[^>]*\btype\s*=\s*[\"']?application/ld\+json[^>]*>(.*?)</script"),
        F.lit(1))


def jsonld(html: Column, want: list[str] | None = None) -> Column:
    """Every JSON-LD object of a page in reading order, optionally of the given types.

    Lists and the usual wrappers are opened down to six levels; a wrapper is kept itself.
    """

    def spread(item: Column) -> Column:
        here, node = item["path"], item["node"]

        def child(value: Column, rank: Column) -> Column:
            return F.struct(F.concat(here, F.lpad(rank.cast("string"), 7, "0")).alias("path"),
                            value.alias("node"))

        listed = F.transform(F.try_variant_get(node, "$", "array<variant>"), child)
        wrapped = F.filter(F.array(*[child(member(node, key), F.lit(rank))
                                     for rank, key in enumerate(JSONLD_WRAPPERS)]),
                           lambda c: c["node"].isNotNull())
        return F.coalesce(listed, wrapped).cast(_FOUND)

    def step(acc: Column, _: Column) -> Column:
        objects = F.filter(acc["frontier"], lambda i: is_object(i["node"]))
        return F.struct(F.flatten(F.transform(acc["frontier"], spread)).cast(_FOUND).alias("frontier"),
                        F.concat(acc["found"], objects).cast(_FOUND).alias("found"))

    roots = F.filter(
        F.transform(jsonld_blocks(html), lambda b, i: F.struct(
            F.lpad(i.cast("string"), 7, "0").alias("path"), loads(b).alias("node"))),
        lambda r: r["node"].isNotNull()).cast(_FOUND)
    start = F.struct(roots.alias("frontier"), F.array().cast(_FOUND).alias("found"))
    found = F.aggregate(F.sequence(F.lit(0), F.lit(6)), start, step, lambda acc: acc["found"])
    ordered = F.array_sort(found, lambda a, b: F.when(a["path"] < b["path"], -1)
                           .when(a["path"] > b["path"], 1).otherwise(0))
    nodes = F.transform(ordered, lambda i: i["node"])
    return nodes if want is None else of_type(nodes, want)


def of_type(nodes: Column, want: list[str]) -> Column:
    """Those of the objects :func:`jsonld` found that have one of the types."""
    return F.filter(nodes, lambda n: has_type(n, want))


def has_type(node: Column, want: list[str]) -> Column:
    wanted = literal_array([w.lower() for w in want])
    kinds = F.coalesce(
        F.transform(F.try_variant_get(node, '$["@type"]', "array<variant>"), lambda t: raw_text(t)),
        F.array(raw_text(node, "@type")))
    return F.exists(kinds, lambda k: F.coalesce(F.array_contains(wanted, F.lower(k)), F.lit(False)))


def breadcrumb_names(block: Column) -> Column:
    """Names along one breadcrumb block."""
    return keep_nonblank(F.transform(
        F.filter(elements(block, "itemListElement"), is_object),
        lambda e: F.coalesce(F.when(is_object(member(e, "item")), clean(raw_text(e, "item", "name"))),
                             clean(raw_text(e, "name")))))


# ------------------------------------------------------------------ pointer cache
def nodes_of_type(cache: Column, typename: str) -> Column:
    """Nodes of one ``__typename`` in a flat cache (``map<string,variant>``)."""
    return F.filter(F.map_values(cache), lambda n: raw_text(n, "__typename") == typename)


def deref(cache: Column, ref: Column) -> Column:
    """Follow ``{"__ref": key}``; an object without a pointer is the node itself."""
    key = raw_text(ref, "__ref")
    return F.when(key.isNotNull(), as_object(F.try_element_at(cache, key))).otherwise(as_object(ref))


def root_book(cache: Column, legacy_id: Column) -> Column:
    """The real book node: the root query's entry for the id, else its first of that kind."""
    root = as_map(F.try_element_at(cache, F.lit("ROOT_QUERY")))
    kind = "getBookByLegacyId("
    exact = F.concat(F.lit(kind + '{"legacyId":"'), legacy_id, F.lit('"})'))
    first = F.get(F.filter(F.map_entries(root), lambda e: F.startswith(e["key"], F.lit(kind))), 0)["value"]
    return deref(cache, F.coalesce(F.try_element_at(root, exact), first))


# ------------------------------------------------------------------ place of publication
def walk_values(node: Column, keys: list[str], max_depth: int = 8, max_nodes: int = 20000) -> Column:
    """Values of the given (squashed) keys anywhere in a payload, shallow ones first.

    Breadth first, ``max_depth`` levels deep, over at most ``max_nodes`` containers.
    """
    wanted = literal_array(keys)

    def own(n: Column) -> Column:
        hits = F.map_values(F.map_filter(as_map(n), lambda k, v: F.array_contains(wanted, squash(k))))
        return F.coalesce(hits, F.array().cast("array<variant>"))

    def containers(n: Column) -> Column:
        inner = F.coalesce(F.map_values(as_map(n)), elements(n))
        return F.filter(inner, lambda c: is_object(c) | is_array(c))

    def step(acc: Column, _: Column) -> Column:
        now = F.slice(acc["frontier"], F.lit(1), acc["budget"])
        return F.struct(
            F.flatten(F.transform(now, containers)).cast("array<variant>").alias("frontier"),
            (acc["budget"] - F.size(now)).cast("int").alias("budget"),
            F.concat(acc["hits"], F.flatten(F.transform(now, own))).cast("array<variant>").alias("hits"))

    start = F.struct(F.array(node).cast("array<variant>").alias("frontier"),
                     F.lit(max_nodes).cast("int").alias("budget"),
                     F.array().cast("array<variant>").alias("hits"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(max_depth)), start, step, lambda acc: acc["hits"])


def place_text(raw: Column) -> Column:
    """Text that reads as a place, null otherwise."""
    edge = "[ \\t\"'`{}\\[\\],;:|\\-–—]+"
    trimmed = F.regexp_replace(clean(raw), f"^{edge}|{edge}$", "")
    return let(F.trim(F.regexp_replace(trimmed, "\\s+", " ")), lambda p: F.when(
        F.length(p).between(2, 120) & ~p.rlike("^[{\\[<]")
        & ~F.lower(p).isin("null", "none", "n/a"), p))


def place(value: Column, depth: int = 3) -> Column:
    """A JSON value as a place: text, an object's name, or the first of a short list."""

    def best(inner: Column) -> Column:
        if depth == 0:
            return F.lit(None).cast("string")
        return F.get(F.filter(F.transform(inner, lambda c: place(c, depth - 1)), lambda p: p.isNotNull()), 0)

    def by_kind(members: Column) -> Column:
        listed = F.slice(F.try_variant_get(value, "$", "array<variant>"), 1, 8)
        named = F.transform(literal_array(PLACE_NAME_KEYS), lambda k: F.try_element_at(members, k))
        inner = F.when(members.isNotNull(), named).otherwise(listed)
        scalar = F.when(F.schema_of_variant(value) == "STRING", place_text(raw_text(value)))
        return let(inner, lambda i: F.when(i.isNotNull(), best(i)).otherwise(scalar))

    return let(as_map(value), by_kind)


def origin_in(node: Column) -> Column:
    """First place under any of the publication-place keys of a payload."""
    hits = walk_values(node, ORIGIN_KEYS)
    return F.get(F.filter(F.transform(hits, lambda h: place(h)), lambda p: p.isNotNull()), 0)


def origin_in_map(pairs: Column) -> Column:
    """The same over a flat label map."""
    wanted = literal_array(ORIGIN_KEYS)
    hits = F.filter(F.map_entries(pairs), lambda e: F.array_contains(wanted, squash(e["key"])))
    return F.get(F.filter(F.transform(hits, lambda e: place_text(e["value"])),
                          lambda p: p.isNotNull()), 0)
