"""Selections over parsed pages: plain column expressions on the flat node list.

``arrow.parse_nodes`` turns a page into an array of nodes in document order, each with the
position of its last descendant.  A subtree is therefore a slice, and every selector below
is a filter on a slice: no shuffle, no further Python.  Entities are resolved while parsing,
so the text of a node only needs its white space tidied.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed import BLOCK_TAGS, ORIGIN_KEYS
from .core import blank_to_null, keep_nonblank, let, literal_array
from .payload import place_text
from .text import squash, tidy

Test = Callable[[Column], Column]


def attr(node: Column, name: str) -> Column:
    return F.try_element_at(node["attrs"], F.lit(name))


def is_element(node: Column) -> Column:
    """Tags start with a letter; text, raw content and block ends have ``#`` or ``/``, which sort before."""
    return node["tag"] >= "A"


def el(tag: str | list[str] | None = None, cls: str | list[str] = (), attrs: dict | None = None,
       has: list[str] = ()) -> Test:
    """A node test: tag, classes, attribute values and attributes that must be present.

    An attribute value that starts with ``^``, ``*`` or ``~`` is a prefix, a substring or a
    regular expression.
    """
    tags = [tag] if isinstance(tag, str) else tag
    classes = [cls] if isinstance(cls, str) else list(cls)

    # only elements have attributes, so a test for what one holds needs no look at the tag besides
    marked = bool(classes or has or any(v.lstrip("^*") and v[:1] != "~" for v in (attrs or {}).values()))

    def test(node: Column) -> Column:
        checks = [node["tag"].isin(tags)] if tags else [] if marked else [is_element(node)]
        # few nodes hold the text of a class at all, and only those are split
        checks += [F.contains(attr(node, "class"), F.lit(c)) & F.array_contains(F.split(attr(node, "class"), "\\s+"), c) for c in classes]
        for name, value in (attrs or {}).items():
            # a filter drops what is null; a missing attribute counts as empty only where that may match
            held = attr(node, name) if value.lstrip("^*") and value[:1] != "~" else F.coalesce(attr(node, name), F.lit(""))
            checks.append(F.startswith(held, F.lit(value[1:])) if value[:1] == "^" else
                          F.contains(held, F.lit(value[1:])) if value[:1] == "*" else
                          held.rlike(value[1:]) if value[:1] == "~" else held == value)
        checks += [attr(node, name).isNotNull() for name in has]
        out = checks[0]
        for check in checks[1:]:
            out = out & check
        return out

    return test


def subtree(nodes: Column, node: Column) -> Column:
    """The node and everything inside it."""
    return F.slice(nodes, node["pos"] + 1, node["last"] - node["pos"] + 1)


def inside(nodes: Column, node: Column) -> Column:
    return F.slice(nodes, node["pos"] + 2, node["last"] - node["pos"])


def select(nodes: Column, *chain: Test) -> Column:
    """All nodes matching a descendant chain, in document order."""
    found = F.filter(nodes, chain[0])
    for test in chain[1:]:
        found = _descend(nodes, found, test)
    return found


def select_in(nodes: Column, node: Column, *chain: Test) -> Column:
    """The same below one node."""
    found = F.filter(inside(nodes, node), chain[0])
    for test in chain[1:]:
        found = _descend(nodes, found, test)
    return found


def _descend(nodes: Column, scopes: Column, test: Test) -> Column:
    spots = F.flatten(F.transform(scopes, lambda s: F.transform(
        F.filter(inside(nodes, s), test), lambda n: n["pos"])))
    return F.transform(F.sort_array(F.array_distinct(spots)), lambda p: F.get(nodes, p))


def first(found: Column) -> Column:
    return F.get(found, 0)


def strings(nodes: Column, node: Column, sep: str) -> Column:
    """Text pieces below a node joined by ``sep``, not yet cleaned."""

    def join(top: Column) -> Column:
        pieces = F.filter(subtree(nodes, top), lambda n: n["tag"].isin("#text", "#hidden"))
        return F.array_join(F.transform(pieces, lambda n: n["text"]), sep)

    return let(node, join)


def text_of(nodes: Column, node: Column, sep: str = "\n") -> Column:
    """Clean text of a node, '' when the node is missing."""
    return tidy(strings(nodes, node, sep))


def html_text_of(nodes: Column, node: Column) -> Column:
    """Readable text of a node: breaks and block tags become line breaks."""
    return tidy(let(node, lambda n: _rendered(inside(nodes, n), BLOCK_TAGS)))


def page_text(nodes: Column) -> Column:
    return tidy(_rendered(nodes, BLOCK_TAGS))


def prose_of(nodes: Column, node: Column) -> Column:
    """Text with only ``<br>`` as a line break and nothing between inline pieces."""
    from .text import drop_read_more
    return F.trim(drop_read_more(tidy(let(node, lambda n: _rendered(inside(nodes, n), [])))))


def _rendered(part: Column, blocks: list[str]) -> Column:
    breaks = ["br", *blocks, *(["/block"] if blocks else [])]
    return F.array_join(F.transform(part, lambda n: F.when(n["tag"] == "#text", n["text"])
                                    .when(n["tag"].isin(breaks), F.lit("\n")).otherwise(F.lit(""))), "")


def sel(nodes: Column, *chains: list[Test]) -> Column:
    """Clean text of the first node of the first chain that has any; null when none has."""
    return F.coalesce(*[blank_to_null(text_of(nodes, first(select(nodes, *chain)))) for chain in chains])


def sels(nodes: Column, *chains: list[Test]) -> Column:
    """Clean, de-duplicated text of every node that any chain finds, chain by chain."""
    from .lists import dedupe
    return dedupe(F.concat(*[F.transform(select(nodes, *chain), lambda n: text_of(nodes, n))
                             for chain in chains]))


def attr_values(nodes: Column, name: str, *chain: Test) -> Column:
    """Every non-empty value of one attribute on the nodes a chain finds."""
    from .lists import dedupe
    return dedupe(keep_nonblank(F.transform(select(nodes, *chain), lambda n: F.trim(attr(n, name)))))


def meta(nodes: Column, *names: str) -> Column:
    """Content of the first meta tag for a key, by property, then name, then itemprop."""

    def pick(tags: Column) -> Column:
        options = []
        for key in names:
            for holder in ("property", "name", "itemprop"):
                node = first(F.filter(tags, el("meta", attrs={holder: key})))
                options.append(blank_to_null(tidy(attr(node, "content"))))
        return F.when(F.size(tags) > 0, F.coalesce(*options))

    return let(F.filter(nodes, lambda n: n["tag"] == "meta"), pick)


def raw_text_of(nodes: Column, node: Column) -> Column:
    """Script content as written."""
    return F.array_join(F.transform(F.filter(inside(nodes, node), lambda n: n["tag"] == "#raw"),
                                    lambda n: n["text"]), "")


def looks_like_html(html: Column) -> Column:
    """A body without any '<' near its start is not a page."""
    return (html == "") | F.contains(F.substring(html, 1, 4096), F.lit("<"))


def _origin_label() -> str:
    """Pattern of lower-case text that, squashed up to its first colon, is an origin key."""
    gap = "[^0-9a-z:]*+"
    return f"\\A{gap}(?:{'|'.join(''.join(c + gap for c in key) for key in ORIGIN_KEYS)})(?::|\\z)"


def origin_of(nodes: Column) -> Column:
    """Place of publication in the markup: meta, itemprop, then a labelled cell or text."""
    wanted = literal_array(ORIGIN_KEYS)
    known = lambda c: c.isNotNull() & F.array_contains(wanted, squash(c))
    best = lambda found: F.get(F.filter(found, lambda p: p.isNotNull()), 0)

    by_meta = best(F.transform(
        F.filter(nodes, lambda n: (n["tag"] == "meta") & (known(attr(n, "property")) | known(attr(n, "name"))
                                                          | known(attr(n, "itemprop")))),
        lambda n: place_text(attr(n, "content"))))
    by_prop = best(F.transform(
        F.filter(nodes, lambda n: known(attr(n, "itemprop"))),
        lambda n: F.coalesce(place_text(attr(n, "content")), place_text(strings(nodes, n, "\n")))))

    def beside(label: Column) -> Column:
        rest = F.regexp_extract(label["text"], "(?s)^[^:]*:(.*)$", 1)
        holder = F.element_at(F.filter(nodes, lambda n: (n["pos"] < label["pos"]) & (n["last"] >= label["pos"])
                                       & is_element(n)), -1)
        after = F.get(F.filter(F.slice(nodes, holder["last"] + 2, F.size(nodes)),
                               lambda n: is_element(n)), 0)
        return F.coalesce(place_text(rest), place_text(strings(nodes, after, "\n")))

    by_label = best(F.transform(
        F.filter(nodes, lambda n: (n["tag"] == "#text") & (F.length(n["text"]) <= 200)
                 & F.lower(n["text"]).rlike(_origin_label())), beside))
    return F.coalesce(by_meta, by_prop, by_label)
