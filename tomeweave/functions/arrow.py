"""The three Arrow-batched helpers for what Spark has no function for."""

from __future__ import annotations

import html
import re
import sys
from difflib import SequenceMatcher
from html.parser import HTMLParser
from itertools import accumulate

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

# executors need no copy of this package: the helpers travel with the task
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES_P = frozenset(("address article aside blockquote center div dl fieldset footer form h1 h2 h3 h4 "
                       "h5 h6 header hr main nav ol p pre section table ul").split())
_CLOSES = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
           "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
           "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_CLOSING = _CLOSES_P | frozenset(_CLOSES)
_BLOCKS = frozenset("p div li tr section article h1 h2 h3 h4 h5 h6 blockquote".split())
_RAW = frozenset(("script", "style", "template"))
_PAGES = 128
_SCRIPTS = {tag: re.compile(rf"</\s*{tag}\s*>", re.I) for tag in HTMLParser.CDATA_CONTENT_ELEMENTS}
_NAME, _GAP, _VALUE = r"[a-zA-Z_][\w:.-]*", r"[ \t\n\r\f]", r"""="[^"]*"|='[^']*'|=[\w.:#%+-]+(?=[ \t\n\r\f>]|$)"""
#: Tags as most pages write them; what this does not match is left to the standard parser.
_TAG = re.compile(rf"<(?:([a-zA-Z][a-zA-Z0-9-]*)((?:{_GAP}+{_NAME}(?:{_VALUE})?)*){_GAP}*(/?)>|/([a-zA-Z][a-zA-Z0-9-]*){_GAP}*>"
                  r"|!--[^<>-]*-->|!(?i:doctype)[^<>\[]*>)", re.A)
_ATTR = re.compile(rf"({_NAME})({_VALUE})?", re.A)
#: Short tags as written and what they say: pages repeat theirs, so most are read by one look.
_KNOWN: dict[str, tuple] = {}
_KNOWN_TAGS, _KNOWN_CHARS = 4096, 200
# captured pages are often escaped twice, so text and these attributes are resolved once more
_READ_AS_TEXT = frozenset(("content", "aria-label", "alt", "reviewer", "review-date"))

NODE_TYPE = T.ArrayType(T.StructType([
    T.StructField("pos", T.IntegerType()), T.StructField("last", T.IntegerType()),
    T.StructField("tag", T.StringType()),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    T.StructField("text", T.StringType())]))


def _kept(attrs):
    """The first of each attribute with its text resolved."""
    seen = {}
    for key, value in attrs:
        value = value or ""
        seen.setdefault(key, html.unescape(value) if key in _READ_AS_TEXT else value)
    return tuple(seen.items())


def _read_tag(m):
    """Start, start and end, end of an element, or nothing (a comment): ``(kind, name, attributes)``."""
    name, attrs, closed, ended = m.groups()
    if ended:
        return "/", ended.lower(), ()
    if not name:
        return "", "", ()
    pairs = [(k.lower(), html.unescape(v[2:-1] if v[1:2] in "\"'" else v[1:]) if v else None) for k, v in _ATTR.findall(attrs)] if attrs else ()
    return "<>" if closed else "<", name.lower(), _kept(pairs)


class _Tokens(HTMLParser):
    """Flat document-order node list with the extent of every element."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.open: list[int] = []
        # how many of each tag are open, so that no event has to look through the open ones
        self.count: dict[str, int] = {}
        self.raw = 0

    def updatepos(self, i, j):
        """Lines and columns are of no use here."""
        return j

    def _add(self, tag, attrs, text):
        self.rows.append([len(self.rows), len(self.rows), tag, attrs, text])
        return len(self.rows) - 1

    def _pop(self):
        row = self.rows[self.open.pop()]
        tag = row[2]
        self.count[tag] -= 1
        if tag in _RAW:
            self.raw -= 1
        elif tag in _BLOCKS:
            self._add("/block", (), None)
        row[1] = len(self.rows) - 1

    def _close_implied(self, tag):
        if tag in _CLOSES_P and self.count.get("p"):
            while self.rows[self.open[-1]][2] != "p":
                self._pop()
            self._pop()
        closes, fence = _CLOSES.get(tag, ((), ()))
        if not any(self.count.get(name) for name in closes):
            return
        for depth in range(len(self.open) - 1, -1, -1):
            name = self.rows[self.open[depth]][2]
            if name in fence:
                break
            if name in closes:
                while len(self.open) > depth:
                    self._pop()

    def handle_starttag(self, tag, attrs):
        self._start(tag, _kept(attrs))

    def _start(self, tag, kept):
        if tag in _CLOSING:
            self._close_implied(tag)
        at = self._add(tag, kept, None)
        if tag not in _VOID:
            self.open.append(at)
            self.count[tag] = self.count.get(tag, 0) + 1
            if tag in _RAW:
                self.raw += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self._end_at_once(tag)

    def _end_at_once(self, tag):
        if self.open and tag not in _VOID:
            self._pop()

    def handle_endtag(self, tag):
        if self.count.get(tag):
            while self.rows[self.open[-1]][2] != tag:
                self._pop()
            self._pop()

    def handle_data(self, data):
        kind = "#raw" if self.raw else "#hidden" if self.count.get("noscript") else "#text"
        self._add(kind, (), html.unescape(data) if not self.raw and "&" in data else data)

    def _plain(self, page):
        """Read a page of plain tags, with the events the standard parser has; False if any is not.

        A plain tag ends at its first ``>`` unless a quoted value holds one, and then no shorter
        text is a tag; so what is known up to there is the tag whatever follows.
        """
        rows, open_at, count, find = self.rows, self.open, self.count, page.find
        at, size = 0, len(page)
        while at < size:
            tag_at = find("<", at)
            end = size if tag_at < 0 else tag_at
            if at < end:
                text = page[at:end]
                if "&" in text:
                    self.handle_data(html.unescape(text))
                else:
                    rows.append([len(rows), len(rows), "#raw" if self.raw else "#hidden" if count.get("noscript") else "#text", (), text])
            if tag_at < 0:
                return True
            at = find(">", tag_at) + 1
            written = page[tag_at:at]
            read = _KNOWN.get(written)
            if read is None:
                m = _TAG.match(page, tag_at)
                if m is None:
                    return False
                read = _read_tag(m)
                if m.end() == at and len(written) <= _KNOWN_CHARS:
                    if len(_KNOWN) >= _KNOWN_TAGS:
                        _KNOWN.clear()
                    _KNOWN[written] = read
                at = m.end()
            kind, name, kept = read
            if kind == "/":
                if count.get(name):
                    while rows[open_at[-1]][2] != name:
                        self._pop()
                    self._pop()
            elif kind:
                self._start(name, kept)
                if kind == "<>":
                    self._end_at_once(name)
                elif name in _SCRIPTS:
                    close = _SCRIPTS[name].search(page, at)
                    if close is None:
                        return False
                    if at < close.start():
                        self.handle_data(page[at:close.start()])
                    self.handle_endtag(name)
                    at = close.end()
        return True

    def nodes(self, page):
        if not self._plain(page):
            self.__init__()
            self.feed(page)
            self.close()
        while self.open:
            self._pop()
        return self.rows


def _node_lists(pages: pa.Array) -> pa.Array:
    offsets, attr_offsets, keys, values = [0], [0], [], []
    pos, last, tags, attrs, texts, valid = [], [], [], [], [], []
    for page in pages.to_pylist():
        valid.append(page is not None)
        rows = _Tokens().nodes(page) if page else ()
        if rows:
            for column, held in zip((pos, last, tags, attrs, texts), zip(*rows)):
                column.extend(held)
        offsets.append(len(pos))
    for pairs in attrs:
        for key, value in pairs:
            keys.append(key), values.append(value)
        attr_offsets.append(len(keys))
    attr_map = pa.MapArray.from_arrays(pa.array(attr_offsets, pa.int32()),
                                       pa.array(keys, pa.string()), pa.array(values, pa.string()))
    rows = pa.StructArray.from_arrays(
        [pa.array(pos, pa.int32()), pa.array(last, pa.int32()), pa.array(tags, pa.string()),
         attr_map, pa.array(texts, pa.string())], ["pos", "last", "tag", "attrs", "text"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows,
                                    mask=pa.array([not v for v in valid], pa.bool_()))


@F.arrow_udf(NODE_TYPE)
def parse_nodes(pages: pa.Array) -> pa.Array:
    """HTML text to its flat node list; null stays null.

    A few pages at a time: their nodes are Python objects only until they are packed.
    """
    return pa.concat_arrays([_node_lists(pages.slice(i, _PAGES)) for i in range(0, len(pages), _PAGES)] or [_node_lists(pages)])


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def seq_ratios(lefts: pa.Array, rights: pa.Array) -> pa.Array:
    """Pairwise Ratcliff-Obershelp similarity; a null on either side gives null.

    Argument order matters, and texts of 200 characters or more use the popular-character
    rule, both as in the standard library.
    """
    matcher, last = SequenceMatcher(None), None
    out = []
    for left, right in zip(lefts.to_pylist(), rights.to_pylist()):
        row = []
        for a, b in zip(left or (), right or ()):
            if a is None or b is None:
                row.append(None)
                continue
            if b != last:
                matcher.set_seq2(b)
                last = b
            matcher.set_seq1(a)
            row.append(matcher.ratio())
        out.append(row)
    return pa.array(out, pa.list_(pa.float64()))


#: A whole string of either quote, also one that never ends, or a single bracket.
_STRING_OR_BRACKET = re.compile(r'''"(?:[^"\\]|\\.)*(?:"|\\?\Z)|'(?:[^'\\]|\\.)*(?:'|\\?\Z)|[\[\]]''', re.S)
_DEEPER = {"[": 1, "]": -1}


def _closing(text):
    """End of the bracket that closes the first one; None without."""
    marks = [m for m in _STRING_OR_BRACKET.finditer(text or "") if m[0] in _DEEPER]
    depths = accumulate(_DEEPER[m[0]] for m in marks)
    return next((m.end() for m, depth in zip(marks, depths) if depth == 0), None)


@F.arrow_udf(T.StringType())
def bracket_block(texts: pa.Array) -> pa.Array:
    """The balanced ``[...]`` a text starts with, quotes respected; null when it never closes."""
    out = []
    for text in texts.to_pylist():
        end = _closing(text)
        out.append(None if end is None else text[:end])
    return pa.array(out, pa.string())


@F.arrow_udf(T.StringType())
def unescape_all(texts: pa.Array) -> pa.Array:
    """Every HTML 5 entity; callers hand over only the rows that need it, as null otherwise."""
    return pa.array([None if t is None else html.unescape(t) for t in texts.to_pylist()], pa.string())
