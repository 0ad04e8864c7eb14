"""Text expressions: cleaning, folding, titles, people, slugs.  All JVM-side."""

from __future__ import annotations

import html.entities
import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import (BLOCK_TAGS, CATALOGUE_LANGUAGES, DERIVATIVE_MARKERS, LANGUAGE_NAMES,
                     ORDINALS, SUBTITLE_PATTERN)
from .arrow import unescape_all
from .core import (apply_sql, blank_to_null, keep_nonblank, let, literal_array, literal_map, lookup,
                   sql_text)

#: horizontal Unicode white space, spelled out: Java's plain \s is ASCII only
SPACES = "\\t\\x0b\\f \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


# ------------------------------------------------------------------ entities
@lru_cache(maxsize=1)
def _entity_names() -> dict[str, str]:
    """The named entities of HTML 4, with and (where browsers allow it) without semicolon.

    The 2,000 names only HTML 5 knows are left to ``unescape_rows``: as literals they would
    travel with every expression.
    """
    known = {}
    # a map literal is searched from its start, so the usual names come first
    usual = ("amp", "nbsp", "quot", "lt", "gt", "hellip", "mdash", "ndash", "rsquo", "lsquo", "rdquo", "ldquo")
    for name in dict.fromkeys([*usual, *html.entities.name2codepoint]):
        for spelling in (name, name + ";"):
            if spelling in html.entities.html5:
                known["&" + spelling] = html.entities.html5[spelling]
    return known


def _open_names() -> str:
    """Pattern of the names that hold without a semicolon, the longest first."""
    names = sorted((k for k in _entity_names() if not k.endswith(";")), key=len, reverse=True)
    return "^(?:" + "|".join(names) + ")"


@lru_cache(maxsize=8)
def _unescape_sql(v: str = "v") -> str:
    """SQL text over a bound name: no entity at all, only frequent ones, or token by token."""
    plain = v
    # '&amp;' goes last, so the chain of replacements is a single pass
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
                       ("&nbsp;", "\xa0"), ("&apos;", "'"), ("&amp;", "&")):
        plain = f"replace({plain}, {sql_text(name)}, {sql_text(char)})"
    packed = "\x02".join(f"{k}\x01{c}" for k, c in _entity_names().items())
    names = f"str_to_map({sql_text(packed)}, '\x02', '\x01')"
    digits = ("if(k rlike '^&#[xX]', regexp_extract(k, '^&#[xX]0*([0-9a-fA-F]*)', 1), "
              "conv(regexp_extract(k, '^&#0*([0-9]{0,9})', 1), 10, 16))")
    number = "cast(conv(h, 16, 10) AS bigint)"
    # numbers 128 to 159 mean the Windows code page; control codes and non-characters mean nothing
    windows = "\x02".join(f"{b:X}\x01{bytes([b]).decode('cp1252', 'ignore') or chr(b)}" for b in range(0x80, 0xA0))
    nothing = (f"{number} BETWEEN 1 AND 8 OR {number} IN (11, 127) OR {number} BETWEEN 14 AND 31 "
               f"OR {number} BETWEEN 64976 AND 65007 OR {number} % 65536 >= 65534")
    point = (f"transform(array({digits}), h -> CASE WHEN {number} BETWEEN 128 AND 159 "
             f"THEN try_element_at(str_to_map({sql_text(windows)}, '\x02', '\x01'), upper(ltrim('0', h))) "
             f"WHEN length(h) > 6 OR {number} = 0 OR {number} BETWEEN 55296 AND 57343 OR {number} > 1114111 THEN '\ufffd' WHEN {nothing} THEN '' "
             f"ELSE decode(unhex(lpad(h, 8, '0')), 'UTF-32') END)[0]")
    tokens = f"regexp_extract_all({v}, '&#[xX][0-9a-fA-F]+;?|&#[0-9]+;?|&[A-Za-z][A-Za-z0-9]*;?|[^&]+|&', 0)"
    decoded = (f"array_join(transform({tokens}, k -> CASE WHEN left(k, 1) <> '&' OR k = '&' THEN k "
               f"WHEN substr(k, 2, 1) = '#' THEN coalesce({point}, '\ufffd') ELSE coalesce(try_element_at({names}, k), "
               f"concat(try_element_at({names}, nullif(regexp_extract(k, {sql_text(_open_names())}, 0), '')), regexp_replace(k, {sql_text(_open_names())}, '')), k) END), '')")
    return (f"CASE WHEN NOT contains({v}, '&') THEN {v} "
            f"WHEN {v} rlike '&(?!(?:lt|gt|quot|#39|nbsp|apos|amp);)[#A-Za-z]' THEN {decoded} ELSE {plain} END")


def unescape(value: Column) -> Column:
    """HTML entities to characters in a single pass: numeric ones and the HTML 4 names."""
    return apply_sql(value, _unescape_sql())


@lru_cache(maxsize=1)
def _longer_names() -> str:
    """Pattern of the names beyond HTML 4 that begin with one that holds without a semicolon."""
    known, opened = _entity_names(), re.compile(_open_names())
    return "^(?:" + "|".join(sorted("&" + n for n in html.entities.html5 if "&" + n not in known and opened.match("&" + n))) + ")$"


def _beyond_sql(v: str) -> str:
    """SQL text: does the text bound to ``v`` hold a name that :func:`unescape` does not resolve as HTML 5 does?

    A name without an HTML 4 name in front may be any of HTML 5, so it counts; behind one it must be a longer name of HTML 5.
    """
    packed = "\x02".join(f"{k}\x01" for k in _entity_names())
    names = f"str_to_map({sql_text(packed)}, '\x02', '\x01')"
    tokens = f"array_distinct(regexp_extract_all({v}, '&[A-Za-z][A-Za-z0-9]*;?', 0))"
    return (f"contains({v}, '&') AND exists({tokens}, k -> NOT map_contains_key({names}, k) "
            f"AND (NOT k rlike {sql_text(_open_names())} OR k rlike {sql_text(_longer_names())}))")


def unescape_rows(df: DataFrame, name: str) -> DataFrame:
    """Every HTML 5 entity of a column, in one scan; Python sees only texts with a name beyond HTML 4."""
    value = F.col(name)
    beyond = apply_sql(F.coalesce(value, F.lit("")), _beyond_sql("v"))
    rest = unescape_all(F.when(beyond, value))
    return df.withColumn(name, F.coalesce(rest, unescape(value)))


def clean_rows(df: DataFrame, name: str) -> DataFrame:
    """:func:`clean` of a column with every HTML 5 entity."""
    return unescape_rows(df, name).withColumn(name, tidy(F.col(name)))


# ------------------------------------------------------------------ cleaning
#: what :func:`clean` drops, and the horizontal white space it makes blanks, as plain characters
CONTROLS = "".join(map(chr, [*range(9), 0x0b, 0x0c, *range(0x0e, 0x20), 0x7f, 0x200b, 0xfeff]))
BLANKS = "".join(map(chr, [9, 0x85, 0xa0, 0x1680, *range(0x2000, 0x200b), 0x2028, 0x2029, 0x202f, 0x205f, 0x3000]))


#: What more than trimming has to change: any of those, a line end, or two blanks.
_UNTIDY = "[\\x00-\\x1f\\x7f\\x85\\xa0\\u1680\\u2000-\\u200b\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]|  "


def _tidy_sql(value: str) -> str:
    """SQL text of the white space rules; most texts need no more than one look and a trim."""
    return (f"transform(array({value}), w -> CASE WHEN w = '' THEN w WHEN w rlike {sql_text(_UNTIDY)} "
            f"THEN {_tidied_sql('w')} ELSE trim(w) END)[0]")


def _tidied_sql(text: str) -> str:
    # one look-up per character does what two patterns over all these characters did
    text = f"translate({text}, {sql_text(BLANKS + CONTROLS)}, {sql_text(' ' * len(BLANKS))})"
    for old, new in (("\r\n", "\n"), ("\r", "\n")):
        text = f"replace({text}, {sql_text(old)}, {sql_text(new)})"
    text = f"regexp_replace({text}, ' {{2,}}', ' ')"
    for old, new in ((" \n", "\n"), ("\n ", "\n")):
        text = f"replace({text}, {sql_text(old)}, {sql_text(new)})"
    return f"trim(BOTH {sql_text(' ' + chr(10))} FROM regexp_replace({text}, '\\\\n{{3,}}', '\n\n'))"


def tidy(value: Column) -> Column:
    """White space rules of :func:`clean` for text whose entities are already resolved."""
    return apply_sql(value, _tidy_sql("coalesce(v, '')"))


def clean_sql(name: str) -> str:
    """SQL text of :func:`clean` over a bound name that is not null."""
    return _tidy_sql(_unescape_sql(name))


def clean(value: Column) -> Column:
    """Unescape, drop control characters, collapse blanks, keep paragraphs; null to ''."""
    return apply_sql(F.coalesce(value, F.lit("")), clean_sql("v"))


def clean_or_null(value: Column) -> Column:
    return blank_to_null(clean(value))


def html_text(value: Column) -> Column:
    """HTML fragment to text: breaks and block tags become line breaks.

    This is the pattern route for well-formed fragments.  ``functions.markup`` has the
    exact route over parsed nodes.
    """
    blocks = "|".join(BLOCK_TAGS)
    attrs = "(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+"
    return let(value, lambda v: _fragment_text(v, blocks, attrs))


def _fragment_text(value: Column, blocks: str, attrs: str) -> Column:
    out = value
    for tag in ("script", "style", "noscript", "template"):
        out = F.regexp_replace(out, f"(?is)<{tag}\\b{attrs}>.*?</{tag}\\s*>", "")
    out = F.regexp_replace(out, "(?s)<!--.*?-->|<![^>]*>", "")
    out = F.regexp_replace(out, f"(?i)<br\\b{attrs}>", "\n")
    out = F.regexp_replace(out, f"(?i)</?(?:{blocks})\\b{attrs}>", "\n")
    out = F.regexp_replace(out, f"</?[A-Za-z]{attrs}>", "")
    return (F.when(value.isNull(), F.lit(""))
            .when(~F.contains(value, F.lit("<")), clean(value))
            .otherwise(clean(unescape(out))))


def label_text(value: Column) -> Column:
    """A detail label or value: direction marks out, blanks collapsed, colon trimmed."""
    out = F.regexp_replace(F.coalesce(value, F.lit("")),
                           "[‎‏​‪-‮﻿]", "")
    out = F.trim(F.regexp_replace(out, f"[{SPACES}\\r\\n]+", " "))
    return F.trim(F.regexp_replace(out, ":+$", ""))


def drop_read_more(value: Column) -> Column:
    return F.regexp_replace(value, "\\s*Read (?:more|less)\\s*$", "")


def drop_screen_reader_phrase(value: Column) -> Column:
    return F.trim(F.regexp_replace(
        value, "(?i)(?:brief|full) content visible, double tap to read (?:full|brief) content\\.\\s*",
        ""))


def drop_bold_marks(value: Column) -> Column:
    return F.regexp_replace(value, "\\*{2,}", "")


def utf8_lines(value: Column) -> Column:
    """What a text file holds: valid UTF-8, ``\\n`` line ends, one closing newline."""
    body = F.regexp_replace(F.make_valid_utf8(value), "\\r\\n?", "\n")
    body = F.regexp_replace(body, "^\\s+|\\s+$", "")
    return F.when(body != "", F.concat(body, F.lit("\n"))).otherwise(F.lit(""))


# ------------------------------------------------------------------ folding
@lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, dict[str, str]]:
    """(from, to) for ``translate`` and the few characters that fold to several.

    Built from the Unicode database by one rule: decompose, drop combining marks, casefold.
    A character that leaves no ASCII letter or digit needs no entry, since everything else
    becomes a blank anyway.
    """
    single, gone, several = [], [], {}
    for point in range(0x80, 0x30000):  # nothing beyond decomposes
        if 0xAC00 <= point <= 0xD7A3 or 0xD800 <= point <= 0xDFFF:
            continue
        char = chr(point)
        if unicodedata.category(char) in ("Cn", "Co", "Lo", "So") and not unicodedata.decomposition(char):
            continue
        bare = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
        text = "".join(c if c.isascii() and (c.isalnum() or c == " ") else " " for c in bare.casefold())
        if bare == "":
            gone.append(char)
        elif len(text) == 1 and text != " ":
            single.append((char, text))
        elif text.strip():
            several[char] = text
    source = "".join(c for c, _ in single) + "".join(gone)
    return source, "".join(t for _, t in single), several


@lru_cache(maxsize=1)
def _fold_sql() -> str:
    source, target, several = _fold_tables()
    packed = "\x02".join(f"{k}\x01{c}" for k, c in several.items())
    rare = sql_text("".join(several))
    # the rare characters that fold to several letters, where any is left
    spread = (f"transform(array(translate(replace(v, 'ß', 'ss'), {sql_text(source)}, {sql_text(target)})), p -> "
              f"CASE WHEN octet_length(p) = length(p) OR length(translate(p, {rare}, '')) = length(p) THEN p "
              f"ELSE aggregate(map_entries(str_to_map({sql_text(packed)}, '\x02', '\x01')), p, (acc, e) -> replace(acc, e.key, e.value)) END)[0]")
    narrowed = f"CASE WHEN octet_length(v) = length(v) THEN v ELSE {spread} END"
    return f"trim(regexp_replace(lower({narrowed}), '[^a-z0-9]+', ' '))"


def fold(value: Column) -> Column:
    """Comparison key: accents off, lower case, ``[a-z0-9 ]`` only, single blanks."""
    return apply_sql(F.coalesce(value, F.lit("")), _fold_sql())


def main_part(value: Column) -> Column:
    """The folded title without its subtitle."""
    return fold(F.get(F.split(F.coalesce(value, F.lit("")), SUBTITLE_PATTERN, 2), 0))


def squash(value: Column) -> Column:
    """Lower case with everything but ``[0-9a-z]`` removed (origin keys)."""
    return F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), "[^0-9a-z]+", "")


def casefold(value: Column) -> Column:
    return F.lower(F.replace(value, F.lit("ß"), F.lit("ss")))


# ------------------------------------------------------------------ titles and people
def tokens(folded: Column) -> Column:
    return keep_nonblank(F.split(folded, " "))


def is_sequel(left_folded: Column, right_folded: Column) -> Column:
    """Same length, one differing token, and that token is a different ordinal."""
    ordinals = literal_map(ORDINALS)

    def judge(left: Column, right: Column) -> Column:
        pairs = F.filter(F.zip_with(left, right, lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
                         lambda p: p["a"] != p["b"])
        a = F.try_element_at(ordinals, F.get(pairs, 0)["a"])
        b = F.try_element_at(ordinals, F.get(pairs, 0)["b"])
        return F.coalesce((F.size(left) == F.size(right)) & (F.size(pairs) == 1) & (a != b),
                          F.lit(False))

    return let(tokens(left_folded), lambda l: let(tokens(right_folded), lambda r: judge(l, r)))


def is_derivative(candidate_folded: Column, wanted_folded: Column) -> Column:
    """A study-guide or box-set marker that the wanted title does not itself carry."""
    return F.exists(literal_array(DERIVATIVE_MARKERS),
                    lambda m: F.contains(candidate_folded, m) & ~F.contains(wanted_folded, m))


def surname_of(folded: Column) -> Column:
    """Last token longer than two characters, '' when there is none."""
    return F.coalesce(F.try_element_at(F.filter(F.split(folded, " "), lambda t: F.length(t) > 2),
                                       F.lit(-1)), F.lit(""))


def authors_agree(wanted: Column, found: Column, whole_tokens: bool = False) -> Column:
    """True when any wanted author plausibly names an author found; empty sides agree.

    ``whole_tokens`` is the stricter reading: a name must start and end at a word edge.
    """
    edge = F.lit(" ") if whole_tokens else F.lit("")

    def inside(name: Column, text: Column) -> Column:
        return F.contains(F.concat(edge, text, edge), F.concat(edge, name, edge))

    def judge(keys: Column, targets: Column) -> Column:
        joined = F.array_join(targets, " ")
        hit = F.exists(keys, lambda k: inside(k, joined)
                       | ((surname_of(k) != "") & inside(surname_of(k), joined)))
        return (F.size(keys) == 0) | (F.size(targets) == 0) | hit

    def folded(names: Column) -> Column:
        return keep_nonblank(F.transform(F.coalesce(names, F.array().cast("array<string>")), fold))

    return let(folded(wanted), lambda k: let(folded(found), lambda t: judge(k, t)))


def slug(value: Column) -> Column:
    """ASCII slug: accents off, '&' spelled out, the rest to single dashes."""
    return let(F.coalesce(value, F.lit("")), _slug)


def _slug(text: Column) -> Column:
    source, target = _slug_tables()
    ascii_text = F.when(F.octet_length(text) == F.length(text), text).otherwise(
        F.regexp_replace(F.translate(text, source, target), "[^\\x00-\\x7f]+", ""))
    dashed = F.regexp_replace(F.replace(ascii_text, F.lit("&"), F.lit(" and ")), "[^A-Za-z0-9]+", "-")
    return F.lower(F.regexp_replace(dashed, "^-+|-+$", ""))


@lru_cache(maxsize=1)
def _slug_tables() -> tuple[str, str]:
    """Characters whose compatibility decomposition has exactly one ASCII character."""
    pairs = []
    for point in range(0x80, 0x2FFFF):
        char = chr(point)
        if unicodedata.decomposition(char):
            kept = "".join(c for c in unicodedata.normalize("NFKD", char) if c.isascii())
            if len(kept) == 1:
                pairs.append((char, kept))
    return "".join(c for c, _ in pairs), "".join(t for _, t in pairs)


def plain_slug(value: Column) -> Column:
    """The simpler slug of a shop that does not spell out '&'."""
    return F.regexp_replace(F.regexp_replace(F.lower(value), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def title_variants(title: Column) -> Column:
    """Full title, head before the subtitle, first three words, first long word."""
    from .lists import dedupe

    def build(text: Column) -> Column:
        head = F.trim(F.get(F.split(text, SUBTITLE_PATTERN, 2), 0))
        words = keep_nonblank(F.split(text, "\\s+"))
        first = F.get(words, 0)
        return F.filter(F.array(
            text,
            F.when((head != "") & (head != text), head),
            F.when(F.size(words) > 3, F.array_join(F.slice(words, 1, 3), " ")),
            F.when(F.length(first) >= 4, first)), lambda x: x.isNotNull())

    return dedupe(let(title, build))


def author_variants(authors: Column) -> Column:
    """First author, then the first two joined with 'and'."""
    from .lists import dedupe

    def build(names: Column) -> Column:
        both = F.when(F.size(names) > 1, F.array_join(F.slice(names, 1, 2), " and "))
        return F.filter(F.array(F.get(names, 0), both), lambda x: x.isNotNull())

    return dedupe(let(keep_nonblank(F.transform(authors, clean)), build))


def search_title(title: Column) -> Column:
    """Title as a search term: tagline and numbered-series suffix off, 180 characters."""
    head = F.trim(F.get(F.split(title, "\\s+[–—]\\s+", 2), 0))
    bare = F.trim(F.regexp_replace(head, "\\s*\\([^()]*#\\s*\\d+[^()]*\\)\\s*$", ""))
    return F.substring(F.coalesce(F.nullif(bare, F.lit("")), title), 1, 180)


def flip_name(parts: Column) -> Column:
    """``[Last, First]`` to ``[First Last]`` when there are exactly two short parts."""
    short = F.forall(parts, lambda p: F.size(F.split(p, "\\s+")) <= 3)
    flipped = F.array(F.concat_ws(" ", F.get(parts, 1), F.get(parts, 0)))
    return F.when((F.size(parts) == 2) & short, flipped).otherwise(parts)


# ------------------------------------------------------------------ prose repairs
def drop_librarian_note(body: Column) -> Column:
    """Cut an editorial note: text before it, or the paragraph after a leading one."""
    mark = "(?i)Librarian'?s note\\s*:"
    trim = lambda c: F.regexp_replace(c, "^\\s+|\\s+$", "")

    def cut(text: Column) -> Column:
        at = F.regexp_instr(text, F.lit(mark))
        before = trim(F.get(F.split(text, mark, 2), 0))
        after = F.get(F.split(text, mark, 2), 1)
        has_break = after.rlike("\\n\\s*\\n")
        rest = F.when(has_break, F.get(F.split(after, "\\n\\s*\\n", 2), 1)).otherwise(
            F.coalesce(F.get(F.split(after, "\\n", 2), 1), after))
        later = trim(F.get(F.split(rest, mark, 2), 0))
        return (F.when(at == 0, text)
                .when(at > 1, F.coalesce(blank_to_null(before), text))
                .otherwise(F.coalesce(blank_to_null(later), text)))

    return let(body, cut)


def repair_repeated(body: Column) -> Column:
    """Cut prose where its own first line (40 characters or more) starts again."""

    def cut(text: Column) -> Column:
        first = F.get(F.split(text, "\\n", 2), 0)
        again = F.position(first, text, F.length(first) + 1)
        return F.when((F.length(first) >= 40) & (again > 0),
                      F.regexp_replace(F.substring(text, F.lit(1), again - 1),
                                       "^\\s+|\\s+$", "")).otherwise(text)

    return let(body, cut)


def with_heading(heading: Column, body: Column, stem_chars: int | None = None,
                 ignore_case: bool = True) -> Column:
    """Put a review heading above its text unless the text already starts with it."""
    def join(title: Column, text: Column) -> Column:
        stem = F.regexp_replace(title, "[. ]+$", "") if stem_chars else title
        stem = F.substring(stem, 1, stem_chars) if stem_chars else stem
        left, right = (casefold(text), casefold(stem)) if ignore_case else (text, stem)
        return (F.when((F.coalesce(title, F.lit("")) == "") | F.startswith(left, right), text)
                .otherwise(F.concat(title, F.lit("\n\n"), text)))

    return let(heading, lambda h: let(body, lambda b: join(h, b)))


# ------------------------------------------------------------------ small renderings
def language_name(raw: Column) -> Column:
    """Language code to English name; a spelled-out name is kept, all-lower is capitalised."""

    def name(found: Column) -> Column:
        coded = (F.length(found) <= 5) | found.rlike("[-_]")
        primary = F.lower(F.get(F.split(found, "[-_]"), 0))
        lower_only = (found == F.lower(found)) & (found != F.upper(found))
        return (F.when(found == "", F.lit(None).cast("string"))
                .when(coded, F.coalesce(lookup(LANGUAGE_NAMES, primary), found))
                .when(lower_only, F.initcap(found)).otherwise(found))

    return let(F.trim(F.coalesce(raw, F.lit(""))), name)


def catalogue_language(key: Column) -> Column:
    """``/languages/eng`` to a name, unknown codes unchanged."""
    code = F.element_at(F.split(key, "/"), -1)
    return F.coalesce(lookup(CATALOGUE_LANGUAGES, F.lower(code)), code)


def rating_text(number: Column) -> Column:
    """A whole number of stars as ``n/5``; zero is no rating."""
    whole = number.try_cast("bigint")
    return F.when(whole != 0, F.concat(whole.cast("string"), F.lit("/5")))


def composite_rating(overall: Column, story: Column, performance: Column) -> Column:
    part = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.concat_ws(", ", F.concat(part(overall), F.lit("/5 overall")),
                       F.concat(F.lit("story "), part(story), F.lit("/5")),
                       F.concat(F.lit("performance "), part(performance), F.lit("/5")))


def duration_text(seconds: Column) -> Column:
    """``5593.2`` to ``1h33m13s``; halves round to even."""
    total = F.bround(F.greatest(F.lit(0.0), seconds.cast("double")), 0).cast("bigint")
    hours, minutes, secs = F.floor(total / 3600), F.floor(F.pmod(total, F.lit(3600)) / 60), F.pmod(total, F.lit(60))
    return (F.when(hours > 0, F.format_string("%dh%02dm%02ds", hours, minutes, secs))
            .when(minutes > 0, F.format_string("%dm%02ds", minutes, secs))
            .otherwise(F.format_string("%ds", secs)))


def file_name(isbn13: Column, kind_infix: str, source: Column, n: Column, ext: Column) -> Column:
    stem = F.concat_ws("_", safe_isbn(isbn13), F.lit(kind_infix), safe_source(source),
                       F.greatest(F.lit(1), n).cast("string"))
    return F.concat(stem, F.lit("."), ext)


def safe_isbn(isbn13: Column) -> Column:
    from .isbn import safe_segment
    return safe_segment(isbn13, "isbn")


def safe_source(source: Column) -> Column:
    from .isbn import safe_segment
    return safe_segment(source, "source")
