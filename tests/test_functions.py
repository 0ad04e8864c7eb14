from pyspark.sql import functions as F

from tomeweave.functions import dates, isbn, lists, markup, payload, text, urls
from tomeweave.functions.arrow import bracket_block, parse_nodes, unescape_all


def test_isbn_both_directions(apply):
    assert apply(isbn.to_isbn13, "0143127551", "978-0-14-312755-0", "0062316095") == ["9780143127550", "9780143127550", "9780062316097"]
    assert apply(isbn.to_isbn10, "9780143127550", "9780062316097") == ["0143127551", "0062316095"]
    assert apply(isbn.normalize, " isbn-10: 0-306-40615-x ", "ISBN 13=978–0−14") == ["030640615X", "978014"]
    assert apply(isbn.to_isbn10, "9791234567896") == [None]
    assert apply(isbn.is_valid, "", "abc", "12345", "9780143127551", "0143127552", "1230143127550") == [False] * 6


def test_isbn_reasons(spark):
    df = spark.createDataFrame([("9780143127551",), ("abc",), ("",), ("1230143127550",), ("01431275X1",)], "r string")
    df = df.withColumn("c", isbn.normalize(F.col("r")))
    got = [r[0] for r in df.select(isbn.reason_of(F.col("r"), "c")).collect()]
    assert got == ["'9780143127551' -> '9780143127551': check digit should be '0'", "'abc' -> 'ABC' is 3 characters; an ISBN is 10 or 13",
                   "no ISBN found in ''", "'1230143127550' -> '1230143127550': 13 digits must be numeric and start 978/979",
                   "'01431275X1' -> '01431275X1': an ISBN-10 is 9 digits then a digit or 'X'"]


def test_safe_segment(apply):
    for cleaned in apply(lambda c: isbn.safe_segment(c, "safe"), "../../etc/passwd", "..", ".", "", "a/b\\c"):
        assert "/" not in cleaned and "\\" not in cleaned and cleaned not in ("", ".", "..")


def test_clean_text(apply):
    assert apply(text.clean, "  a &amp;  b \r\n\n\n c ", None, "x&eacute;&#233;&#xE9;&hellip;&bogus; &amp;lt;", "a​\xa0b\x07", "&#0;&#x110000;&#55296;") == [
        "a & b\n\nc", "", "xééé…&bogus; &lt;", "a b", "���"]
    assert apply(unescape_all, "&lbrace;&eacute;", None) == ["{é", None]


def test_html_text(apply):
    assert apply(text.html_text, "<p>one</p><p>two<br>three</p><script>x()</script>", "no tags &lt;b&gt;", None) == ["one\n\ntwo\nthree", "no tags <b>", ""]


def test_fold_matches_unicode_rules(apply):
    import re
    import unicodedata

    def expected(value):
        plain = "".join(c for c in unicodedata.normalize("NFKD", value) if not unicodedata.combining(c))
        return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9 ]+", " ", plain.casefold()).strip()).strip()

    words = ["Brontë, C.", "ﬁne Straße ⅫIII ½", "Ⓐ日本 b", "ÀÉÎ", "Ångström ﬀ ẞ", "İstanbul", "x² + y³", "１２３ ａｂｃ", "é combined", "œuvre Æ ø", "№5 ℡"]
    assert apply(text.fold, *words) == [expected(w) for w in words]


def test_titles(apply):
    pair = lambda a, b: text.is_sequel(text.fold(a), text.fold(b))
    assert apply(pair, ("Ready Player One", "Ready Player Two"), ("Dune", "Dune Messiah"), ("Educated", "Educated"), ("Part One", "Part 1")) == [True, False, False, False]
    derivative = lambda a, b: text.is_derivative(text.fold(a), text.fold(b))
    assert apply(derivative, ("Study Guide: Educated by Tara Westover", ""), ("Summary of Sapiens", ""), ("Dune (Boxed Set)", ""), ("Educated: A Memoir", ""),
                 ("A Guide to Birdsong", "A Guide to Birdsong")) == [True, True, True, False, False]
    assert apply(lambda a: text.surname_of(text.fold(a)), "Celeste Ng", "Charlotte Brontë", "") == ["celeste", "bronte", ""]
    assert apply(text.search_title, "Dune (Dune #1)", "A — tagline") == ["Dune", "A"]
    assert apply(text.slug, "Reese's Book Club", "Tom & Jerry é") == ["reese-s-book-club", "tom-and-jerry-e"]


def test_authors_agree(apply):
    agree = lambda a, b: text.authors_agree(F.array(a), F.array(b))
    assert apply(agree, ("Celeste Ng", "celeste ng"), ("Charlotte Brontë", "Charlotte Bronte"), ("J.R.R. Tolkien", "John Ronald Reuel Tolkien"),
                 ("Celeste Ng", "Ajay K Pandey"), ("", "Anyone"), ("Stephen King", "A Viking")) == [True, True, True, False, True, True]
    strict = lambda a, b: text.authors_agree(F.array(a), F.array(b), whole_tokens=True)
    assert apply(strict, ("Stephen King", "A Viking"), ("Stephen King", "King, Stephen")) == [False, True]


def test_languages(apply):
    assert apply(text.language_name, "en", "en-GB", "eng", "fre", "ger", "chi", "dut", "english", "Portuguese", "xyz", "", None) == [
        "English", "English", "English", "French", "German", "Chinese", "Dutch", "English", "Portuguese", "xyz", None, None]
    assert apply(text.catalogue_language, "/languages/fre", "/languages/xyz") == ["French", "xyz"]


def test_prose_repairs(apply):
    assert apply(text.drop_librarian_note, "Librarian's note: x\n\nReal text", "Body. Librarian's note: y", "none") == ["Real text", "Body.", "none"]
    line = "A" * 45
    assert apply(text.repair_repeated, f"{line}\nsecond {line} tail") == [f"{line}\nsecond"]
    assert apply(text.utf8_lines, "a\r\nb ", " ") == ["a\nb\n", ""]
    assert apply(lambda s: text.duration_text(s.cast("double")), "93.4", "3725", "12", "-1") == ["1m33s", "1h02m05s", "12s", "0s"]


def test_lists(apply):
    assert apply(lists.split_list, "Fiction, Fantasy & Young Adult", "a and b / A|c", None) == [["Fiction", "Fantasy", "Young Adult"], ["a", "b", "c"], []]
    assert apply(lambda a, b, c: lists.dedupe(F.array(a, b, c)), ("Fiction", " fiction ", "Classics")) == [["Fiction", "Classics"]]
    assert apply(lambda a: payload.list_or_text(payload.loads(a), "g"), '{"g":[{"name":"Fiction"},"fiction "]}', '{"g":"x & y"}', '{"g":{"name":"Solo"}}') == [["Fiction"], ["x", "y"], ["Solo"]]


def test_dates(apply):
    raw = ["January 5, 2016", "June 2016", "2016", "Published: 5th January 2016", "2016-01-05", "sometime soon", "", None, "01/02/2016", "02/13/2016",
           "2016-1-5", "2016/3/4", "on 5 Jan 2016 x", "Feb 31, 2016", "2016-7", "99/99/2016"]
    assert apply(dates.iso_date, *raw) == ["2016-01-05", "2016-06", "2016", "2016-01-05", "2016-01-05", "sometime soon", None, None, "2016-02-01", "2016-02-13",
                                           "2016-01-05", "2016-03-04", "2016-01-05", "2016-02", "2016-07", "2016"]
    assert apply(dates.us_short_date, "10-07-14", "10-07-71") == ["2014-10-07", "1971-10-07"]
    assert apply(dates.published_date, "1400000000000", "1400050800000", "x") == ["2014-05-13", "2014-05-14", None]
    assert apply(dates.reviewed_on, "Reviewed in the United States on July 5, 2022") == ["July 5, 2022"]


def test_urls(apply):
    join = lambda u: urls.absolute(F.lit("https://x.com/a/b?q"), u)
    assert apply(join, "/c", "d", "../e", "//h/p", "#x", "javascript:1", "http://z/y", "?k=1", "./f/../g") == [
        "https://x.com/c", "https://x.com/a/d", "https://x.com/e", "https://h/p", "", "", "http://z/y", "https://x.com/a/b?k=1", "https://x.com/a/g"]
    assert apply(urls.host_of, "HTTPS://User@Ex.com:80/x", "bad") == ["ex.com", ""]
    assert apply(lambda u: urls.full_size("bookbub", u), "https://res/upload/w_300,c_fill/v123/a.jpg", "https://res/upload/a.jpg") == ["https://res/upload/v123/a.jpg", "https://res/upload/a.jpg"]
    assert apply(lambda u: urls.full_size("goodreads", u), "https://i.gr.com/books/123s/45._SY75_.jpg") == ["https://i.gr.com/books/123i/45.jpg"]
    assert apply(lambda u: urls.image_key("audible", u), "https://m/images/I/51x._SL5_.jpg", "https://m/images/I/51x_CLa.jpg") == ["51x", ""]


def test_jsonld_and_origin(apply):
    page = '<script type="application/ld+json">{"@graph":[{"@type":"Book","name":"B"},{"@type":"Person","name":"P"}]}</script>'
    assert apply(lambda h: F.transform(payload.jsonld(h, ["Book"]), lambda n: payload.raw_text(n, "name")), page) == [["B"]]
    assert apply(lambda h: F.size(payload.jsonld(h)), page) == [3]
    keys = ["eligibleRegion", "ineligibleRegion", "regionsAllowed", "priceCurrency", "datePublished", "publisher"]
    assert apply(lambda j: payload.origin_in(payload.loads(j)), '{"work":{"publish_places":["London"]}}', *[f'{{"{k}":"United States"}}' for k in keys]) == ["London"] + [None] * 6
    assert apply(lambda j: F.to_json(payload.loads(j)), '{"a":1,}', '{"a":1,"a":2}', "bad") == ['{"a":1}', '{"a":2}', None]


def test_markup(spark):
    page = ('<html><head><title>T &amp; U</title><meta name="x" content="n"><meta property="x" content="p"></head><body><div class="a b"><p>one<p>two<br>x</div>'
            '<ul><li>1<li>2</ul><table><tr><th>Country of Origin ‏ : ‎</th><td>United Kingdom</td></tr></table><script>var x="<b>"</script></body></html>')
    df = spark.createDataFrame([(page,), (None,)], "h string").select(parse_nodes("h").alias("n"))
    n, el = F.col("n"), markup.el
    row = df.select(markup.sel(n, [el("h9")], [el("title")]), markup.meta(n, "x"),
                    F.transform(markup.select(n, el("div", "a"), el("p")), lambda x: markup.text_of(n, x)), markup.sels(n, [el("li")]),
                    markup.origin_of(n), markup.raw_text_of(n, markup.first(markup.select(n, el("script"))))).collect()
    assert list(row[0]) == ["T & U", "p", ["one", "two\nx"], ["1", "2"], "United Kingdom", 'var x="<b>"']
    assert row[1][0] is None


def test_bracket_block(apply):
    assert apply(bracket_block, '[{"a":"]"},[1]] tail', "['x]'] y", "[1") == ['[{"a":"]"},[1]]', "['x]']", None]


def test_every_entity_equals_the_standard_library(spark):
    import html

    cases = [f"a&{name} b" for name in html.entities.html5]
    cases += [f"x&#{i};y" for i in [*range(300), 0xd800, 0xfdd0, 0xfffe, 0x10ffff, 0x110000, 99999999999]] + [f"x&#x{i:x}y&amp;#65;" for i in range(120, 170)]
    cases += ["&notit; &lbrace;&comma;&NewLine;&ampx &unknown; & &; &# &#x", "&AMP;&copy2;", "", None]
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, c string")
    got = {r["i"]: r["c"] for r in text.unescape_rows(rows, "c").collect()}
    assert [got[i] for i in range(len(cases))] == [c if c is None else html.unescape(c) for c in cases]


def test_white_space_rules_equal_patterns(spark):
    """Drop, blank, join and trim as the five patterns do, on random runs of every character concerned."""
    import random
    import re

    rng, wide = random.Random(3), "\t\x85\xa0\u1680\u2000\u2005\u200a\u2028\u2029\u202f\u205f\u3000"
    letters = list(wide + "\x00\x01\x08\x0b\x0c\x0e\x1f\x7f\u200b\ufeff\u200cé") + [" ", "\n", "\r", "\r\n", "a"] * 5
    cases = ["".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(800)] + ["", " \n ", "a\r\x07\nb", "x" * 50_000 + "  "]

    def plain(s):
        s = re.sub("[\u200b\ufeff\x00-\x08\x0b\x0c\x0e-\x1f\x7f]+", "", s)
        s = re.sub(f"[{wide}\u2000-\u200a ]+", " ", re.sub("\r\n?", "\n", s))
        return re.sub("\n{3,}", "\n\n", re.sub(" ?\n ?", "\n", s)).strip(" \n")

    rows = spark.createDataFrame(list(enumerate(cases)) + [(len(cases), None)], "i int, c string")
    got = {r["i"]: r["t"] for r in rows.select("i", text.tidy(F.col("c")).alias("t")).collect()}
    assert [got[i] for i in range(len(cases))] == [plain(c) for c in cases] and got[len(cases)] == ""


def test_plain_pages_are_read_as_the_standard_parser_reads_them():
    import random

    from tomeweave.functions import arrow

    class Standard(arrow._Tokens):
        def _plain(self, page):
            return False

    draw = random.Random(7)
    bits = ["<", ">", "</", "/>", " ", "=", '"', "'", "a", "p", "script", "&amp;", "&", "x", "<p>", "</p>", '<a href="u&amp;v">', "<!--", "-->", "\n", "<li>", "</script>", "<script>", "b=1",
            "<br>", "\x00", "\xa0", "<!doctype html>", "<p b=2/>", "<A B='c' d>", "<title>", "</TITLE >"]
    pages = ["".join(draw.choices(bits, k=draw.randint(1, 14))) for _ in range(5000)]
    for page in pages:
        assert arrow._Tokens().nodes(page) == Standard().nodes(page), page
    assert sum(arrow._Tokens()._plain(page) for page in pages) > 500
    assert arrow._Tokens()._plain('<!DOCTYPE html><html><body class="a b" data-x=1><br/><script>if (a<b) "<p>"</script>t &amp; u</body></html>')


def test_few_pages_are_held_as_objects_at_once(spark, monkeypatch):
    import pyarrow as pa

    from tomeweave.functions import arrow
    sizes, whole = [], arrow._node_lists
    monkeypatch.setattr(arrow, "_node_lists", lambda part: sizes.append(len(part)) or whole(part))
    pages = pa.array(["<p>%d</p>" % i if i % 7 else None for i in range(300)])
    found = arrow.parse_nodes.func(pages)
    assert max(sizes) <= arrow._PAGES and found.to_pylist() == whole(pages).to_pylist() and found.null_count == 43
    assert len(arrow.parse_nodes.func(pages.slice(0, 0))) == 0


def test_meta_tags_are_looked_for_once_for_all_names(spark):
    pages = spark.createDataFrame([('<meta name="b" content="B"><meta itemprop="a" content="A  x">',), ('<p content="no" name="a">x</p>',), (None,)], "html string")
    found = markup.meta(F.col("nodes"), "a", "b", "c")
    assert [r.m for r in pages.select(parse_nodes("html").alias("nodes")).select(found.alias("m")).collect()] == ["A x", None, None]
    assert found._jc.toString().count("filter(nodes") == 1


def test_text_before_a_colon_is_an_origin_key_as_squashing_says(spark):
    texts = ["Place of Publication: Oslo", "Published in", "place-of--PUBLICATION :x", "Published in Oslo", ": Published in: x", "Published\nin\n", "1 published in: x",
             "Country/Region of Origin: Peru", "PubliK", "", "Publish placeé: x", "Publishplaces", "publishplace s:", "İ published in:"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    squashed = F.array_contains(F.lit(markup.ORIGIN_KEYS), text.squash(F.regexp_extract("t", "^[^:]*", 0)))
    rows = df.select("t", squashed.alias("a"), F.lower("t").rlike(markup._origin_label()).alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows]
    assert sum(r.a for r in rows) >= 6


def test_only_untidy_text_goes_through_the_white_space_rules(spark):
    texts = [None, "", " ", "a", " a b ", "a  b", "a\n", "\n a", "a\tb", "a b", "a​b", "a﻿", "a　", "a\x7fb", "a\r\n\r\n\r\nb", "é ß", "a \n b", "\x00"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(text.tidy(F.col("t")).alias("a"), F.expr(text._tidied_sql("coalesce(t, '')")).alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows]


def test_audiobook_and_ebook_pages_open_their_json_ld_once(spark, monkeypatch):
    from tomeweave.stores import audible, kobo
    pages = spark.createDataFrame([("9780000000002", None, "https://x.example/p", "<html></html>")], "isbn13 string, isbn10 string, url string, html string")
    read, calls = payload.jsonld_blocks, []
    monkeypatch.setattr(payload, "jsonld_blocks", lambda html: calls.append(1) or read(html))
    for shop in (audible, kobo):
        calls.clear()
        shop.to_records(pages)
        assert len(calls) == 1


def test_a_tag_that_pages_repeat_is_read_once(monkeypatch):
    from tomeweave.functions import arrow
    read, whole = [], arrow._read_tag
    monkeypatch.setattr(arrow, "_KNOWN", {})
    monkeypatch.setattr(arrow, "_read_tag", lambda m: read.append(m[0]) or whole(m))
    page = '<ul class="a"><li>1</li><li>2 &amp; 3</li></ul><a title="x > y">z</a>'
    rows = [arrow._Tokens().nodes(page) for _ in range(3)]
    # a value that holds the closing sign is no short text, and is read again
    assert rows[0] == rows[2] and sorted(set(read)) == sorted(set(read[:5]) | {"</a>"}) and len(read) == 8
    monkeypatch.setattr(arrow, "_KNOWN_TAGS", 2)
    assert arrow._Tokens().nodes(page) == rows[0] and len(arrow._KNOWN) <= 6


def test_a_costly_value_is_evaluated_once_where_blank_is_null(spark):
    from tomeweave.functions.core import blank_to_null, some
    df = spark.createDataFrame([("",), ("xbx",), (None,)], "c string")
    out = df.select(F.coalesce(F.when(F.col("c").isNull(), F.lit("none")), blank_to_null(F.regexp_replace("c", "x", ""))).alias("o"),
                    F.size(some(F.filter(F.split("c", "b"), lambda x: x != ""))).alias("s"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1
    assert [(r.o, r.s) for r in out.collect()] == [(None, None), ("b", 2), ("none", None)]


def test_tests_for_attributes_need_no_look_at_the_tag(spark):
    df = spark.createDataFrame([('<p id="a" class="x y">1</p><br id="ab"><i class="yx" z>2</i>text<p>3</p>',)], "html string").select(parse_nodes("html").alias("nodes"))
    found = lambda *a, **k: F.transform(markup.select(F.col("nodes"), markup.el(*a, **k)), lambda n: n["pos"])
    row = df.select(found(attrs={"id": "a"}).alias("a"), found(attrs={"id": "^a"}).alias("b"), found(cls="y").alias("c"), found(has=["z"]).alias("d"),
                    found(attrs={"id": ""}).alias("e"), found("p", attrs={"id": "~^$"}).alias("f"), found().alias("g")).first()
    assert [len(x) for x in row] == [1, 2, 1, 1, 2, 1, 4]
    assert ">= A" not in df.select(found(attrs={"id": "a"}))._jdf.queryExecution().optimizedPlan().toString()
