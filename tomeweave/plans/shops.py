"""The six source mappings, over pages and payloads that Spark writes from ``part`` rows.

Each derived page holds the fields in the places its source keeps them, with decoys beside
them; the oracle says from the same rows what must come back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import passes
from ..session import checkpoint_folder
from ..operators.skew import spread_rows
from ..operators.artefacts import fill_from_editions, prefer_named_image, sibling_editions
from ..stores import amazon, audible, bookbub, goodreads, kobo, openlibrary
from ..stores.common import cover_rows, review_rows
from ..stores.registry import map_sources
from .base import Catalog, Tables
from .derive import SOURCES_SQL, book_isbn13, fetch_log, sql_isbn13

catalog = Catalog()

_BASE_SQL = f"""b AS (SELECT p_partkey AS k, {sql_isbn13("p_partkey")} AS isbn13, p_name AS title, p_brand AS maker, lower(p_type) AS kind, p_size AS size,
   strftime(DATE '2001-01-01' + CAST(p_partkey % 5000 AS INTEGER), '%Y-%m-%d') AS day FROM part)"""


def _base(t: Tables) -> DataFrame:
    rows = spread_rows(t.part).withColumn("isbn13", book_isbn13("p_partkey"))
    return rows.selectExpr("p_partkey AS k", "isbn13", "concat('10-', p_partkey) AS isbn10", "p_name AS title", "p_brand AS maker", "lower(p_type) AS kind",
                           "p_size AS size", "date_add(date'2001-01-01', int(p_partkey % 5000)) AS day")


def _flat(records: DataFrame) -> DataFrame:
    """Comparable columns of mapped records."""
    covers = F.array_join(F.transform("covers", lambda c: F.array_join(c, " ")), "|")
    return records.select("isbn13", "title", F.array_join("authors", "|").alias("authors"), "publisher", "origin", "date_of_publication", "language",
                          F.array_join("genres", "|").alias("genres"), "blurb", covers.alias("covers"), F.size("reviews").alias("reviews"))


# ------------------------------------------------------------------ catalogue records
@catalog.query(f"""WITH {_BASE_SQL} SELECT isbn13, title, maker || '|Second & Co' AS authors, maker AS publisher, CASE WHEN size % 3 = 0 THEN maker || ' City' WHEN size % 3 = 1 THEN 'Oslo' END AS origin,
  day AS date_of_publication, CASE size % 2 WHEN 0 THEN 'French' ELSE 'xyz' END AS "language", kind || '|Fiction' AS genres, 'About ' || title || '.' AS blurb,
  CASE WHEN size % 4 = 0 THEN '' ELSE 'https://c.example/b/id/' || k + 1 || '-L.jpg?default=false https://c.example/b/id/' || k + 1 || '-S.jpg?default=false' END AS covers, 0 AS reviews
  FROM b WHERE k % 10 <> 9""")
def shop_openlibrary(t: Tables):
    return _flat(openlibrary.to_records(_catalogue_replies(t)))


def _catalogue_replies(t: Tables) -> DataFrame:
    reply = F.expr("""IF(k % 10 = 9, '{}', concat('{"ISBN:', IF(k % 2 = 0, isbn13, isbn10), '":{"title":"', title, ' ","authors":[{"name":"', maker, '"},{"name":"Second &amp; Co"},{"x":1}],"publishers":[{"name":"', maker,
        '"},{"name":"Other"}],"publish_date":"', date_format(day, 'MMMM d, yyyy'), '","subjects":[{"name":"', kind, '"},{"name":"Fiction"},{"name":"', upper(kind), '"}],"cover":{"large":"https://c.example/b/id/',
        IF(size % 4 = 0, -1, k + 1), '-L.jpg","small":"https://c.example/b/id/', IF(size % 4 = 0, -1, k + 1), '-S.jpg"}', IF(size % 3 = 0, concat(',"publish_places":[{"name":"', maker, ' City"}]'), ''), '}}'))""")
    edition = F.expr("""concat('{"languages":[{"key":"/languages/', IF(size % 2 = 0, 'fre', 'xyz'), '"}],"description":', IF(size % 5 = 0, concat('"About ', title, '."'),
        concat('{"type":"t","value":"About ', title, '."}')), IF(size % 3 = 1, ',"publish_country":"Oslo"', ',"priceCurrency":"USD"'), '}')""")
    return _base(t).select("isbn13", "isbn10", reply.alias("reply"), edition.alias("edition"))


# ------------------------------------------------------------------ pointer-cache pages
def _cache_pages(t: Tables) -> DataFrame:
    html = F.expr("""concat('<html><head><link rel="canonical" href="https://g.example/book/show/', k, '-x"><script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"apolloState":{',
        '"ROOT_QUERY":{"getBookByLegacyId({\\\\"legacyId\\\\":\\\\"', k, '\\\\"})":{"__ref":"Book:real"},"getReviews":{"edges":[{"node":{"__ref":"Review:b"}},{"node":{"__ref":"Review:a"}}]}},',
        '"Book:stub":{"__typename":"Book"},"Book:real":{"__typename":"Book","title":"', IF(size % 2 = 0, title, ''), '","titleComplete":"', title, '","work":{"__ref":"Work:1"},',
        '"primaryContributorEdge":{"node":{"__ref":"C:1"},"role":"Author"},"secondaryContributorEdges":[{"node":{"__ref":"C:2"},"role":"Illustrator"}],"imageUrl":"',
        IF(size % 3 = 0, 'https://i.example/nophoto/x.jpg', concat('https://i.example/books/', k, 's/', k, '._SY75_.jpg')), '","description":"About <b>', title, '</b>.<br>More.",',
        '"bookGenres":[{"genre":{"name":"', kind, '"}},{"genre":{"name":"Fiction"}}],"details":{"isbn13":"', isbn13, '","publisher":"', IF(size % 4 = 0, '', maker), '","publicationTime":', unix_millis(timestamp(day)) + 43200000,
        ',"language":{"name":"English"}}},"Work:1":{"legacyId":', k + 7, ',"details":{"places":["Mordor"]}},"C:1":{"name":"', maker, '"},"C:2":{"name":"Ill Ustrator"},"U:1":{"name":"Ann"},',
        '"Review:a":{"id":"ra","text":"short but long enough text","rating":4,"createdAt":1400000000000,"creator":{"__ref":"U:1"}},"Review:b":{"id":"rb","text":"a second review body here","rating":0,"createdAt":1400000000000,"creator":{"__ref":"U:1"}}',
        '}}}}</script><meta property="og:image" content="https://i.example/books/', k, 'z/og.jpg"></head><body><h1 data-testid="bookTitle">Decoy</h1></body></html>')""")
    return _base(t).select("isbn13", "isbn10", F.lit("https://g.example/book/isbn/x").alias("url"), html.alias("html"), F.lit(False).alias("fuzzy"), "k")


@catalog.query(f"""WITH {_BASE_SQL} SELECT isbn13, title, maker || '|Ill Ustrator (Illustrator)' AS authors, CASE WHEN size % 4 = 0 THEN 'Filled ' || k + 7 ELSE maker END AS publisher, CAST(NULL AS VARCHAR) AS origin,
  day AS date_of_publication, 'English' AS "language", kind || '|Fiction' AS genres, 'About ' || title || '.' || chr(10) || 'More.' AS blurb,
  CASE WHEN size % 3 = 0 THEN 'https://i.example/books/' || k || 'i/og.jpg' ELSE 'https://i.example/books/' || k || 'i/' || k || '.jpg' END AS covers, 2 AS reviews FROM b""")
def shop_goodreads(t: Tables):
    """Records from the cache, with the publisher a page lacks filled from the edition list."""
    records = goodreads.to_records(_cache_pages(t))
    editions = _base(t).selectExpr("string(k + 7) AS work_id", "1L AS pos", "concat('Filled ', k + 7) AS publisher", "'1999' AS date", "'Latin' AS language")
    return _flat(fill_from_editions(records, editions))


@catalog.query(f"""WITH {_BASE_SQL} SELECT isbn13, unnest([0, 1]) AS pos, unnest(['rb', 'ra']) AS review_id, unnest(['a second review body here', 'short but long enough text']) AS text,
  unnest([NULL, '4/5']) AS rating, 'Ann' AS reviewer, '2014-05-13' AS date FROM b""")
def shop_reviews(t: Tables):
    return review_rows(goodreads.to_records(_cache_pages(t))).select("isbn13", "pos", "review_id", "text", "rating", "reviewer", "date")


@catalog.query(f"""WITH {_BASE_SQL} SELECT k, CASE WHEN size % 2 = 0 THEN maker END AS publisher, CASE WHEN size % 2 = 0 THEN day END AS date, 'French' AS "language" FROM b""")
def edition_rows(t: Tables):
    html = F.expr("""concat('<div class="elementList clearFix"><div class="leftAlignedImage"><img src="/i.jpg"></div><div class="dataRow">', IF(size % 2 = 0, concat('Published ', date_format(day, 'MMMM d, yyyy'), ' by ', maker), 'Paperback'),
        '</div><div class="dataRow"><div class="dataTitle">Edition language:</div><div>French</div></div></div>')""")
    pages = _base(t).select(F.col("k").cast("string").alias("work_id"), F.lit(1).alias("page_no"), F.lit("https://g.example/work/editions/1").alias("url"), html.alias("html"))
    return goodreads.edition_rows(pages).select(F.col("work_id").cast("bigint").alias("k"), "publisher", "date", "language")


# ------------------------------------------------------------------ detail-table pages
def _detail_pages(t: Tables) -> DataFrame:
    html = F.expr("""concat('<html><head><title>Amazon.com: ', title, ' tag: ', isbn13, ': Ng, Celeste: Books</title><link rel="canonical" href="/dp/', lpad(k, 10, '0'), '?x=1"></head><body>',
        IF(size % 2 = 0, concat('<span id="productTitle"> ', title, ' </span>'), ''), IF(size % 3 = 0, concat('<div id="bylineInfo"><span class="author"><a class="a-link-normal" href="/e/B123456789">', maker, '</a></span></div>'),
        IF(size % 3 = 1, concat('<div id="bylineInfo"><a href="/author/x">', maker, ' Cut</a> Format: <a href="/author/y">Paperback</a></div>'), '')),
        '<div id="wayfinding-breadcrumbs_feature_div"><ul><li><span class="a-list-item"><a>Books</a></span></li><li><span class="a-list-item"><a>', kind, '</a></span></li></ul></div>',
        '<table class="prodDetTable"><tr><th>Publisher</th><td>Table Press</td></tr><tr><th>Language</th><td>English</td></tr>', IF(size % 4 = 0, '<tr><th>Country of Origin</th><td>Peru</td></tr>', ''), '</table>',
        '<div id="detailBullets_feature_div"><ul><li><span class="a-list-item"><span class="a-text-bold">Publisher &rlm; : &lrm;</span> <span>', maker, '</span></span></li><li><span class="a-list-item"><span class="a-text-bold">Publication date :</span><span>',
        date_format(day, 'MMMM d, yyyy'), '</span></span></li><li><span class="a-list-item"><span class="a-text-bold">Best Sellers Rank:</span><span>#1 in <a>Fantasy (Books)</a> (<a>See Top 100 in Books</a>)</span></span></li></ul></div>',
        '<div id="bookDescription_feature_div"><span>About ', title, ', in a line that is long enough</span><span><br><br>So begins. Read more</span></div>',
        '<script>P.register({''colorImages'': { ''initial'': [{"hiRes":null,"large":"https://m.example/I/81A', k, '._SL500_.jpg"},{"hiRes":"https://m.example/I/81A', k, '.jpg"},{"hiRes":"https://m.example/I/81B]', k, '.jpg"}]}});</script>',
        '<div data-hook="review" id="R1"><span class="a-profile-name">Ann</span><i data-hook="review-star-rating"><span class="a-icon-alt">4.0 out of 5 stars</span></i><span data-hook="review-title">Great</span><span data-hook="review-date">Reviewed in France on July 5, 2022</span><span data-hook="review-body">Brief content visible, double tap to read full content. Liked it</span></div>',
        '<div id="tmmSwatches"><div id="tmm-grid-swatch-PAPERBACK"><a href="/dp/P">p</a></div><div id="tmm-grid-swatch-HARDCOVER"><a href="/dp/H">h</a></div><div id="tmm-grid-swatch-KINDLE"><a href="/dp/K">k</a></div><div id="tmm-grid-swatch-MASS_PAPERBACK"><a href="javascript:void(0)">m</a></div></div></body></html>')""")
    return _base(t).select("isbn13", "isbn10", F.lit("https://www.amazon.com/dp/0000000000").alias("url"), html.alias("html"))


@catalog.query(f"""WITH {_BASE_SQL} SELECT isbn13, CASE WHEN size % 2 = 0 THEN title ELSE title || ' tag' END AS title, CASE size % 3 WHEN 0 THEN maker WHEN 1 THEN maker || ' Cut' ELSE 'Celeste Ng' END AS authors, maker AS publisher,
  CASE WHEN size % 4 = 0 THEN 'Peru' END AS origin, day AS date_of_publication, 'English' AS "language", kind || '|Fantasy' AS genres,
  'About ' || title || ', in a line that is long enough' || chr(10) || chr(10) || 'So begins.' AS blurb, 'https://m.example/I/81A' || k || '.jpg|https://m.example/I/81B]' || k || '.jpg' AS covers, 1 AS reviews FROM b""")
def shop_amazon(t: Tables):
    return _flat(amazon.to_records(_detail_pages(t)))


@catalog.query(f"""WITH {_BASE_SQL} SELECT isbn13, 'R1' AS review_id, 'Great' || chr(10) || chr(10) || 'Liked it' AS text, 'Ann' AS reviewer, '4.0 out of 5 stars' AS rating, '2022-07-05' AS date,
  'https://www.amazon.com/gp/customer-reviews/R1' AS url FROM b""")
def shop_page_reviews(t: Tables):
    return review_rows(amazon.to_records(_detail_pages(t))).select("isbn13", "review_id", "text", "reviewer", "rating", "date", "url")


@catalog.query(f"""WITH {_BASE_SQL} SELECT isbn13 AS page_id, unnest(['https://www.amazon.com/dp/H', 'https://www.amazon.com/dp/P']) AS url, unnest(['HARDCOVER', 'PAPERBACK']) AS format FROM b""")
def sibling_links(t: Tables):
    return sibling_editions(amazon.sibling_links(_detail_pages(t))).select("page_id", "url", "format")


@catalog.query(f"""WITH {_BASE_SQL} SELECT isbn13, CASE size % 4 WHEN 0 THEN 'isbn' WHEN 1 THEN 'mismatch' WHEN 2 THEN 'fuzzy' ELSE 'isbn' END AS verdict FROM b""")
def page_verdicts(t: Tables):
    """Identity by identifier: the page's own code, another one, none, or one in the title tag."""
    bullet = F.expr("""CASE size % 4 WHEN 0 THEN concat('<li><span class="a-list-item"><span class="a-text-bold">ISBN-13 :</span><span>978-', substr(isbn13, 4, 10), '</span></span></li>')
        WHEN 1 THEN '<li><span class="a-list-item"><span class="a-text-bold">ISBN-10 :</span><span>0143127551</span></span></li>' ELSE '' END""")
    head = F.expr("IF(size % 4 = 3, concat('<title>Amazon.com: ', title, ': ', isbn13, ': A: Books</title>'), '<title>x</title>')")
    html = F.concat(F.lit("<html>"), head, F.lit('<div id="detailBullets_feature_div"><ul>'), bullet, F.lit("</ul></div></html>"))
    pages = _base(t).select("isbn13", F.lit(None).cast("string").alias("isbn10"), F.lit("https://www.amazon.com/dp/X").alias("url"), html.alias("html"))
    return amazon.load(pages).select("isbn13", amazon.verdict().alias("verdict"))


# ------------------------------------------------------------------ attribute-payload pages
@catalog.query(f"""WITH {_BASE_SQL} SELECT isbn13, title || ': Sub' AS title, maker || '|Dom Author' AS authors, CASE WHEN size % 2 = 0 THEN maker ELSE 'Row Press' END AS publisher, CASE WHEN size % 4 = 0 THEN 'Kyiv' END AS origin,
  day AS date_of_publication, CASE WHEN size % 3 = 0 THEN 'Dutch' ELSE 'English' END AS "language", CASE WHEN size % 2 = 0 THEN kind || '|Fiction' ELSE kind END AS genres, 'About it.' || chr(10) || chr(10) || 'More.' AS blurb,
  'https://cdn.kobo.com/book-images/01234567-89ab-cdef-0123-' || lpad(CAST(k AS VARCHAR), 12, '0') || '/1200/1200/100/False/cover.jpg' AS covers, 1 AS reviews FROM b""")
def shop_kobo(t: Tables):
    inner = F.expr("""concat('{"name":"', title, '","author":[{"name":"', maker, '"}],"publisher":{"name":"', IF(size % 2 = 0, maker, ''), '"},"inLanguage":"en-GB",', IF(size % 2 = 0, concat('"genre":["', kind, '","Fiction"],'), ''),
        '"workExample":{"alternativeHeadline":"Sub","datePublished":"', day, 'T00:00:00Z","image":"https://k.example/book-images/01234567-89AB-cdef-0123-', lpad(k, 12, '0'), '/353/569/90/False/x.jpg"', IF(size % 4 = 0, ',"publicationPlace":"Kyiv"', ''), '}}')""")
    outer = F.concat(F.lit('{"googleBook":'), F.to_json(F.struct(inner.alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(inner.alias("v")))) - 6), F.lit(',"googleProduct":{}}'))
    escaped = F.replace(F.replace(outer, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))
    rest = F.expr("""concat('<div class="bookitem-secondary-metadata"><ul><li>Row Press</li><li>Release Date: May 1, 1990</li>', IF(size % 3 = 0, '<li>Language: Dutch</li>', ''), '</ul></div>',
        '<span class="authors product-field"><ul><li><a class="contributor-name">', upper(maker), '</a></li><li><a class="contributor-name">Dom Author</a></li><li><span class="mobile-library-tag">Narrator</span><a class="contributor-name">Voice</a></li></ul></span>',
        '<script type="application/ld+json">{"@type":"BreadcrumbList","itemListElement":[{"item":{"name":"Home"}},{"item":{"name":"', kind, '"}},{"name":"', title, '"}]}</script>',
        '<div class="synopsis-description"><p>About **it**.</p><p>More.</p></div><div class="review-item"><h2 class="review-title">Fine</h2><p class="review-text">Fine read</p><span class="review-author">Bo</span></div><div class="review-item"><h2 class="review-title">Only title</h2></div>')""")
    html = F.concat(F.lit('<html><div data-kobo-gizmo="RatingAndReviewWidget" data-kobo-gizmo-config="'), escaped, F.lit('"></div>'), rest, F.lit("</html>"))
    return _flat(kobo.to_records(_base(t).select("isbn13", "isbn10", F.lit("https://www.kobo.com/us/en/ebook/x").alias("url"), html.alias("html"))))


# ------------------------------------------------------------------ audiobook pages
@catalog.query(f"""WITH {_BASE_SQL} SELECT isbn13, title, CASE WHEN size % 2 = 0 THEN maker || '|Co Writer' ELSE 'Comp Writer' END AS authors, CASE WHEN size % 2 = 0 THEN maker ELSE 'Comp Audio' END AS publisher, CAST(NULL AS VARCHAR) AS origin,
  CASE WHEN size % 2 = 0 THEN day ELSE '2014-10-07' END AS date_of_publication, 'English' AS "language", kind || '|Theme One|Cat One' AS genres, 'About ' || title || '.' AS blurb,
  'https://m.example/images/I/51x' || k || '._SL500_.jpg' AS covers, 2 AS reviews FROM b""")
def shop_audible(t: Tables):
    html = F.expr("""concat('<html><head><script type="application/ld+json">[{"@type":"Audiobook","name":"', title, '","description":"<p>About ', title, '.</p>","image":"https://m.example/images/I/51x', k, '._SL175_.jpg"',
        IF(size % 2 = 0, concat(',"author":[{"name":"', maker, '"},{"name":"Co Writer"}],"readBy":[{"name":"Voice"}],"publisher":"', maker, '","datePublished":"', day, '"'), ''), ',"regionsAllowed":["US"]},{"@type":"BreadcrumbList","itemListElement":[{"item":{"name":"Home"}},{"item":{"name":"', kind, '"}}]}]</script>',
        '<meta property="og:image" content="https://m.example/images/I/51x', k, '_CLa.jpg"></head><body><adbl-product-details><adbl-product-metadata><script type="application/json">{"publisher":{"name":"Comp Audio"},"releaseDate":"10-07-14","language":"english","categories":[{"name":"Cat One"}]}</script></adbl-product-metadata></adbl-product-details>',
        '<adbl-product-metadata combine-authors-narrators><script type="application/json">{"authors":[{"name":"Comp Writer"}],"narrators":[{"name":"Voice"}]}</script></adbl-product-metadata>',
        '<adbl-chip-group slot="chips"><adbl-chip href="https://www.audible.com/tag/theme/x/1">Theme One</adbl-chip><adbl-chip href="/tag/mood/x/2">Moody</adbl-chip></adbl-chip-group>',
        '<adbl-review-tile reviewer="Ann" review-date="2020-01-01" story-rating="4"><h3 slot="review-title">Head</h3><adbl-text-block slot="review-summary"><p>Body one</p></adbl-text-block><adbl-star-rating slot="stars" value="5"></adbl-star-rating></adbl-review-tile><adbl-review-tile><h3>Only head</h3></adbl-review-tile></body></html>')""")
    return _flat(audible.to_records(_base(t).select("isbn13", "isbn10", F.lit("https://www.audible.com/pd/x").alias("url"), html.alias("html"))))


# ------------------------------------------------------------------ deal pages
@catalog.query(f"""WITH {_BASE_SQL} SELECT isbn13, title, maker || '|Co Writer' AS authors, maker AS publisher, CASE WHEN size % 2 = 0 THEN 'Chile' END AS origin, day AS date_of_publication, CAST(NULL AS VARCHAR) AS "language",
  kind || '|Tag One' AS genres, 'About ' || title || '.' AS blurb, 'https://r.example/upload/v1/c' || k || '.jpg|https://r.example/named' || k || '.png' AS covers, 0 AS reviews FROM b WHERE size % 10 <> 7""")
def shop_bookbub(t: Tables):
    html = F.expr("""concat('<html lang="en"><head><title>', IF(size % 10 = 7, 'BookBub', concat(title, ' by ', maker, ' and Co Writer - BookBub')), '</title></head><body>',
        IF(size % 10 = 7, '', concat('<div data-book-json="{&quot;title&quot;:&quot;', IF(size % 3 = 0, title, ''), '&quot;,&quot;coverUrl&quot;:&quot;https://r.example/upload/w_300/v1/c', k, '.jpg&quot;,&quot;dealsCategories&quot;:[{&quot;displayName&quot;:&quot;', kind,
        '&quot;}],&quot;tags&quot;:[{&quot;displayName&quot;:&quot;New York Times bestseller&quot;},{&quot;displayName&quot;:&quot;Tag One&quot;}],&quot;description&quot;:&quot;About ', title, '.&quot;}"></div>')),
        '<div class="book-panel"><p>Publisher: ', maker, '</p><p>Publisher Description: no</p><p>Publication date:</p><p>', date_format(day, 'MMMM d, yyyy'), '</p>', IF(size % 2 = 0, '<p>Country: Chile</p>', ''), '</div>',
        '<img class="book-cover-image" alt="Book cover for Other by X" src="/other.png"><img class="book-cover-image" alt="Book cover for ', upper(title), ' by Y" src="https://r.example/named', k, '.png"></body></html>')""")
    return _flat(bookbub.to_records(_base(t).select("isbn13", "isbn10", F.lit("https://r.example/books/x").alias("url"), html.alias("html"))))


@catalog.query(f"WITH {_BASE_SQL} SELECT k, CASE WHEN size % 2 = 0 THEN 'named' ELSE 'first' END AS url, size % 2 = 0 AS names_book FROM b")
def preferred_image(t: Tables):
    b = _base(t)
    images = b.selectExpr("k AS page_id", "title", "explode(array(named_struct('pos', 1, 'url', 'first', 'alt', 'Book cover for Other by X'), named_struct('pos', 2, 'url', 'named', 'alt', IF(size % 2 = 0, concat('Book cover for ', upper(title), ' by Y'), 'none')))) AS i")
    return prefer_named_image(images.select("page_id", "title", "i.*")).select(F.col("page_id").alias("k"), "url", "names_book")


# ------------------------------------------------------------------ search pages
_ROWS_SQL = f"WITH {_BASE_SQL} SELECT isbn13, unnest([0, 1]) AS pos, unnest([title, title || ' Guide']) AS title"


@catalog.query(f"{_ROWS_SQL}, unnest([lpad(CAST(k AS VARCHAR), 10, 'A'), lpad(CAST(k AS VARCHAR), 10, 'B')]) AS asin FROM b")
def search_rows_amazon(t: Tables):
    row = lambda code, tail, extra: f"'<div data-component-type=\"s-search-result\" data-asin=\"', lpad(k, 10, '{code}'), '\"{extra}><h2><span>', title, '{tail}</span></h2></div>'"
    html = F.expr(f"concat('<html>', {row('A', '', '')}, {row('B', ' Guide', ' data-index=1')}, '<div data-asin=\"\" data-index=2></div></html>')")
    return amazon.search_rows(_base(t).select("isbn13", F.lit(2).alias("rung"), html.alias("html"))).select("isbn13", "pos", "title", "asin")


@catalog.query(f"{_ROWS_SQL}, 'Ann|' || maker AS authors, unnest(['https://www.goodreads.com/book/show/' || k, 'https://www.goodreads.com/book/show/g' || k]) AS url FROM b")
def search_rows_goodreads(t: Tables):
    row = lambda lead, tail: f"'<tr itemtype=\"b\"><td><a class=\"bookTitle\" href=\"/book/show/{lead}', k, '?x=1\"><span itemprop=\"name\">', title, '{tail}</span></a><a class=\"authorName\"><span itemprop=\"name\">Ann</span></a><a class=\"authorName\">', maker, '</a></td></tr>'"
    html = F.expr(f"concat('<html><table class=\"tableList\">', {row('', '')}, {row('g', ' Guide')}, '<tr><td>none</td></tr></table></html>')")
    return goodreads.search_rows(_base(t).select("isbn13", html.alias("html"))).select("isbn13", "pos", "title", F.array_join("authors", "|").alias("authors"), "url")


@catalog.query(f"{_ROWS_SQL}, 'Ann|' || maker AS authors, unnest([TRUE, FALSE]) AS ebook, unnest(['01234567-89ab-cdef-0123-' || lpad(CAST(k AS VARCHAR), 12, '0'), '']) AS review_key FROM b")
def search_rows_kobo(t: Tables):
    row = lambda path, tail, key: f"'<div id=\"list-item-1\" data-cross-revision-id=\"{key}', IF('{key}' = 'no', '', lpad(k, 12, '0')), '\"><a data-testid=\"title\" href=\"/us/en/{path}/x\">', title, '{tail}</a><div data-testid=\"authors\"><a>Ann</a><a>', maker, '</a></div><img src=\"/c.jpg\"></div>'"
    html = F.expr(f"concat('<html>', {row('ebook', '', '01234567-89ab-cdef-0123-')}, {row('audiobook', ' Guide', 'no')}, '</html>')")
    return kobo.search_rows(_base(t).select("isbn13", html.alias("html"))).select("isbn13", "pos", "title", F.array_join("authors", "|").alias("authors"), "ebook", "review_key")


@catalog.query(f"{_ROWS_SQL}, 'Ann|' || maker AS authors, unnest([lpad(CAST(k AS VARCHAR), 10, 'A'), lpad(CAST(k AS VARCHAR), 10, 'B')]) AS asin FROM b")
def search_rows_audible(t: Tables):
    one = "'<li class=\"bc-list-item\tproductListItem\" id=\"product-list-item-', lpad(k, 10, 'A'), '\" aria-label=\"', title, '\"><a class=\"bc-link\" href=\"/pd/x\">x</a><span class=\"authorLabel\">By: Ann, ', maker, '</span></li>'"
    two = "'<li class=\"productListItem\"><h3 class=\"bc-heading\"><a href=\"/pd/Slug/', lpad(k, 10, 'B'), '?ref=1\">', title, ' Guide</a></h3><span class=\"authorLabel\">By: Ann, ', maker, '</span></li>'"
    html = F.expr(f"concat('<html><ul>', {one}, {two}, '</ul></html>')")
    return audible.search_rows(_base(t).select("isbn13", html.alias("html"))).select("isbn13", "pos", "title", F.array_join("authors", "|").alias("authors"), "asin")


@catalog.query(f"WITH {_BASE_SQL} SELECT isbn13, unnest(['a' || k, 'the-book']) AS slug, unnest([title, 'the book']) AS title FROM b")
def search_rows_bookbub(t: Tables):
    html = F.expr("""concat('<html><a href="/books/search">s</a><a href="/books/a', k, '"><img alt="Book cover for ', title, ' by ', maker, '"></a><a href="/books/the-book-by-x-2020-01-02"><img></a><a href="/books/a', k, '">again</a></html>')""")
    rows = bookbub.author_rows(_base(t).select("isbn13", html.alias("html")))
    return rows.select("isbn13", F.regexp_replace("slug", "-by-.*$", "").alias("slug"), "title")


@catalog.query(f"""WITH {_BASE_SQL} SELECT k, 0 AS rung, replace(title, ' ', '-') || '-guide-to-' || kind || '-by-brand-' || regexp_extract(maker, '[0-9]+') AS slug FROM b
  UNION ALL SELECT k, 1, replace(title, ' ', '-') || '-guide-to-' || kind || '-by-brand-' || regexp_extract(maker, '[0-9]+') || '-and-ann' FROM b
  UNION ALL SELECT k, 2, replace(title, ' ', '-') || '-by-brand-' || regexp_extract(maker, '[0-9]+') FROM b""")
def slug_guesses(t: Tables):
    hints = _base(t).selectExpr("string(k) AS isbn13", "concat(title, ': Guide to ', kind) AS title", "array(maker, 'Ann') AS authors")
    return bookbub.slug_rungs(hints).select(F.col("isbn13").cast("bigint").alias("k"), "rung", "slug")


# ------------------------------------------------------------------ the run on mapped records
_MAPPED = "SELECT isbn13, '{0}' AS source, title IS NULL OR authors = '' OR publisher IS NULL OR origin IS NULL OR date_of_publication IS NULL OR \"language\" IS NULL OR genres = '' AS flawed FROM ({1})"


@catalog.query(f"""WITH found AS ({_MAPPED.format("openlibrary", catalog.oracles["shop_openlibrary"])} UNION ALL {_MAPPED.format("goodreads", catalog.oracles["shop_goodreads"])}),
pairs AS (SELECT {sql_isbn13("p_partkey")} AS isbn13, unnest({SOURCES_SQL}) AS source FROM part)
SELECT isbn13, source, CASE WHEN flawed IS NULL THEN 'empty' WHEN flawed THEN 'partial' ELSE 'ok' END AS status, flawed IS NOT NULL AS trustworthy FROM pairs LEFT JOIN found USING (isbn13, source)""")
def run_mapped(t: Tables):
    """Captured replies and pages of two sources, mapped, through the whole run; every record comes twice.

    No host of the log was reached for these books, so what has no record is empty but not trusted.
    """
    path = f"{checkpoint_folder(t.spark).rstrip('/')}/mapped-{uuid.uuid4().hex}"
    # a mapping's plan is long: what it gives is stored before it is joined
    map_sources({"openlibrary": _catalogue_replies(t), "goodreads": _cache_pages(t)}).drop("origin_layers").write.parquet(path)
    records = t.spark.read.parquet(path)
    nothing = records.select("isbn13", "source", F.lit("no_data").alias("kind")).limit(0)
    log = fetch_log(t).withColumn("isbn13", F.concat(F.lit("979"), F.substring("isbn13", 4, 10)))
    done = passes.run(_base(t), nothing.drop("kind"), nothing, records.withColumn("seq", F.explode(F.array(F.lit(1), F.lit(2)))), log)
    return done.outcomes.select("isbn13", "source", "status", "trustworthy")
