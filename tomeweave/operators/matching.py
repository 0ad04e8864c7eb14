"""Is this candidate the wanted book?  Scores, vetoes and the ranking of each shop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import (AMAZON_FUZZY, AMAZON_OPENED, AUDIBLE_EDITION_PATTERN, AUDIBLE_FLOOR,
                     AUDIBLE_SIBLING, BEST_FLOOR, BOOKBUB_ACCEPT, BOOKBUB_ADDITIVE,
                     BOOKBUB_AUTHOR_ROWS, BOOKBUB_CONFIDENT, BOOKBUB_SLUGS, BOOKBUB_STRONG,
                     CONTAINED_SCORE, GOODREADS_FLOOR, GOODREADS_KEEP, KOBO_FLOOR)
from ..functions import isbn
from ..functions.arrow import seq_ratios
from ..functions.core import compute_once
from ..functions.text import authors_agree, fold, is_derivative, is_sequel, main_part
from .skew import first_per_key, top_per_key

WORK = ["_want", "_cand", "_want_main", "_cand_main"]


def score_value(want: Column, cand: Column, ratio: Column, prefix_is_exact: bool = False,
                additive_ceiling: float | None = None) -> Column:
    """Title similarity 0-1 from folded titles and their best text ratio.

    Containment is one-sided: a candidate that drops words is the same book, one that adds
    words is capped by ``additive_ceiling``.
    """
    raised = F.greatest(ratio, F.lit(CONTAINED_SCORE))
    dropped = F.lit(1.0) if prefix_is_exact else raised
    added = raised if additive_ceiling is None else F.least(raised, F.lit(additive_ceiling))
    return (F.when((want == "") | (cand == ""), F.lit(0.0)).when(want == cand, F.lit(1.0))
            .when(is_sequel(want, cand), F.lit(0.0))
            .when(F.contains(want, cand), dropped).when(F.contains(cand, want), added).otherwise(ratio))


def _length_bound(a: Column, b: Column) -> Column:
    """No text ratio can exceed this; it needs the two lengths only."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * F.least(F.length(a), F.length(b)) / total)


def add_title_score(pairs: DataFrame, wanted: str, candidate: str, floor: float = 0.0,
                    name: str = "score", **rules) -> DataFrame:
    """Add the title score of two title columns.

    The text ratio is the only Python step.  It is skipped (exactly) where the score does not
    depend on it or where the length bound already lies below ``floor``; such rows keep a score
    below the floor.
    """
    ready = pairs.withColumns({"_want": fold(F.col(wanted)), "_cand": fold(F.col(candidate)),
                               "_want_main": main_part(F.col(wanted)), "_cand_main": main_part(F.col(candidate))})
    want, cand, want_main, cand_main = (F.col(c) for c in WORK)
    contained = F.contains(want, cand) | F.contains(cand, want)
    reach = F.greatest(_length_bound(want, cand), _length_bound(want_main, cand_main))
    needed = (want != "") & (cand != "") & (want != cand) & (contained | (reach >= floor)) & ~is_sequel(want, cand)
    ready = ready.withColumn("_needed", needed)
    only = lambda *cs: F.when(F.col("_needed"), F.array(*cs))
    ready = ready.withColumn("_ratios", seq_ratios(only(want, want_main), only(cand, cand_main)))
    ratio = F.coalesce(F.array_max("_ratios"), F.lit(0.0))
    scored = compute_once(ready, **{name: score_value(want, cand, ratio, **rules)})
    return scored.drop(*WORK, "_needed", "_ratios")


def pair_up(wanted: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidate rows with the wanted title and authors of their book.

    ``wanted(isbn13, title, authors)`` has one row per book, so adaptive execution can split a
    book with very many candidates; the candidates are read once.  The wanted books grow with the
    input, so they are never broadcast, however small their files look.
    """
    known = wanted.select("isbn13", F.col("title").alias("wanted_title"), F.col("authors").alias("wanted_authors"))
    return candidates.join(known.hint("merge"), "isbn13")


def accepted(pairs: DataFrame, floor: float = BEST_FLOOR, require_author: bool = True, **rules) -> DataFrame:
    """Scored candidates that pass the vetoes, the floor and the author test.

    The cheap vetoes run before the ratio.
    """
    derivative = is_derivative(fold(F.col("title")), fold(F.col("wanted_title")))
    clear = pairs.where(~derivative)
    if require_author:
        clear = clear.where(authors_agree(F.col("wanted_authors"), F.col("authors")))
    return add_title_score(clear, "wanted_title", "title", floor, **rules).where(F.col("score") >= floor)


def best(pairs: DataFrame, k: int = 1, floor: float = BEST_FLOOR, require_author: bool = True,
         first: list = (), **rules) -> DataFrame:
    """The best ``k`` candidates of each book: score, then the shorter title, then input order."""
    order = [*first, F.desc("score"), F.length(fold(F.col("title"))), "pos"]
    return top_per_key(accepted(pairs, floor, require_author, **rules), ["isbn13"], order, k, "rank")


# ------------------------------------------------------------------ shop rules
def goodreads_pick(pairs: DataFrame) -> DataFrame:
    return best(pairs, GOODREADS_KEEP, GOODREADS_FLOOR)


def kobo_pick(pairs: DataFrame) -> DataFrame:
    """E-book cards first when any qualifies."""
    return best(pairs, 1, KOBO_FLOOR, first=[F.desc("ebook")])


def audible_rank(pairs: DataFrame) -> DataFrame:
    """Every row with score, flags, ``acceptable`` and ``sibling``."""
    asin = isbn.normalize(F.col("asin"))
    same = (F.length("asin") == 10) & (isbn.isbn13_of(asin) == F.col("isbn13"))
    scored = add_title_score(pairs, "wanted_title", "title", prefix_is_exact=True)
    flagged = scored.withColumns({
        "isbn_match": F.coalesce(same, F.lit(False)),
        "author_match": authors_agree(F.col("wanted_authors"), F.col("authors"))})
    return flagged.withColumns({
        "acceptable": F.col("isbn_match") | ((F.col("score") >= AUDIBLE_FLOOR) & F.col("author_match")),
        "sibling": F.col("isbn_match") | (F.col("score") >= AUDIBLE_SIBLING)
        | F.col("title").rlike(AUDIBLE_EDITION_PATTERN)})


def audible_pick(pairs: DataFrame) -> DataFrame:
    order = [F.desc("isbn_match"), F.desc(F.bround("score", 3)), F.desc("author_match"), "pos"]
    return first_per_key(audible_rank(pairs).where("acceptable"), ["isbn13"], order)


def verify_isbn(wanted13: Column, wanted10: Column, page13: Column, page10: Column) -> Column:
    """``isbn``, ``mismatch`` or ``fuzzy``: does the page carry the wanted identifier?"""
    found13, found10 = isbn.normalize(page13), isbn.normalize(page10)
    same = (found13 == wanted13) | ((found10 != "") & (found10 == F.coalesce(wanted10, F.lit(""))))
    return (F.when(same, F.lit("isbn")).when((found13 != "") | (found10 != ""), F.lit("mismatch"))
            .otherwise(F.lit("fuzzy")))


def verify_lax(wanted13: Column, page13: Column, fuzzy: Column) -> Column:
    """The laxer test: only another ISBN-13 refuses a page, and not one found by title."""
    found = F.replace(F.coalesce(page13, F.lit("")), F.lit("-"), F.lit(""))
    return (found == "") | (found == wanted13) | fuzzy


def amazon_pick(pairs: DataFrame) -> DataFrame:
    """First acceptable page of the ladder.

    ``pairs`` rows carry rung (1 own code, 2 ISBN search, 3 title search), pos, page_ok and
    verdict.  Of each search, three candidates are opened after the derivative filter.
    """
    title, wanted = F.col("title"), F.coalesce("wanted_title", F.lit(""))
    direct = pairs.where((F.col("rung") == 1) & F.col("page_ok") & (F.col("verdict") != "mismatch"))
    searched = pairs.where((F.col("rung") > 1) & ~is_derivative(fold(title), fold(wanted)))
    opened = top_per_key(searched, ["isbn13", "rung"], ["pos"], AMAZON_OPENED).drop("_rank").where("page_ok")
    scored = add_title_score(opened, "wanted_title", "title", AMAZON_FUZZY)
    plausible = ((wanted != "") & ~is_sequel(fold(wanted), fold(title)) & (F.col("score") >= AMAZON_FUZZY)
                 & authors_agree(F.col("wanted_authors"), F.array(title)))
    good = scored.where((F.col("verdict") == "isbn") | ((F.col("verdict") == "fuzzy") & plausible)).drop("score")
    return first_per_key(direct.unionByName(good), ["isbn13"], ["rung", "pos"])


def bookbub_scores(pairs: DataFrame) -> DataFrame:
    """Blend 0.6 title and 0.4 best author score, title alone when no author is wanted."""
    titled = add_title_score(pairs, "wanted_title", "title", name="_title", additive_ceiling=BOOKBUB_ADDITIVE)
    blank = F.array().cast("array<string>")

    def crossed(part) -> Column:
        names = F.coalesce("wanted_authors", blank), F.coalesce("authors", blank)
        return F.flatten(F.transform(names[0], lambda a: F.transform(names[1], lambda b: part(a, b))))

    ready = titled.withColumns({
        "_a": crossed(lambda a, b: fold(a)), "_b": crossed(lambda a, b: fold(b)),
        "_am": crossed(lambda a, b: main_part(a)), "_bm": crossed(lambda a, b: main_part(b))})
    ready = ready.withColumn("_full", seq_ratios("_a", "_b")).withColumn("_main", seq_ratios("_am", "_bm"))
    each = F.transform(F.col("_a"), lambda a, i: score_value(
        a, F.get("_b", i), F.greatest(F.get("_full", i), F.get("_main", i)), additive_ceiling=BOOKBUB_ADDITIVE))
    author = F.coalesce(F.array_max(each), F.lit(0.0))
    no_author = F.size(F.coalesce("wanted_authors", blank)) == 0
    blended = F.when(no_author, F.col("_title")).otherwise(0.6 * F.col("_title") + 0.4 * author)
    return (compute_once(ready, score=blended)
            .drop("_title", "_a", "_b", "_am", "_bm", "_full", "_main"))


def bookbub_author_rows(rows: DataFrame) -> DataFrame:
    """From an author's listing, the two rows closest in title; they follow the slug rungs."""
    scored = add_title_score(rows, "wanted_title", "title", additive_ceiling=BOOKBUB_ADDITIVE)
    picked = top_per_key(scored, ["isbn13"], [F.desc("score"), "url"], BOOKBUB_AUTHOR_ROWS, "_at")
    return picked.withColumn("rung", F.lit(BOOKBUB_SLUGS - 1) + F.col("_at")).drop("_at", "score")


def bookbub_pick(pairs: DataFrame) -> DataFrame:
    """Lowest rung with a strong score, else the best score; refuse below the acceptance line."""
    scored = bookbub_scores(pairs)
    strong = F.col("score") >= BOOKBUB_STRONG
    order = [F.desc(strong), F.when(strong, F.col("rung")), F.desc("score"), "rung"]
    chosen = first_per_key(scored.where(F.col("score") >= BOOKBUB_ACCEPT), ["isbn13"], order)
    return chosen.withColumn("confident", F.col("score") >= BOOKBUB_CONFIDENT)
