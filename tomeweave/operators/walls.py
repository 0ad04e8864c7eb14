"""Bot-wall detection over captured responses and pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed import (PAGE_CLASS_RULES, WALL_HARD, WALL_HEAD_CHARS, WALL_SMALL_BODY, WALL_SOFT)
from ..functions.core import let, literal_array
from ..functions.urls import host_of


def _head(body: Column) -> Column:
    """The region the rule reads: an interstitial announces itself at the top of the page."""
    return F.lower(F.substring(body, 1, WALL_HEAD_CHARS))


def _hit(head: Column, markers: list[str]) -> Column:
    """First marker of the list (list order) that the text holds."""
    return F.get(F.filter(literal_array(markers), lambda m: F.contains(head, m)), 0)


def classify(status: Column, waf_action: Column, content_type: Column, body: Column) -> Column:
    """Why a response is a wall, null when it is content."""
    waf = F.trim(F.coalesce(waf_action, F.lit("")))
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    readable = F.contains(kind, F.lit("html")) | F.contains(kind, F.lit("text")) | (kind == "")
    text = F.when(readable, F.coalesce(body, F.lit(""))).otherwise(F.lit(""))
    code = status.cast("string")
    hits = let(_head(text), lambda head: F.struct(
        _hit(head, WALL_HARD).alias("hard"), _hit(head, WALL_SOFT).alias("soft")))

    def judge(hit: Column) -> Column:
        soft, size = hit["soft"], F.length(text)
        lead = F.concat(F.lit("anti-bot interstitial detected ('"), soft)
        return (F.when(hit["hard"].isNotNull(), F.concat(
                    F.lit("anti-bot interstitial detected (matched '"), hit["hard"], F.lit("')")))
                .when(soft.isNotNull() & size.between(1, WALL_SMALL_BODY),
                      F.concat(lead, F.lit("', body only "), size.cast("string"), F.lit(" chars)")))
                .when(soft.isNotNull() & (status >= 400), F.concat(lead, F.lit("', HTTP "), code, F.lit(")")))
                .when(status.isin(401, 403, 451), F.concat(F.lit("HTTP "), code, F.lit(" wall")))
                .when(status == 429, F.lit("HTTP 429 rate limit")))

    return F.when((waf != "") & ~F.lower(waf).isin("allow", "none"),
                  F.concat(F.lit("AWS WAF "), waf, F.lit(" response (HTTP "), code, F.lit(")"))).otherwise(let(hits, judge))


def in_rendered(html: Column) -> Column:
    """Why a rendered page is a wall: any marker counts, there is no status to weigh."""
    hit = let(_head(F.coalesce(html, F.lit(""))), lambda head: _hit(head, WALL_HARD + WALL_SOFT))
    return let(hit, lambda h: F.when(h.isNotNull(), F.concat(F.lit("anti-bot interstitial in rendered DOM ('"), h, F.lit("')"))))


def page_class(source: Column, url: Column, html: Column, has_anchor: Column | None = None) -> Column:
    """Site-specific class of a page that is no product page, null for a good one."""
    out = None
    for name, label, scope, longest, pattern in PAGE_CLASS_RULES:
        text = html if scope is None else F.substring(html, 1, scope)
        test = (source == name) & text.rlike(pattern)
        if longest is not None:
            test = test & (F.length(html) <= longest)
        if label == "signin":
            test = (source == name) & (F.contains(F.lower(url), F.lit("/ax/claim")) | text.rlike(pattern))
        out = F.when(test, F.lit(label)) if out is None else out.when(test, F.lit(label))
    wrong_host = (source == "audible") & (F.contains(url, F.lit("ipRedirectFrom="))
                                          | (host_of(url) != "www.audible.com"))
    out = out.when(wrong_host, F.lit("wrong-host"))
    if has_anchor is not None:
        product = (source == "amazon") & F.contains(url, F.lit("/dp/"))
        out = out.when(product & ~F.coalesce(has_anchor, F.lit(False)), F.lit("missing-anchor"))
    return out
