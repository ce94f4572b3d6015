"""Rows from stored web pages: element counts, links, texts, robots and sitemap lines, playlists, challenge marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
CHALLENGE_MARKS = ("just a moment", "checking your browser", "cf-browser-verification", "attention required")
COUNTED_TAGS = ("a", "p", "li", "h1", "article", "script", "nav", "footer")


def usable_body(html: Column) -> Column:
    """At least 80 characters and no challenge mark in the first 20,000."""
    head, marked = F.lower(F.substring(html, 1, 20_000)), F.lit(False)
    for mark in CHALLENGE_MARKS:
        marked = marked | head.contains(mark)
    return F.coalesce((F.length(html) >= 80) & ~marked, F.lit(False))


def tag_counts(pages: DataFrame) -> DataFrame:
    """How often each counted tag opens in a page."""
    return pages.select("page_id", *[F.regexp_count("html", F.lit(rf"(?i)<{t}[\s>]")).cast("long").alias(f"n_{t}") for t in COUNTED_TAGS])


def links(pages: DataFrame) -> DataFrame:
    """page_id, place and href of each link in order."""
    hrefs = F.regexp_extract_all("html", F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), F.lit(1))
    return pages.select("page_id", F.posexplode(hrefs).alias("place", "href"))


def page_title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)


def robots_paths(text: Column) -> Column:
    """Paths of Disallow, Allow and Sitemap lines, the first of each."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?:Disallow|Allow|Sitemap):\s*(.+)"), F.lit(1)), lambda p: F.trim(p)))


def playlist_variants(text: Column) -> Column:
    """struct(bandwidth, url) of the variants of a master playlist: each mark line with the next line that is no comment."""
    lines = F.transform(F.split(text, "\n"), lambda s: F.trim(s))
    marks = F.filter(F.transform(lines, lambda s, i: F.struct(s.alias("s"), i.alias("i"))), lambda e: e["s"].startswith("#EXT-X-STREAM-INF"))
    following = lambda e: F.get(F.filter(F.slice(lines, e["i"] + 2, F.size(lines)), lambda s: (s != "") & ~s.startswith("#")), F.lit(0))
    return F.transform(marks, lambda e: F.struct(F.coalesce(F.regexp_extract(e["s"], r"BANDWIDTH=(\d+)", 1).try_cast("long"), F.lit(0)).alias("bandwidth"), following(e).alias("url")))


def best_variant(text: Column) -> Column:
    """The URL of the variant of most bandwidth, the first among equals."""
    found = F.filter(playlist_variants(text), lambda v: v["url"].isNotNull())
    return F.array_max(F.transform(found, lambda v, i: F.struct(v["bandwidth"], (-i).alias("first"), v["url"].alias("url"))))["url"]


# Classes and tags that hold result items, first wins ties.
ITEM_CLASSES = ("result", "item", "card", "article", "video-item", "movie-item")


def _equals(name: str):
    return lambda token: token == name


def result_selector(html: Column) -> Column:
    """The item class or tag that occurs most often, at least twice; null without one."""
    classes = F.regexp_extract_all(html, F.lit(r'(?i)\sclass="([^"]*)"'), F.lit(1))
    tokens = F.flatten(F.transform(classes, lambda c: F.array_distinct(F.split(c, r"\s+"))))
    counted = []
    for i, name in enumerate(ITEM_CLASSES):
        n = F.regexp_count(html, F.lit(r"(?i)<article[\s>]")) if name == "article" else F.size(F.filter(tokens, _equals(name)))
        counted.append(F.struct(n.alias("n"), F.lit(-i).alias("order"), F.lit(name if name == "article" else f".{name}").alias("selector")))
    best = F.array_max(F.array(*counted))
    return F.when(best["n"] >= 2, best["selector"])


def finite_playlist(text: Column) -> Column:
    """Whether a media playlist ends, is not encrypted, has no byte ranges and has segments."""
    lines = F.transform(F.split(text, "\n"), lambda s: F.trim(s))
    segments = F.filter(lines, lambda s: (s != "") & ~s.startswith("#"))
    plain = ~text.contains("#EXT-X-KEY") | text.contains("METHOD=NONE")
    return text.contains("#EXT-X-ENDLIST") & plain & ~text.contains("#EXT-X-BYTERANGE") & (F.size(segments) > 0)


def search_candidates(url: Column, query: Column, page: int = 1) -> Column:
    """The provider's page, and its likely search URLs, in order, each once."""
    base, q, p = F.regexp_replace(url, "/+$", ""), F.url_encode(query), F.lit(str(page))
    made = [
        url, F.concat(base, F.lit("/")), F.concat(base, F.lit("/search?q="), q, F.lit("&page="), p), F.concat(base, F.lit("/?s="), q, F.lit("&paged="), p),
        F.concat(base, F.lit("/?q="), q, F.lit("&page="), p), F.concat(base, F.lit("/search?query="), q, F.lit("&page="), p),
        F.concat(base, F.lit("/search/"), q), F.concat(base, F.lit("/find?q="), q, F.lit("&page="), p),
    ]
    return F.array_distinct(F.array(*made))
