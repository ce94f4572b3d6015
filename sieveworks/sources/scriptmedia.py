"""Media that scripts name: player settings, assigned variables, server state. All are column expressions over sources.

A setting is found in two steps, the list or object of a player and the addresses in it, so an address counts only where its
player names it. Candidates keep their method and the order in which they stand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveworks.functions.scores import resolve_url
from sieveworks.operators.containers import holds_any
from sieveworks.sources import dom

# Method, pattern of the setting, pattern of the addresses in it.
PLAYERS = (
    ("jwplayer_sources", r"(?s)sources\s*:\s*\[([^\]]+)\]", r"['\"]?(?:file|src|url)['\"]?\s*:\s*['\"]([^'\"]+)['\"]"),
    ("videojs_src", r"(?s)(?:videojs|player)\.src\s*\(\s*\[([^\]]+)\]", r"src\s*:\s*['\"]([^'\"]+)['\"]"),
    ("plyr", r"(?s)new\s+Plyr\s*\([^,)]+,\s*\{([^}]+)\}", r"src\s*:\s*['\"]([^'\"]+)['\"]"),
)
ASSIGNED = (
    ("window_var", r"window\.\w+\s*=\s*['\"]?(https?://[^'\";\s]{10,})['\"]?"),
    ("var_assign", r"(?i)var\s+\w+\s*=\s*['\"]?(https?://[^'\";\s]{10,}\.(?:mp4|m3u8|mpd|webm)[^'\";\s]*)['\"]?"),
)
STATE_MARKS = ("window.__NEXT_DATA__", "window.__NUXT__", "window.__INITIAL_STATE__", "window.__REDUX_STATE__", "window.APP_INIT_DATA", "window.pageData", "window.__data__", "window.initialProps")
STATE_FIELD = (
    r"(?i)['\"](?:videoUrl|video_url|hlsUrl|hls_url|streamUrl|stream_url|mp4Url|mp4_url|playback_url|media_url|download_url|directUrl|direct_url|src|file|url)['\"]\s*:\s*['\"]([^'\"]+)['\"]"
)
EXTENSIONS = (".mp4", ".webm", ".mkv", ".avi", ".mov", ".m4v", ".flv", ".wmv", ".3gp", ".ts", ".m3u8", ".mpd")
QUALITIES = ("2160p", "4k", "1080p", "720p", "480p", "360p", "240p")
LINKED = (r'"contentUrl"\s*:\s*"([^"]+)"', r'"embedUrl"\s*:\s*"([^"]+)"', r'"url"\s*:\s*"([^"]+\.(?:mp4|m3u8|webm))"', r'"videoUrl"\s*:\s*"([^"]+)"', r'"streamUrl"\s*:\s*"([^"]+)"')


def _all(text: Column, pattern: str) -> Column:
    """What the only group of a pattern takes, of all matches."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def _matcher(pattern: str):
    return lambda text: _all(text, pattern)


def _is_media(url: Column) -> Column:
    return holds_any(F.lower(url), EXTENSIONS)


def named_media(html: Column) -> Column:
    """array<struct(method, url)> of what player settings and assigned variables of a source name; empty for null."""
    listed = lambda method, urls: F.transform(urls, lambda u: F.struct(F.lit(method).alias("method"), u.alias("url")))
    text, found = F.coalesce(html, F.lit("")), []
    for method, setting, address in PLAYERS:
        urls = F.flatten(F.transform(_all(text, setting), _matcher(address)))
        found.append(listed(method, F.filter(urls, lambda u: u.startswith("http"))))
    return F.concat(*found, *[listed(method, _all(text, pattern)) for method, pattern in ASSIGNED])


def state_media(found: DataFrame, base: Column) -> DataFrame:
    """page_id, place and url of the media that server state names: of the first script with any, the address of best quality
    (none known is least), the first among equals. A script is state by its marks, its id, or as an object of over 100 characters."""
    text = F.col("text")
    is_state = holds_any(text, STATE_MARKS) | F.coalesce(F.col("id") == "__NEXT_DATA__", F.lit(False)) | (F.ltrim(text).startswith("{") & (F.length(text) > 100))
    urls = F.filter(_all(text, STATE_FIELD), _is_media)
    rank = lambda u: F.coalesce(*[F.when(F.lower(u).contains(q), i) for i, q in enumerate(QUALITIES)], F.lit(100))
    best = F.array_min(F.transform(urls, lambda u, i: F.struct(rank(u).alias("rank"), i.alias("at"), u.alias("url"))))["url"]
    rows = found.where((F.col("tag") == "script") & is_state).select("page_id", "place", best.alias("url")).where("url IS NOT NULL")
    first = rows.groupBy("page_id").agg(F.min_by(F.struct("place", "url"), "place").alias("s")).select("page_id", "s.*")
    return first.select("page_id", "place", resolve_url(F.trim(F.replace(F.col("url"), F.lit("\\"), F.lit(""))), base).alias("url"))


def linked_media(found: DataFrame, base: Column) -> DataFrame:
    """page_id, place and url of the media of linked data: of the first script, in the order of the fields, the first address of a field
    if it is media or speaks of video."""
    candidates = F.array_compact(F.array(*[F.nullif(F.regexp_extract("text", p, 1), F.lit("")) for p in LINKED]))
    good = F.get(F.filter(candidates, lambda u: _is_media(u) | u.contains("video")), F.lit(0))
    rows = found.where((F.col("tag") == "script") & (dom.attr("type") == "application/ld+json")).select("page_id", "place", good.alias("url")).where("url IS NOT NULL")
    first = rows.groupBy("page_id").agg(F.min_by(F.struct("place", "url"), "place").alias("s")).select("page_id", "s.*")
    return first.select("page_id", "place", resolve_url(F.col("url"), base).alias("url"))


def script_media(pages: DataFrame, found: DataFrame, base: Column) -> DataFrame:
    """pages: page_id, html. page_id, method and url of all media that a page's scripts name, each once."""
    named = pages.select("page_id", F.explode(named_media(F.col("html"))).alias("m")).select("page_id", "m.method", "m.url")
    state = state_media(found, base).select("page_id", F.lit("ssr_state").alias("method"), "url")
    linked = linked_media(found, base).select("page_id", F.lit("linked_data").alias("method"), "url")
    return named.unionByName(state).unionByName(linked).distinct()
