"""Tests and classes of URLs, and URLs made from others, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sieveworks.functions.scores import any_of, first_mark, url_host

# Parts of URLs, tested as substrings of the lower-cased URL.
NOT_CONTENT = (
    "/category/", "/categories/", "/tag/", "/tags/", "/user/", "/login", "/register", "/signup", "/about", "/contact", "/privacy",
    "/terms", "javascript:", "mailto:", "tel:", "/sitemap", "/feed", "/rss", "/atom",
)
NOT_NAVIGATION = ("/login", "/register", "/signup", "/contact", "/about", "/privacy", "/terms", "/faq", "mailto:", "tel:", "/advertise", "/dmca", "/tos", "/sitemap")
GENERIC_TABS = ("all", "latest", "new", "movies", "videos", "episodes", "shows", "series", "popular", "top", "recent", "full")
CATEGORY_MARKS = (
    "/category/", "/categories/", "/cat/", "/genre/", "/genres/", "/tag/", "/tags/", "/type/", "/types/", "/browse/", "/explore/",
    "/popular", "/trending", "/latest", "/new", "/top-rated", "/featured", "/recommended",
)
MEDIA_PARTS = (".mp4", ".m3u8", ".mpd", ".webm", "videoplayback", "akamaized", "cdn")
VIDEO_PARTS = (".mp4", ".m3u8", ".mpd", ".webm", ".mkv", ".ts", "/video/", "/stream/", "/hls/", "/dash/")
VIDEO_EXTENSIONS = ("mp4", "webm", "mkv", "avi", "mov", "m4v", "flv", "wmv", "3gp", "ts", "ogv", "f4v", "m3u8", "mpd")
PLAYABLE_PARTS = ("/video/", "/stream/", "/hls/", "/dash/", "videoplayback", "/get_video")
PAGE_PARTS = (".html", ".php", ".asp")
# Marks in order, and what they stand for.
DOWNLOAD_QUALITY = tuple((q, q) for q in ("2160p", "4k", "1080p", "720p", "480p", "360p", "240p"))
DOWNLOAD_FORMAT = ((".m3u8", "m3u8"), (".mpd", "mpd"), (".mp4", "mp4"), (".webm", "webm"), (".mkv", "mkv"), (".avi", "avi"), (".mov", "mov"))
RESOLVED_QUALITY = (("2160", "4K"), ("4k", "4K"), ("1440", "1440p"), ("1080", "1080p"), ("720", "720p"), ("480", "480p"), ("360", "360p"), (".m3u8", "Auto"), (".mpd", "Auto"))
URL_PATTERN = ((".m3u8", "HLS"), (".mpd", "DASH"), (".mp4", "MP4"), (".webm", "WebM"))
DOWNLOAD_SCORE = (
    ("4k", 100), ("2160", 100), ("2160p", 100), ("1080", 90), ("1080p", 90), ("fullhd", 90), ("full hd", 90), ("720", 70), ("720p", 70),
    ("hd", 70), ("480", 50), ("480p", 50), ("sd", 50), ("360", 30), ("360p", 30), ("240", 20), ("240p", 20),
)


def is_content(url: Column) -> Column:
    low = F.lower(url)
    return ~low.startswith("#") & ~any_of(low, NOT_CONTENT)


def is_navigation_excluded(url: Column) -> Column:
    return any_of(F.lower(url), NOT_NAVIGATION)


def is_generic_tab(url: Column, text: Column) -> Column:
    return any_of(F.lower(F.concat_ws(" ", url, text)), GENERIC_TABS)


def is_category_url(url: Column) -> Column:
    return any_of(F.lower(url), CATEGORY_MARKS)


def is_likely_media(url: Column) -> Column:
    return any_of(F.lower(url), MEDIA_PARTS)


def is_video(url: Column) -> Column:
    return any_of(F.lower(url), VIDEO_PARTS)


def is_direct_media(url: Column) -> Column:
    """Whether a media extension ends the URL or its part before a question mark."""
    return F.lower(url).rlike(rf"\.(?:{'|'.join(VIDEO_EXTENSIONS)})(?:\?|\z)")


def is_playable(url: Column) -> Column:
    low = F.lower(url)
    return ~any_of(low, PAGE_PARTS) & any_of(low, tuple(f".{e}" for e in VIDEO_EXTENSIONS) + PLAYABLE_PARTS)


def download_quality(url: Column) -> Column:
    return first_mark(url, DOWNLOAD_QUALITY, "Unknown")


def download_format(url: Column) -> Column:
    return first_mark(url, DOWNLOAD_FORMAT, "")


def resolved_quality(url: Column, marks: tuple = RESOLVED_QUALITY) -> Column:
    return first_mark(url, marks, "Unknown")


def url_pattern(url: Column) -> Column:
    """Like the formats, but of the URL as it is written."""
    out = F.lit("Unknown")
    for mark, value in reversed(URL_PATTERN):
        out = F.when(url.contains(mark), value).otherwise(out)
    return out


def bitrate(content_length: Column) -> Column:
    return F.when(content_length > 10_000_000, 8000).when(content_length > 5_000_000, 4000).when(content_length > 1_000_000, 2000).otherwise(1000)


def iframe_depth(n: Column) -> Column:
    return F.when(n == 0, 0).when(n < 3, 1).when(n < 8, 2).otherwise(3)


def download_score(quality: Column, url: Column, kind: Column, is_stream: Column) -> Column:
    """The best mark of quality or URL, and the format's bonus."""
    text = F.lower(F.concat_ws("\n", quality, url))
    best = F.greatest(F.lit(0), *[F.when(text.contains(m), s).otherwise(0) for m, s in DOWNLOAD_SCORE])
    return best + F.when(kind == "mp4", 10).when(kind == "webm", 5).when(is_stream, -5).otherwise(0)


def base_url(url: Column) -> Column:
    """Scheme and host; what has none is returned as it is."""
    scheme = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    return F.when(url_host(url) != "", F.concat(scheme, F.lit("://"), url_host(url))).otherwise(url)


def url_words(url: Column) -> Column:
    """The path in lower case with blanks for its separators; of what has no host the whole in lower case."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(url_host(url) != "", F.translate(F.lower(path), "-_/", "   ")).otherwise(F.lower(url))


def title_of_url(url: Column) -> Column:
    """The last part of the path with blanks for - and _, first letter upper; null if it has less than three characters."""
    last = F.substring_index(F.substring_index(url, "/", -1), "?", 1)
    text = F.trim(F.translate(last, "-_", "  "))
    return F.when(F.length(text) > 2, F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 100_000)))


def page_urls(url: Column, first: int, n: int) -> Column:
    """URLs of n pages from the given number on; none for what does not begin with http."""

    def page(number: Column) -> Column:
        text = number.cast("string")
        named = [F.regexp_replace(url, rf"([?&]{p}=)\d+", F.concat(F.lit("$1"), text)) for p in ("page", "paged")]
        return (
            F.when(url.rlike(r"[?&]page=\d+"), named[0]).when(url.rlike(r"[?&]paged=\d+"), named[1])
            .when(url.contains("?"), F.concat(url, F.lit("&page="), text)).otherwise(F.concat(F.regexp_replace(url, "/+$", ""), F.lit("/page/"), text))
        )

    return F.when(url.startswith("http"), F.transform(F.sequence(F.lit(first), F.lit(first + n - 1)), page)).otherwise(F.array().cast("array<string>"))


def search_url(base: Column, query: Column, page: Column) -> Column:
    return F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/search?q="), F.url_encode(query), F.lit("&page="), page.cast("string"))


def analysed_search_url(base: Column, query: Column, form: Column, has_api: Column, endpoints: Column) -> Column:
    """By the form's action, else the search endpoint, else the common path; blanks of the query become plus signs."""
    q = F.replace(query, F.lit(" "), F.lit("+"))
    action = F.trim(F.translate(F.substring_index(F.substring_index(form, "action=", -1), "]", 1), "'\"", ""))
    return (
        F.when(form.isNotNull(), F.concat(base, action, F.lit("?q="), q)).when(has_api & endpoints.contains("/api/search"), F.concat(base, F.lit("/api/search?q="), q))
        .otherwise(F.concat(base, F.lit("/search?q="), q))
    )


def url_variants(url: Column) -> Column:
    """The URL with and without www., for mobiles, and with the other scheme, each once."""
    swap = lambda a, b: F.replace(url, F.lit(a), F.lit(b))
    www = F.when(url.contains("://www."), swap("://www.", "://")).otherwise(swap("://", "://www."))
    scheme = F.when(url.startswith("https://"), swap("https://", "http://")).otherwise(swap("http://", "https://"))
    return F.array_distinct(F.array(url, www, swap("://www.", "://m."), swap("://", "://m."), scheme))


def backoff_ms(attempt: Column, delay: Column) -> Column:
    """The given delay, or a doubling one up to 8 seconds."""
    return F.when(delay > 0, delay).otherwise(F.least(F.pow(F.lit(2), F.least(attempt, F.lit(6))) * 100, F.lit(8000))).cast("long")
