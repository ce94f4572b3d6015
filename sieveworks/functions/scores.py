"""Scalar functions on results: relevance, freshness, engagement, quality, providers, URLs and media, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Quality words and their scores, tested as substrings.
QUALITY_WORDS = {
    "4k": 1.0, "2160p": 1.0, "1080p": 0.9, "full hd": 0.9, "720p": 0.7, "hd": 0.7, "bluray": 0.85, "blu-ray": 0.85,
    "remux": 0.95, "web-dl": 0.8, "webrip": 0.75, "hdtv": 0.7, "cam": 0.2, "ts": 0.25, "screener": 0.3,
}
# Media marks in URLs, first match wins.
MEDIA_QUALITY = (("2160", "4K"), ("4k", "4K"), ("1440", "1440p"), ("1080", "1080p"), ("720", "720p"), ("480", "480p"), ("360", "360p"), ("240", "240p"), (".m3u8", "Auto"), (".mpd", "Auto"))
MEDIA_FORMAT = ((".m3u8", "hls"), (".mpd", "dash"), (".mp4", "mp4"), (".webm", "webm"), (".mkv", "mkv"), (".ts", "ts"))
STREAM_TYPE = ((".m3u8", "HLS"), ("/hls/", "HLS"), (".mpd", "DASH"), ("/dash/", "DASH"), (".mp4", "PROGRESSIVE"), (".webm", "PROGRESSIVE"))
EXTENSION = ((".mp4", ".mp4"), (".m3u8", ".mp4"), (".webm", ".webm"), (".mkv", ".mkv"), (".avi", ".avi"), (".mov", ".mov"))
MIME = {".mp4": "video/mp4", ".m4v": "video/mp4", ".webm": "video/webm", ".mkv": "video/x-matroska", ".ts": "video/mp2t", ".mov": "video/quicktime"}
MEDIA_SCORE = (("2160", 100), ("4k", 100), ("uhd", 100), ("1440", 90), ("2k", 90), ("1080", 80), ("fhd", 80), ("fullhd", 80), ("720", 60), ("hd", 60), ("480", 40), ("sd", 40), ("360", 25), ("240", 15), ("144", 5))
PROVIDER_KINDS = (("TORRENT", ("torrent", "1337", "rarbg", "pirate")), ("STREAMING", ("stream", "movie", "watch", "video")), ("NEWS", ("news", "blog")), ("API_BASED", ("api",)))
WEIGHTS = {"text": 0.60, "provider": 0.05, "fresh": 0.08, "engagement": 0.15, "quality": 0.12}


def any_of(text: Column, parts: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for p in parts:
        found = found | text.contains(p)
    return found


def first_mark(text: Column, marks: tuple, otherwise) -> Column:
    """The value of the first mark that the lower-cased text contains."""
    low, out = F.lower(text), F.lit(otherwise)
    for mark, value in reversed(marks):
        out = F.when(low.contains(mark), F.lit(value)).otherwise(out)
    return out


def normal_title(title: Column) -> Column:
    return F.substring(F.regexp_replace(F.lower(title), "[^a-z0-9]", ""), 1, 50)


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1)


def url_domain(url: Column) -> Column:
    """Host without www.; what has no scheme and host is returned as it is."""
    host = url_host(url)
    return F.when(host != "", F.regexp_replace(host, r"^www\.", "")).otherwise(url)


def normal_url(url: Column) -> Column:
    """Host without www. and path without trailing slashes, lower-cased; query and fragment go."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    joined = F.concat(F.lower(F.regexp_replace(url_host(url), r"^www\.", "")), F.lower(F.regexp_replace(path, "/+$", "")))
    return F.when(url_host(url) != "", joined).otherwise(F.regexp_replace(F.lower(url), "/+$", ""))


def resolve_url(url: Column, base: Column) -> Column:
    root = F.regexp_replace(base, "/+$", "")
    return (
        F.when(url.startswith("http"), url).when(url.startswith("//"), F.concat(F.lit("https:"), url))
        .when(url.startswith("/"), F.concat(root, url)).when(url == "", base).otherwise(F.concat(root, F.lit("/"), url))
    )


def full_url(url: Column) -> Column:
    trimmed = F.trim(url)
    schemed = F.when(trimmed.startswith("http://") | trimmed.startswith("https://"), trimmed).otherwise(F.concat(F.lit("https://"), trimmed))
    return F.regexp_replace(schemed, "/+$", "")


def site_name(url: Column) -> Column:
    first = F.split(F.regexp_replace(url_host(url), r"^www\.", ""), r"\.")[0]
    return F.when(url_host(url) != "", F.concat(F.upper(F.substring(first, 1, 1)), F.substring(first, 2, 1000))).otherwise("Unknown")


def provider_kind(url: Column) -> Column:
    out = F.lit("GENERAL")
    for kind, marks in reversed(PROVIDER_KINDS):
        out = F.when(any_of(F.lower(url), marks), kind).otherwise(out)
    return out


def first_number(text: Column) -> Column:
    """The first run of digits as an int; null without one, or where it overflows."""
    return F.regexp_extract(text, r"(\d+)", 1).try_cast("int")


def freshness(date: Column) -> Column:
    low = F.lower(date)
    number = F.coalesce(first_number(low), F.lit(99))
    return (
        F.when(date.isNull() | (date == ""), 0.3).when(any_of(low, ("today", "hour")), 1.0).when(low.contains("yesterday"), 0.9)
        .when(low.contains("day") & (number <= 7), 0.8).when(low.contains("week") & (number <= 2), 0.7)
        .when(low.contains("month") & (number <= 1), 0.6).when(low.contains("month") & (number <= 3), 0.5)
        .when(low.contains("year") & (number <= 1), 0.3).otherwise(0.2)
    )


def _bands(value: Column, bands: tuple, otherwise: float) -> Column:
    out = F.lit(otherwise)
    for least, score in reversed(bands):
        out = F.when(value >= least, score).otherwise(out)
    return out


def engagement(seeders: Column, views: Column, rating: Column) -> Column:
    """Mean of the banded signals that are there; 0 without any."""
    parts = (
        F.when(seeders.isNotNull(), _bands(seeders, ((1000, 1.0), (100, 0.8), (10, 0.5), (1, 0.3)), 0.1)),
        F.when(views.isNotNull(), _bands(views, ((1_000_000, 1.0), (100_000, 0.8), (10_000, 0.6), (1000, 0.4)), 0.2)),
        F.when(rating.isNotNull(), F.least(F.greatest(rating / 10.0, F.lit(0.0)), F.lit(1.0))),
    )
    total = sum((F.coalesce(p, F.lit(0.0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0.0)))
    number = sum((p.isNotNull().cast("int") for p in parts[1:]), parts[0].isNotNull().cast("int"))
    return F.when(number > 0, total / number).otherwise(0.0)


def quality(title: Column, tag: Column, thumbnail: Column, description: Column) -> Column:
    """The best quality word in title or tag, and small bonuses, at most 1."""
    scores = []
    for word, score in QUALITY_WORDS.items():
        scores.append(F.when(F.lower(title).contains(word) | F.coalesce(F.lower(tag).contains(word), F.lit(False)), score).otherwise(0.0))
    there = lambda c: F.when(F.coalesce(c, F.lit("")) != "", 0.05).otherwise(0.0)
    return F.least(F.greatest(*scores) + there(thumbnail) + there(description), F.lit(1.0))


def provider_score(searches: Column, failed: Column, ms: Column, health: Column) -> Column:
    rate = F.when(searches > 0, (1.0 - failed / searches) * 0.3).otherwise(0.0)
    speed = F.when(ms < 1000, 0.1).when(ms < 3000, 0.05).otherwise(0.0)
    return F.least(F.greatest(F.lit(0.5) + rate + speed + health * 0.1, F.lit(0.0)), F.lit(1.0))


def query_terms(query: str, longer_than: int) -> list[str]:
    return [t for t in query.lower().split() if len(t) > longer_than]


def simple_relevance(title: Column, query: str) -> Column:
    """50 for the whole query, 10 for each of its terms in the title and 5 more where the title starts with it; at most 100."""
    low, terms = F.lower(title), query_terms(query, 1)
    if not terms:
        return F.lit(0.0)
    score = F.when(low.contains(query.lower()), 50.0).otherwise(0.0)
    for t in terms:
        score = score + F.when(low.contains(t), F.when(low.startswith(t), 15.0).otherwise(10.0)).otherwise(0.0)
    return F.least(score, F.lit(100.0))


def occurrences(text: Column, term: str) -> Column:
    """Occurrences that do not overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("int")


def most_edits(word: Column) -> Column:
    return F.when(F.length(word) <= 3, 0).when(F.length(word) <= 5, 1).otherwise(2)


def ngrams(text: Column, n: int) -> Column:
    """Distinct character n-grams; a shorter text is its own."""
    every = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n))))
    return F.when(F.length(text) < n, F.array(text)).otherwise(every)


def is_stream_url(url: Column) -> Column:
    return any_of(F.lower(url), (".m3u8", ".mpd", "/hls/", "/dash/"))


def media_quality(url: Column) -> Column:
    return first_mark(url, MEDIA_QUALITY, "Unknown")


def media_format(url: Column) -> Column:
    return first_mark(url, MEDIA_FORMAT, "mp4")


def stream_type(url: Column) -> Column:
    return first_mark(url, STREAM_TYPE, "UNKNOWN")


def media_score(url: Column) -> Column:
    return first_mark(url, MEDIA_SCORE, 30)


def extension(url: Column) -> Column:
    return first_mark(url, EXTENSION, ".mp4")


def mime_type(ext: Column) -> Column:
    out = F.lit("application/octet-stream")
    for e, m in MIME.items():
        out = F.when(F.lower(ext) == e, m).otherwise(out)
    return out
