"""Scores of results and providers by learned state, and decisions by rules, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sieveworks.functions import similarity as M
from sieveworks.functions.querytext import EXPANSIONS
from sieveworks.functions.scores import any_of

# Fixed values.
QUALITY_WEIGHTS = {"4k": 1.0, "2160p": 1.0, "1080p": 0.9, "full hd": 0.9, "720p": 0.7, "hd": 0.7, "480p": 0.5, "sd": 0.4, "360p": 0.3, "240p": 0.2}
QUALITY_WORDS = ("hdr", "dolby", "atmos", "remux", "bluray", "blu-ray", "webrip", "web-dl", "hdtv", "proper", "repack")
RISK_WORDS = ("cam", "ts", "telesync", "hdcam", "workprint", "screener")


def quality_weight(title: Column, tag: Column) -> Column:
    """The best quality mark of title or tag, a tenth more for a quality word, at most 1."""
    low, own = F.lower(title), F.coalesce(F.lower(tag), F.lit(""))
    best = F.greatest(*[F.when(own.contains(q) | low.contains(q), w).otherwise(0.0) for q, w in QUALITY_WEIGHTS.items()])
    return F.least(best + F.when(any_of(low, QUALITY_WORDS), 0.1).otherwise(0.0), F.lit(1.0))


def result_relevance(title: Column, description: Column, tag: Column, thumbnail: Column, seeders: Column, rating: Column, terms: list[str]) -> Column:
    """0 to 100 for the terms of a query (single words, then pairs): whole phrase, words by place, pairs, related words, quality."""
    t, d = F.lower(title), F.lower(F.coalesce(description, F.lit("")))
    single, pairs = [x for x in terms if " " not in x], [x for x in terms if " " in x]
    words = F.split(t, r"\W+")
    score = F.when(t.contains(" ".join(single)), 50.0).otherwise(0.0) if single else F.lit(0.0)
    for i, x in enumerate(single):
        weight = 1 - min(i * 0.08, 0.5)
        inside = 30 * weight + F.when(F.array_contains(words, x), 15 * weight).otherwise(0.0) + F.when(t.startswith(x), 20.0).otherwise(0.0)
        begins = F.exists(words, _begins(x))
        score = score + F.when(t.contains(x), inside).otherwise(F.when(begins, 8 * weight).otherwise(0.0)) + F.when(d.contains(x), 8 * weight).otherwise(0.0)
        for near in EXPANSIONS.get(x, ()):
            score = score + F.when(t.contains(near) & ~t.contains(x), 10.0).otherwise(0.0)
    for x in pairs:
        score = score + F.when(t.contains(x), 25.0).when(d.contains(x), 8.0).otherwise(0.0)
    score = score + quality_weight(title, tag) * 20 + F.when(F.coalesce(thumbnail, F.lit("")) != "", 5.0).otherwise(0.0)
    shared = F.when(seeders > 1000, 15.0).when(seeders > 100, 10.0).when(seeders > 10, 5.0).when(seeders > 0, 2.0).when(seeders.isNotNull(), -5.0).otherwise(0.0)
    score = score + shared + F.coalesce(rating, F.lit(0.0)) - F.when(any_of(t, RISK_WORDS), 15.0).otherwise(0.0)
    return F.least(F.greatest(score, F.lit(0.0)), F.lit(100.0))


def _begins(term: str):
    return lambda w: w.startswith(term) & (F.length(w) <= len(term) + 3)


def overall_score(success: Column, consistency: Column, ms: Column) -> Column:
    speed = F.when(ms < 1000, 1.0).when(ms < 3000, 0.8).when(ms < 5000, 0.6).when(ms < 10_000, 0.4).otherwise(0.2)
    return success * 0.5 + consistency * 0.3 + speed * 0.2


def provider_points(success: Column, ms: Column, health: Column, kind: Column, query: Column, overall: Column, consistency: Column, failure: Column) -> Column:
    """0 to 200 of a provider for a query; overall, consistency and failure are null for one without learned state."""
    speed = F.when(ms < 1000, 20.0).when(ms < 3000, 15.0).when(ms < 5000, 10.0).when(ms < 10_000, 5.0).otherwise(0.0)
    learned = F.coalesce(overall * 30, F.lit(0.0)) + F.when(consistency > 0.8, 15.0).otherwise(0.0) - F.when(failure > 0.5, 20.0).otherwise(0.0)
    return F.least(F.greatest(success * 100 + speed + learned + F.when(M.fits_category(kind, query), 25.0).otherwise(0.0) + health * 10, F.lit(0.0)), F.lit(200.0))


def failure_risk(failure: Column, consistency: Column, recent: Column) -> Column:
    """struct(likelihood, advice); 0.2 and its own advice where nothing is known."""
    risk = F.coalesce(failure * (1 - consistency) * F.when(recent, 1.5).otherwise(1.0), F.lit(0.2))
    advice = (
        F.when(failure.isNull(), "First time scraping - proceed with caution").when(risk > 0.7, "Use headless browser with extended timeout")
        .when(risk > 0.4, "Try standard scraping with retry").otherwise("Proceed normally")
    )
    return F.struct(risk.alias("likelihood"), advice.alias("advice"))


def quality_option_score(quality: Column, file_size: Column) -> Column:
    base = F.lit(0.3)
    for q, w in QUALITY_WEIGHTS.items():
        base = F.when(F.lower(quality) == q, w).otherwise(base)
    size = F.when(file_size.isNull(), 0.0).when(file_size > 10_000_000_000, 0.9).when(file_size > 5_000_000_000, 0.8).when(file_size > 2_000_000_000, 0.7).when(file_size > 1_000_000_000, 0.6).otherwise(0.5)
    return base * 0.7 + size * 0.3


def recommended_strategy(known: Column, needs_script: Column, has_api: Column, own: Column, failures: Column) -> Column:
    """By what an analysis says (known: whether there is one) and which strategies failed before."""
    failed = lambda s: F.array_contains(failures, s)
    return (
        F.when(~known, "HTML_PARSING").when(needs_script & failed("DYNAMIC_CONTENT"), "HEADLESS_BROWSER").when(needs_script, "DYNAMIC_CONTENT")
        .when(has_api & (F.size(failures) == 0), "API_BASED").when(failed("HTML_PARSING") & failed("DYNAMIC_CONTENT"), "HEADLESS_BROWSER")
        .when(failed("HTML_PARSING"), "DYNAMIC_CONTENT").otherwise(own)
    )


def recovery_action(error: Column) -> Column:
    """The name of what to do about an error; a label only, as no route to a site is built here."""
    low = F.lower(error)
    return (
        F.when(any_of(low, ("403", "geo", "blocked")), "USE_PROXY").when(any_of(low, ("quality", "format")), "TRY_ALTERNATE_QUALITY")
        .when(any_of(low, ("timeout", "connection")), "RETRY_WITH_DELAY").when(low.contains("proxy"), "ROTATE_PROXY").otherwise("RETRY_WITH_DELAY")
    )


def extraction_strategy(kind: Column, methods: Column) -> Column:
    both = F.exists(methods, lambda m: m.contains("JSON")) & F.exists(methods, lambda m: m.contains("HTML"))
    return F.when(kind.isin("JSON_API", "JSON_LD"), "API_FIRST").when(kind.isin("NEXTJS", "NUXTJS"), "FRAMEWORK_DATA").when(both, "HYBRID").otherwise("HTML_PARSING")
