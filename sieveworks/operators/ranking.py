"""The search ranking plan: scores, cross-provider boost, adaptive thresholds, top and related lists, display filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveworks.functions import scores as S
from sieveworks.functions.urls import url_words
from sieveworks.operators.lists import keep_first
from sieveworks.operators.relevance import SYNONYMS, edits_of, terms_of
from sieveworks.sources.store import write_table

# Marks of category pages in URLs, and names of generic categories.
CATEGORY_URLS = ("/genre/", "/category/", "/browse/", "/filter/", "/tags/", "/type/", "/sort/", "/order/", "?genre=", "?category=", "?type=", "/all-", "/list/genre", "/movies/genre")
GENERIC_TITLES = (
    "action", "comedy", "drama", "horror", "thriller", "romance", "sci-fi", "documentary", "animation", "anime", "sports", "news",
    "music", "kids", "family", "adventure", "fantasy", "crime", "mystery", "western", "war", "history", "biography", "all movies",
    "all videos", "trending", "popular", "latest", "new releases", "top rated", "most viewed", "recommended",
)
LEAST_TOP, RELATED_SHARE, TOP_ROWS, RELATED_ROWS = 15.0, 0.4, 30, 50
LEAST_AFFINE = 8.0
#: A top list shorter than this is filled up; points of rows found by related words, and how many of them.
SHORT_TOP, LEAST_RELATED, NEAR_POINTS, NEAR_ROWS = 8, 5.0, 7.0, 8


def final_score(rows: DataFrame) -> DataFrame:
    """results joined with providers (searches, failed, avg_ms, health), relevance (0 to 1) and preference boost (points): score
    on 0 to 100 before the boost across providers."""
    parts = {
        "text": F.coalesce("relevance", F.lit(0.0)),
        "provider": S.provider_score(F.col("searches"), F.col("failed"), F.col("avg_ms"), F.col("health")),
        "fresh": S.freshness(F.col("date")),
        "engagement": S.engagement(F.col("seeders"), F.col("views"), F.col("rating")),
        "quality": S.quality(F.col("title"), F.col("quality"), F.col("thumbnail"), F.col("description")),
    }
    total = None
    for name, value in parts.items():
        term = value * S.WEIGHTS[name]
        total = term if total is None else total + term
    score = F.round(total * 100.0 + F.coalesce("boost", F.lit(0.0)), 6)
    return rows.withColumn("score", F.least(F.greatest(score, F.lit(0.0)), F.lit(100.0)))


def cross_provider_boost(rows: DataFrame) -> DataFrame:
    """Adds n_providers, those that return a URL, and lifts the score by a tenth for each besides the first. The
    distinct count is an aggregate joined back, so a URL with many rows is combined before the shuffle. The scored rows are
    written, as they are read for the count and for the join."""
    keyed = write_table(rows.withColumn("norm_url", S.normal_url(F.col("url"))), "scored-rows")
    seen = keyed.groupBy("norm_url").agg(F.count_distinct("provider_id").alias("n_providers"))
    lifted = F.least(F.lit(100.0), F.round(F.col("score") * (1 + 0.1 * (F.col("n_providers") - 1)), 6))
    return keyed.join(seen, "norm_url").withColumn("score", F.when(F.col("n_providers") > 1, lifted).otherwise(F.col("score")))


def thresholds(rows: DataFrame) -> DataFrame:
    """One row: n, top_from and related_from; fewer results lower the bar."""
    share = F.when(F.col("n") < 10, 0.60).when(F.col("n") < 30, 0.75).when(F.col("n") < 60, 0.90).otherwise(1.0)
    bar = rows.agg(F.count("*").alias("n")).withColumn("top_from", LEAST_TOP * share)
    return bar.withColumn("related_from", F.col("top_from") * RELATED_SHARE)


def _capped(rows: DataFrame, order: list, n: int) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def _appended(first: DataFrame, more: DataFrame, when: Column) -> DataFrame:
    """The list (stage, at, pos, url, title, score), and more after it where when holds of its row count n; then the first of each URL
    stays. Where it does not hold the list stays as it is."""
    counted = first.agg(F.count("*").alias("n"))
    stage = first.agg(F.coalesce(F.max("stage"), F.lit(0)).alias("last"))
    added = more.crossJoin(F.broadcast(counted)).where(when).drop("n").crossJoin(F.broadcast(stage)).withColumn("stage", F.col("last") + 1).drop("last")
    both = first.unionByName(added.select(*first.columns))
    # Lists of bounded length: a window over all of one is small.
    n = F.row_number().over(Window.partitionBy("url").orderBy("stage", "at"))
    grown = both.withColumn("n_url", n).crossJoin(F.broadcast(counted)).where(~when | (F.col("n_url") == 1))
    return grown.select(*first.columns)


def top_and_related(rows: DataFrame, query: str) -> DataFrame:
    """The two result lists (segment, rank, pos, title, score) of scored rows (pos, title, description, url, score).

    In the top list the first-seen row of equal titles stays, in the related list the best-scored one, as one is
    deduplicated before and the other after sorting. Where the top list is short, rows with related words of the query join it
    (7 points more), then the best of the related list, which leave that, then rows with any word of the query, near spellings
    included. What the passes ask of a text is settled where it is read, so only narrow rows are used again. An empty table
    gives no rows."""
    terms = [t for t in query.lower().split() if len(t) > 1]
    near = list(dict.fromkeys(n for t in terms for n in SYNONYMS.get(t, ())))
    keys = terms_of(query)
    text = F.lower(F.concat_ws(" ", "title", F.coalesce("description", F.lit(""))))
    t, d = F.lower("title"), F.lower(F.coalesce("description", F.lit("")))
    by_near = S.any_of(t, tuple(near)) | S.any_of(d, tuple(near)) if near else F.lit(False)
    combined = F.concat_ws(" ", text, url_words(F.col("url")))
    words = F.split(combined, r"\W+")
    by_key = S.any_of(combined, tuple(keys)) if len(keys) > 1 else F.lit(False)
    for k in keys if len(keys) > 1 else []:
        by_key = by_key | F.exists(words, _within(k))
    narrow = write_table(rows.select("pos", "url", "title", "score", S.normal_title(F.col("title")).alias("norm_title"), by_near.alias("by_near"), by_key.alias("by_key")), "ranked-rows")
    barred = narrow.crossJoin(F.broadcast(thresholds(narrow)))
    best = [F.desc("score"), "pos"]

    def listed(found: DataFrame) -> DataFrame:
        """A list of bounded length, written, as the passes use it several times."""
        return write_table(found.select(F.lit(0).alias("stage"), F.row_number().over(Window.orderBy(*best)).alias("at"), "pos", "url", "title", "score"), "ranked-list")

    top = listed(_capped(keep_first(barred.where("score >= top_from"), ["norm_title"], ["pos"]), best, TOP_ROWS))
    related = barred.where("score < top_from AND score >= related_from")
    related = listed(_capped(keep_first(related, ["norm_title"], best), best, RELATED_ROWS))
    short = F.col("n") < SHORT_TOP

    def others(*lists: DataFrame) -> DataFrame:
        """Rows whose URL is in none of the lists."""
        rest = narrow
        for one in lists:
            rest = rest.join(F.broadcast(one.select(F.col("url").alias("seen"))), F.col("url") == F.col("seen"), "left_anti")
        return rest

    by_words = listed(_capped(others(top, related).where(F.col("by_near") & (F.col("score") >= LEAST_RELATED)), best, NEAR_ROWS)).withColumn("score", F.col("score") + NEAR_POINTS)
    second = write_table(_capped(_appended(top, by_words, short), ["stage", "at"], TOP_ROWS), "ranked-list")
    moved = related.crossJoin(F.broadcast(second.agg(F.count("*").alias("have")))).where((F.col("have") < SHORT_TOP) & (F.col("at") <= SHORT_TOP - F.col("have"))).drop("have")
    third = write_table(_appended(second, moved, short), "ranked-list")
    left = related.join(F.broadcast(third.select(F.col("url").alias("seen"))), F.col("url") == F.col("seen"), "left_anti")
    few = second.agg((F.count("*") < SHORT_TOP).alias("few"))
    kept = related.crossJoin(F.broadcast(few)).where("NOT few").drop("few").unionByName(left.crossJoin(F.broadcast(few)).where("few").drop("few"))
    by_keys = listed(_capped(others(third, kept).where("by_key"), best, SHORT_TOP)).withColumn("score", F.greatest("score", F.lit(LEAST_RELATED)))
    last = _capped(_appended(third, by_keys, short), ["stage", "at"], TOP_ROWS)
    both = last.withColumn("segment", F.lit("top")).unionByName(kept.withColumn("segment", F.lit("related")))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("segment").orderBy("stage", "at"))).select("segment", "rank", "pos", "url", "title", "score")


def _within(term: str):
    return lambda w: F.levenshtein(w, F.lit(term)) <= edits_of(term)


def has_affinity(query: str) -> Column:
    """Whether a row (title, description, url, score) has to do with the query."""
    terms = S.query_terms(query, 2)
    if not terms:
        return F.lit(True)
    combined = F.lower(F.concat_ws(" ", "title", F.coalesce("description", F.lit("")), "url"))
    return S.any_of(combined, tuple(terms)) | (F.col("score") >= LEAST_AFFINE) | F.lower("url").contains("".join(query.lower().split()))


def display_filter(rows: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Structurally valid rows, the first of each URL; those with affinity, or all if none has; best score first."""
    title = F.lower("title")
    generic = F.trim(title).isin(*GENERIC_TITLES) & (F.coalesce("thumbnail", F.lit("")) == "")
    valid = rows.where((F.length("title") >= 3) & ~S.any_of(F.lower("url"), CATEGORY_URLS) & ~generic)
    valid = keep_first(valid, ["url"], ["pos"]).withColumn("affine", has_affinity(query)).select("pos", "url", "title", "score", "affine")
    valid = write_table(valid, "display-rows")
    some = valid.agg(F.coalesce(F.max("affine"), F.lit(False)).alias("some"))
    return valid.crossJoin(F.broadcast(some)).where("affine OR NOT some").orderBy(F.desc("score"), "pos").limit(limit).drop("some")


def normalise(rows: DataFrame, per_provider: int = 50) -> DataFrame:
    """Trimmed titles of 3 characters at least, absolute URLs without scripts, no inline thumbnails; the first of each URL
    and provider, so many of each provider. rows: results with base_url."""
    url = S.resolve_url(F.col("url"), F.col("base_url"))
    thumb = F.when((F.trim("thumbnail") != "") & ~F.lower("thumbnail").startswith("data:"), S.resolve_url(F.col("thumbnail"), F.col("base_url")))
    valid = rows.withColumns({"title": F.trim("title"), "thumbnail": thumb}).where((F.length("title") >= 3) & (F.trim("url") != ""))
    valid = valid.withColumn("url", url).where(~F.lower("url").contains("javascript:"))
    kept = keep_first(valid, ["provider_id", "url"], ["pos"])
    place = F.row_number().over(Window.partitionBy("provider_id").orderBy("pos"))
    return kept.withColumn("place", place).where(F.col("place") <= per_provider)
