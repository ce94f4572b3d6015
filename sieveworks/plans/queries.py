"""The named queries of the search domain, each with its SQL on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveworks.functions import querytext as N
from sieveworks.functions import scores as S
from sieveworks.operators import folds, health, lists, profile, ranking, relevance
from sieveworks.plans.registry import FOUND, query
from sieveworks.sources import jsonbody
from sieveworks.sources import pages as P
from sieveworks.sources import tables as T
from sieveworks.streaming import health as stream

QUERY = "the of and"


TEXT_QUERY = "then onion movie thand"


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    known = T.providers(spark, sf).select(F.col("id").alias("provider_id"), "searches", "failed", "avg_ms", "health")
    rows = profile.preference_boost(T.results(spark, sf), T.likes(spark, sf))
    return ranking.final_score(relevance.with_relevance(rows, TEXT_QUERY).join(known, "provider_id"))


def _like(text: str, marks, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower({text}), '{m}') THEN {v!r}" for m, v in marks) + f" ELSE {otherwise} END"


_NORM_TITLE = "substr(regexp_replace(lower(title), '[^a-z0-9]', '', 'g'), 1, 50)"
_NORM_URL = r"lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1), '^www\.', '')) || lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', ''))"
_FRESH = """CASE WHEN date IS NULL OR date = '' THEN 0.3 WHEN contains(lower(date), 'today') OR contains(lower(date), 'hour') THEN 1.0 WHEN contains(lower(date), 'yesterday') THEN 0.9
 WHEN contains(lower(date), 'day') AND nr <= 7 THEN 0.8 WHEN contains(lower(date), 'week') AND nr <= 2 THEN 0.7 WHEN contains(lower(date), 'month') AND nr <= 1 THEN 0.6
 WHEN contains(lower(date), 'month') AND nr <= 3 THEN 0.5 WHEN contains(lower(date), 'year') AND nr <= 1 THEN 0.3 ELSE 0.2 END::DOUBLE"""
_NUMBER = r"coalesce(try_cast(regexp_extract(lower(date), '(\d+)', 1) AS INT), 99)"
_SEED = "CASE WHEN seeders >= 1000 THEN 1.0 WHEN seeders >= 100 THEN 0.8 WHEN seeders >= 10 THEN 0.5 WHEN seeders >= 1 THEN 0.3 WHEN seeders IS NOT NULL THEN 0.1 END::DOUBLE"
_VIEW = "CASE WHEN views >= 1000000 THEN 1.0 WHEN views >= 100000 THEN 0.8 WHEN views >= 10000 THEN 0.6 WHEN views >= 1000 THEN 0.4 WHEN views IS NOT NULL THEN 0.2 END::DOUBLE"
_ENGAGE = f"coalesce(list_avg(list_filter([{_SEED}, {_VIEW}, least(greatest(rating / 10, 0), 1)], lambda x: x IS NOT NULL)), 0)"
_QUALITY = "least(greatest(" + ", ".join(f"CASE WHEN contains(lower(title), '{w}') OR contains(lower(coalesce(quality, '')), '{w}') THEN {s} ELSE 0 END::DOUBLE" for w, s in S.QUALITY_WORDS.items()) + ") + CASE WHEN coalesce(thumbnail, '') <> '' THEN 0.05 ELSE 0 END::DOUBLE + CASE WHEN coalesce(description, '') <> '' THEN 0.05 ELSE 0 END::DOUBLE, 1)"
_PROVIDER = "least(greatest(0.5::DOUBLE + CASE WHEN searches > 0 THEN (1 - failed / searches) * 0.3 ELSE 0 END::DOUBLE + CASE WHEN avg_ms < 1000 THEN 0.1 WHEN avg_ms < 3000 THEN 0.05 ELSE 0 END::DOUBLE + health * 0.1, 0), 1)"
_SIMPLE = "least(CASE WHEN contains(lower(title), 'the of and') THEN 50 ELSE 0 END" + "".join(f" + CASE WHEN contains(lower(title), '{t}') THEN CASE WHEN starts_with(lower(title), '{t}') THEN 15 ELSE 10 END ELSE 0 END" for t in QUERY.split()) + ", 100)::DOUBLE"
_PREFERENCE = rf"""WITH kc AS (SELECT keyword, count(*) AS n FROM (SELECT unnest(string_split(title_keywords, ',')) AS keyword FROM likes) WHERE trim(keyword) <> '' GROUP BY 1), kw AS (SELECT keyword, n / (SELECT max(n) FROM kc) AS w FROM kc),
 bw AS (SELECT pos, least(sum(w) * 10, 10) AS b FROM (SELECT pos, unnest(string_split_regex(lower(title), '\W+')) AS keyword FROM results) JOIN kw USING (keyword) WHERE length(keyword) > 2 GROUP BY pos),
 pc AS (SELECT provider_id, count(*) AS n FROM likes GROUP BY 1), qc AS (SELECT lower(quality) AS tag, count(*) AS n FROM likes WHERE trim(quality) <> '' GROUP BY 1)
 SELECT r.pos, coalesce(b, 0) + coalesce(pc.n / (SELECT max(n) FROM pc) * 5, 0) + coalesce(qc.n / (SELECT max(n) FROM qc) * 3, 0) + CASE WHEN url IN (SELECT url FROM likes) THEN 15 ELSE 0 END AS boost
 FROM results r LEFT JOIN bw USING (pos) LEFT JOIN pc USING (provider_id) LEFT JOIN qc ON lower(r.quality) = qc.tag"""


def _text_sql() -> str:
    terms, near = relevance.terms_of(TEXT_QUERY), relevance.SYNONYMS
    quoted = lambda items: "[" + ", ".join(f"'{i}'" for i in items) + "]::VARCHAR[]"
    values = ", ".join(f"('{t}', {relevance.edits_of(t)}, {quoted(dict.fromkeys(t[i : i + 3] for i in range(len(t) - 2)))}, {quoted(near.get(t, ()))}, '{t[:-1]}')" for t in terms)
    last = "0"
    order = []
    for t in terms:
        last = f"(CASE WHEN strpos(substr(t, {last} + 1), '{t}') > 0 THEN strpos(substr(t, {last} + 1), '{t}') + {last} ELSE NULL END)"
        order.append(f"{last} IS NOT NULL")
    edit = lambda ws: f"list_filter(list_transform({ws}, lambda w: levenshtein(w, term)), lambda x: x >= 1 AND x <= edits)[1]"
    n = len(terms)
    return f"""WITH base AS (SELECT pos, title, lower(title) AS t, lower(coalesce(description, '')) AS d FROM results),
 words AS (SELECT *, list_filter(string_split_regex(t, '\\W+'), lambda w: length(w) > 1) AS tw, list_filter(string_split_regex(d, '\\W+'), lambda w: length(w) > 1) AS dw,
   CASE WHEN length(t) < 3 THEN [t] ELSE list_distinct(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3))) END AS tg FROM base),
 q(term, edits, grams, near, stem) AS (VALUES {values}),
 each AS (SELECT *, (length(t) - length(replace(t, term, ''))) / length(term) AS n_t, (length(d) - length(replace(d, term, ''))) / length(term) AS n_d, {edit('tw')} AS t_edit, {edit('dw')} AS d_edit,
   len(list_intersect(grams, tg)) / len(grams) AS share FROM words, q),
 marks AS (SELECT *, n_t > 0 AS here, n_d > 0 AS there, NOT n_t > 0 AND t_edit IS NOT NULL AS fuzzy, NOT n_t > 0 AND t_edit IS NULL AND length(term) >= 4 AND share >= 0.5 AS gram,
   NOT n_t > 0 AND len(list_filter(near, lambda s: contains(t, s))) > 0 AS syn FROM each),
 sums AS (SELECT pos, sum(CASE WHEN here THEN (1 + ln(n_t)) * 7 + greatest(0, 8 - (strpos(t, term) - 1) / 12) ELSE 0 END + CASE WHEN fuzzy THEN 8 * (1 - t_edit / (edits + 1)) ELSE 0 END + CASE WHEN gram THEN 5 * share ELSE 0 END
   + CASE WHEN syn THEN 7 ELSE 0 END + CASE WHEN NOT here AND contains(t, stem) THEN 7.2::DOUBLE ELSE 0 END
   + CASE WHEN there THEN (1 + ln(n_d)) * 5 ELSE CASE WHEN d_edit IS NOT NULL THEN 4.8::DOUBLE ELSE 0 END + CASE WHEN len(list_filter(near, lambda s: contains(d, s))) > 0 THEN 3.5::DOUBLE ELSE 0 END END) AS points,
   sum(here::INT) AS h, sum(there::INT) AS dh, sum(fuzzy::INT) AS f, sum(syn::INT) AS s, sum(gram::INT) AS g,
   any_value(CASE WHEN contains(t, '{TEXT_QUERY}') THEN 40 ELSE 0 END + CASE WHEN contains(d, '{TEXT_QUERY}') THEN 25 ELSE 0 END + CASE WHEN starts_with(t, '{TEXT_QUERY}') THEN 30 ELSE 0 END + CASE WHEN {' AND '.join(order)} THEN 18 ELSE 0 END) AS whole,
   any_value(length(title) > 150) AS long FROM marks GROUP BY pos),
 final AS (SELECT *, (points + whole + 25 * CASE WHEN h = {n} THEN 1 WHEN h + f * 0.6::DOUBLE + s * 0.4::DOUBLE + g * 0.3::DOUBLE >= {n} * 0.6::DOUBLE THEN 0.6 WHEN h + dh >= {n} THEN 0.5 WHEN h + f * 0.6::DOUBLE + s * 0.4::DOUBLE + g * 0.3::DOUBLE >= {n} * 0.3::DOUBLE THEN 0.25 ELSE 0 END::DOUBLE)
   * (0.3::DOUBLE + (h + dh * 0.6::DOUBLE + f * 0.5::DOUBLE + s * 0.4::DOUBLE + g * 0.3::DOUBLE) / {n} * 0.7::DOUBLE) AS score FROM sums)
 SELECT pos, least(greatest(CASE WHEN h + dh > 0 THEN greatest(score, 2) ELSE score END * CASE WHEN long THEN 0.85 ELSE 1 END::DOUBLE, 0), 100) / 100 AS relevance FROM final"""


_SCORED = f"""rel AS ({_text_sql()}), pref AS ({_PREFERENCE}), scored AS (SELECT * EXCLUDE (nr), least(greatest(round((relevance * 0.6::DOUBLE + {_PROVIDER} * 0.05::DOUBLE + ({_FRESH}) * 0.08::DOUBLE + ({_ENGAGE}) * 0.15::DOUBLE + ({_QUALITY}) * 0.12::DOUBLE) * 100 + boost, 6), 0), 100) AS score
 FROM (SELECT r.*, p.searches, p.failed, p.avg_ms, p.health, relevance, boost, {_NUMBER} AS nr FROM results r JOIN providers p ON r.provider_id = p.id JOIN rel ON r.pos = rel.pos JOIN pref ON r.pos = pref.pos))"""
_BOOSTED = f"""{_SCORED}, keyed AS (SELECT *, {_NORM_URL} AS norm_url FROM scored), seen AS (SELECT norm_url, count(DISTINCT provider_id) AS n_providers FROM keyed GROUP BY 1),
 boosted AS (SELECT keyed.* EXCLUDE (score), n_providers, CASE WHEN n_providers > 1 THEN least(100, round(score * (1 + 0.1::DOUBLE * (n_providers - 1)), 6)) ELSE score END AS score FROM keyed JOIN seen USING (norm_url))"""
_LISTS = f"""{_BOOSTED}, bar AS (SELECT 15.0::DOUBLE * CASE WHEN count(*) < 10 THEN 0.6 WHEN count(*) < 30 THEN 0.75 WHEN count(*) < 60 THEN 0.9 ELSE 1 END::DOUBLE AS t FROM boosted),
 barred AS (SELECT *, {_NORM_TITLE} AS norm_title FROM boosted, bar),
 top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY norm_title ORDER BY pos) AS n FROM barred WHERE score >= t) WHERE n = 1 ORDER BY score DESC, pos LIMIT 30),
 related AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY norm_title ORDER BY score DESC, pos) AS n FROM barred WHERE score < t AND score >= t * 0.4::DOUBLE) WHERE n = 1 ORDER BY score DESC, pos LIMIT 50)"""


@query(f"WITH {_LISTS} SELECT 'top' AS segment, row_number() OVER (ORDER BY score DESC, pos) AS rank, pos, title, score FROM top UNION ALL SELECT 'related', row_number() OVER (ORDER BY score DESC, pos), pos, title, score FROM related")
def rank_results(spark, sf):
    found = ranking.top_and_related(ranking.cross_provider_boost(_scored(spark, sf)), TEXT_QUERY)
    return found.select("segment", F.col("rank").cast("long"), "pos", "title", "score")


@query(f"WITH {_SCORED} SELECT pos, score FROM scored")
def final_score(spark, sf):
    return _scored(spark, sf).select("pos", "score")


@query(f"WITH {_BOOSTED} SELECT pos, norm_url, n_providers, score FROM boosted")
def cross_provider_boost(spark, sf):
    return ranking.cross_provider_boost(_scored(spark, sf)).select("pos", "norm_url", "n_providers", "score")


@query(f"WITH {_BOOSTED} SELECT count(*) AS n, 15.0::DOUBLE * CASE WHEN count(*) < 10 THEN 0.6 WHEN count(*) < 30 THEN 0.75 WHEN count(*) < 60 THEN 0.9 ELSE 1 END::DOUBLE AS top_from, 6.0::DOUBLE * CASE WHEN count(*) < 10 THEN 0.6 WHEN count(*) < 30 THEN 0.75 WHEN count(*) < 60 THEN 0.9 ELSE 1 END::DOUBLE AS related_from FROM boosted")
def adaptive_threshold(spark, sf):
    return ranking.thresholds(_scored(spark, sf))


_VALID = "valid AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY pos) AS n FROM scored WHERE length(title) >= 3 AND NOT (" + " OR ".join(f"contains(lower(url), '{m}')" for m in ranking.CATEGORY_URLS) + ") AND NOT (trim(lower(title)) IN (" + ", ".join(f"'{g}'" for g in ranking.GENERIC_TITLES) + ") AND coalesce(thumbnail, '') = '')) WHERE n = 1)"
_AFFINE = "(" + " OR ".join(f"contains(lower(title || ' ' || coalesce(description, '') || ' ' || url), '{t}')" for t in ("the", "and")) + " OR score >= 8 OR contains(lower(url), 'theofand'))"


@query(f"WITH {_SCORED}, {_VALID}, marked AS (SELECT *, {_AFFINE} AS affine FROM valid) SELECT pos, url, score FROM marked WHERE affine OR NOT (SELECT coalesce(bool_or(affine), false) FROM marked) ORDER BY score DESC, pos LIMIT 20")
def display_filter(spark, sf):
    return ranking.display_filter(_scored(spark, sf), QUERY).select("pos", "url", "score")


@query(f"WITH {_SCORED} SELECT pos, {_AFFINE} AS affine FROM scored")
def query_affinity(spark, sf):
    return _scored(spark, sf).select("pos", ranking.has_affinity(QUERY).alias("affine"))


@query("""WITH valid AS (SELECT *, row_number() OVER (PARTITION BY provider_id, u ORDER BY pos) AS n FROM (SELECT pos, provider_id, trim(title) AS title, url AS u,
 CASE WHEN trim(thumbnail) <> '' AND NOT starts_with(lower(thumbnail), 'data:') THEN thumbnail END AS thumbnail FROM results) WHERE length(title) >= 3)
 SELECT * FROM (SELECT pos, provider_id, title, u AS url, thumbnail, row_number() OVER (PARTITION BY provider_id ORDER BY pos) AS place FROM valid WHERE n = 1) WHERE place <= 50""")
def normalise_results(spark, sf):
    rows = ranking.normalise(T.results(spark, sf).withColumn("base_url", F.lit("https://example.net/")))
    return rows.select("pos", "provider_id", "title", "url", "thumbnail", F.col("place").cast("long"))


@query("SELECT * FROM (SELECT url, pos, title FROM results QUALIFY row_number() OVER (PARTITION BY url ORDER BY pos) = 1)")
def dedup_keep_first(spark, sf):
    return lists.keep_first(T.results(spark, sf), ["url"], ["pos"]).select("url", "pos", "title")


@query(f"""WITH parts AS (SELECT 0 AS part, pos, url, title, 0.7::DOUBLE AS confidence FROM results UNION ALL SELECT 1, pos, url, title, rating / 10 FROM results)
 SELECT pos, url, title, confidence FROM parts QUALIFY row_number() OVER (PARTITION BY url || '|' || substr(lower(title), 1, 30) ORDER BY confidence DESC, part, pos) = 1""")
def merge_by_confidence(spark, sf):
    rows = T.results(spark, sf)
    parts = [rows.select("pos", "url", "title", F.lit(0.7).alias("confidence")), rows.select("pos", "url", "title", (F.col("rating") / 10).alias("confidence"))]
    return lists.merge_by_confidence(parts, F.concat("url", F.lit("|"), F.substring(F.lower("title"), 1, 30)), "confidence", "pos").drop("first_place")


@query(f"SELECT pos, {_NORM_TITLE} AS norm_title, {_NORM_URL} AS norm_url, regexp_replace(regexp_extract(url, '^https?://([^/?#:]*)', 1), '^www\\.', '') AS domain FROM results")
def normal_keys(spark, sf):
    u = F.col("url")
    return T.results(spark, sf).select("pos", S.normal_title(F.col("title")).alias("norm_title"), S.normal_url(u).alias("norm_url"), S.url_domain(u).alias("domain"))


@query(f"SELECT pos, {_FRESH} AS fresh, {_ENGAGE} AS engagement, {_QUALITY} AS quality_score FROM (SELECT *, {_NUMBER} AS nr FROM results)")
def result_scores(spark, sf):
    c = F.col
    return T.results(spark, sf).select("pos", S.freshness(c("date")).alias("fresh"), S.engagement(c("seeders"), c("views"), c("rating")).alias("engagement"), S.quality(c("title"), c("quality"), c("thumbnail"), c("description")).alias("quality_score"))


@query(f"SELECT id, {_PROVIDER} AS score FROM providers")
def provider_score(spark, sf):
    c = F.col
    return T.providers(spark, sf).select("id", S.provider_score(c("searches"), c("failed"), c("avg_ms"), c("health")).alias("score"))


@query(f"SELECT pos, {_SIMPLE} AS relevance FROM results")
def simple_relevance(spark, sf):
    return T.results(spark, sf).select("pos", S.simple_relevance(F.col("title"), QUERY).alias("relevance"))


@query("SELECT pos, ((length(lower(title)) - length(replace(lower(title), 'th', ''))) / 2)::INT AS n_th, CASE WHEN length(title) <= 3 THEN 0 WHEN length(title) <= 5 THEN 1 ELSE 2 END AS edits, levenshtein(substr(regexp_replace(lower(title), '[^a-z0-9]', '', 'g'), 1, 50), 'theorand') AS distance FROM results")
def text_measures(spark, sf):
    t = F.col("title")
    return T.results(spark, sf).select("pos", S.occurrences(F.lower(t), "th").alias("n_th"), S.most_edits(t).alias("edits"), F.levenshtein(S.normal_title(t), F.lit("theorand")).alias("distance"))


@query("SELECT pos, CASE WHEN length(t) < 3 THEN 1 ELSE len(list_distinct(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3)))) END AS n_grams FROM (SELECT pos, lower(title) AS t FROM results)")
def ngram_overlap(spark, sf):
    return T.results(spark, sf).select("pos", F.size(S.ngrams(F.lower("title"), 3)).alias("n_grams"))


@query(f"""SELECT id, {_like('url', [(m, k) for k, ms in S.PROVIDER_KINDS for m in ms], "'GENERAL'")} AS kind, upper(substr(h, 1, 1)) || substr(h, 2) AS site FROM (SELECT *, split_part(regexp_replace(regexp_extract(url, '^https?://([^/?#:]*)', 1), '^www\\.', ''), '.', 1) AS h FROM providers)""")
def provider_kinds(spark, sf):
    u = F.col("url")
    return T.providers(spark, sf).select("id", S.provider_kind(u).alias("kind"), S.site_name(u).alias("site"))


_MEDIA = "SELECT pos, 'https://cdn.example.com/hls/' || pos || '/' || CASE pos % 5 WHEN 0 THEN '2160.m3u8' WHEN 1 THEN '1080p.mp4' WHEN 2 THEN 'fhd.webm' WHEN 3 THEN 'a.mkv' ELSE 'sd.mpd' END AS m FROM results"


@query(f"SELECT pos, {_like('m', S.MEDIA_QUALITY, repr('Unknown'))} AS media_quality, {_like('m', S.MEDIA_FORMAT, repr('mp4'))} AS media_format, {_like('m', S.STREAM_TYPE, repr('UNKNOWN'))} AS stream_type, {_like('m', S.MEDIA_SCORE, '30')} AS media_score, {_like('m', S.EXTENSION, repr('.mp4'))} AS extension FROM ({_MEDIA})")
def media_urls(spark, sf):
    names = F.get(F.array(*map(F.lit, ("2160.m3u8", "1080p.mp4", "fhd.webm", "a.mkv", "sd.mpd"))), (F.col("pos") % 5).cast("int"))
    rows = T.results(spark, sf).select("pos", F.concat(F.lit("https://cdn.example.com/hls/"), F.col("pos").cast("string"), F.lit("/"), names).alias("m"))
    m = F.col("m")
    return rows.select("pos", S.media_quality(m).alias("media_quality"), S.media_format(m).alias("media_format"), S.stream_type(m).alias("stream_type"), S.media_score(m).alias("media_score"), S.extension(m).alias("extension"))


@query("SELECT id, name, enabled FROM providers WHERE enabled")
def providers_enabled(spark, sf):
    return T.providers(spark, sf).where("enabled").select("id", "name", "enabled")


@query("SELECT * FROM providers WHERE id = 7")
def provider_by_id(spark, sf):
    return T.providers(spark, sf).where("id = 7")


@query("SELECT id, name, CASE WHEN id % 3 = 0 THEN searches + 1 ELSE searches END AS searches, failed FROM providers")
def provider_counters_update(spark, sf):
    return T.providers(spark, sf).select("id", "name", F.when(F.col("id") % 3 == 0, F.col("searches") + 1).otherwise(F.col("searches")).alias("searches"), "failed")


@query("SELECT id, name, enabled FROM providers WHERE id % 2 = 1 UNION ALL SELECT id, name || '+', true FROM providers WHERE id % 2 = 0")
def provider_upsert(spark, sf):
    old = T.providers(spark, sf).select("id", "name", "enabled")
    new = old.where("id % 2 = 0").select("id", F.concat("name", F.lit("+")).alias("name"), F.lit(True).alias("enabled"))
    return lists.upsert(old, new, "id")


@query("SELECT pos, provider_id FROM results WHERE provider_id NOT IN (1, 2)")
def provider_cascade_delete(spark, sf):
    gone = T.providers(spark, sf).where("id IN (1, 2)").select(F.col("id").alias("provider_id"))
    return T.results(spark, sf).join(gone, "provider_id", "left_anti").select("pos", "provider_id")


@query("SELECT ts, query FROM search_log ORDER BY ts DESC LIMIT 50")
def history_recent(spark, sf):
    return T.search_log(spark, sf).orderBy(F.desc("ts")).limit(50)


@query("SELECT ts, query FROM search_log WHERE query ILIKE '%the%' ORDER BY ts DESC LIMIT 10")
def history_like(spark, sf):
    return T.search_log(spark, sf).where(F.col("query").ilike("%the%")).orderBy(F.desc("ts")).limit(10)


@query("SELECT query, count(*) AS n, max(ts) AS last_ts FROM search_log GROUP BY query ORDER BY n DESC, last_ts DESC LIMIT 10")
def history_most_searched(spark, sf):
    counts = T.search_log(spark, sf).groupBy("query").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))
    return counts.orderBy(F.desc("n"), F.desc("last_ts")).limit(10)


@query("SELECT count(*) AS n FROM likes")
def likes_count(spark, sf):
    return T.likes(spark, sf).agg(F.count("*").alias("n"))


@query("SELECT provider_id, count(*) AS cnt FROM likes GROUP BY 1 ORDER BY cnt DESC, provider_id LIMIT 20")
def likes_top_providers(spark, sf):
    return T.likes(spark, sf).groupBy("provider_id").agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "provider_id").limit(20)


@query("SELECT liked_at, title_keywords FROM likes ORDER BY liked_at DESC LIMIT 200")
def likes_recent_keywords(spark, sf):
    return T.likes(spark, sf).orderBy(F.desc("liked_at")).limit(200).select("liked_at", "title_keywords")


_KEYS = "SELECT unnest(string_split(title_keywords, ',')) AS keyword FROM likes"
_WEIGHTS = "c AS (SELECT {k} AS k, count(*) AS n FROM ({s}) WHERE trim({k}::VARCHAR) <> '' GROUP BY 1)"


@query(f"WITH {_WEIGHTS.format(k='keyword', s=_KEYS)} SELECT k AS keyword, n, n / (SELECT max(n) FROM c) AS weight FROM c")
def profile_keywords(spark, sf):
    return profile.keyword_weights(T.likes(spark, sf))


@query(f"WITH {_WEIGHTS.format(k='provider_id', s='SELECT * FROM likes')} SELECT k AS provider_id, n, n / (SELECT max(n) FROM c) AS weight FROM c")
def profile_providers(spark, sf):
    return profile.weights(T.likes(spark, sf), "provider_id")


@query(f"WITH {_WEIGHTS.format(k='tag', s='SELECT lower(quality) AS tag FROM likes')} SELECT k AS tag, n, n / (SELECT max(n) FROM c) AS weight FROM c")
def profile_qualities(spark, sf):
    return profile.weights(T.likes(spark, sf).select(F.lower("quality").alias("tag")), "tag")


@query(f"WITH {_WEIGHTS.format(k='tag', s='SELECT lower(category) AS tag FROM likes')} SELECT k AS tag, n, n / (SELECT max(n) FROM c) AS weight FROM c")
def profile_categories(spark, sf):
    return profile.weights(T.likes(spark, sf).select(F.lower("category").alias("tag")), "tag")


@query(f"SELECT pos, round(boost, 6) AS boost FROM ({_PREFERENCE})")
def preference_boost(spark, sf):
    return profile.preference_boost(T.results(spark, sf), T.likes(spark, sf)).select("pos", F.round("boost", 6).alias("boost"))


_RANKED = "SELECT *, row_number() OVER (PARTITION BY provider_id ORDER BY ts DESC, event_id DESC) AS r FROM provider_events"


@query(f"SELECT provider_id, count(*) AS n, round(sum(0.05::DOUBLE * CASE WHEN ok THEN 1 ELSE 0 END * pow(0.95::DOUBLE, r - 1)) + pow(0.95::DOUBLE, count(*)), 6) AS ema FROM ({_RANKED}) GROUP BY 1")
def ema_provider(spark, sf):
    found = health.moving_average(T.provider_events(spark, sf), "provider_id", F.col("ok").cast("int"), 1.0)
    return found.select("provider_id", "n", F.round("ema", 6).alias("ema"))


@query("SELECT provider_id, list_reduce(list(ms ORDER BY ts, event_id), lambda a, x: (a + x) // 2, 0) AS avg FROM provider_events GROUP BY 1")
def integer_running_avg(spark, sf):
    return folds.halving_average(T.provider_events(spark, sf), "provider_id", "ms")


_STREAKS = """s AS (SELECT provider_id, count(*) FILTER (ok) AS successes, count(*) FILTER (NOT ok) AS failures, coalesce(sum(ms) FILTER (ok), 0)::BIGINT AS success_ms,
 max(ts) FILTER (ok) AS last_ok, max((ts, event_id)) FILTER (ok) AS last FROM provider_events GROUP BY 1),
 streaks AS (SELECT s.*, (SELECT count(*) FROM provider_events e WHERE e.provider_id = s.provider_id AND NOT e.ok AND (s.last IS NULL OR (e.ts, e.event_id) > s.last)) AS streak FROM s)"""


@query(f"WITH {_STREAKS} SELECT provider_id, successes, failures, success_ms, streak FROM streaks")
def failure_streaks(spark, sf):
    return health.streaks(T.provider_events(spark, sf), "provider_id").drop("last_ok")


@query(f"""WITH {_STREAKS}, d AS (SELECT *, successes / (successes + failures) * CASE WHEN streak > 0 THEN 1 - least(streak * 0.1::DOUBLE, 0.5) ELSE 1 END AS base FROM streaks)
 SELECT provider_id, round(least(base + CASE WHEN epoch(TIMESTAMP '2024-01-01 00:00:00') - epoch(last_ok) < 60 THEN 0.1 ELSE 0 END, 1)::DOUBLE, 6) AS score, CASE WHEN successes > 0 THEN success_ms // successes ELSE 0 END AS mean_ms, streak >= 3 AS aggressive,
 CASE WHEN streak >= 5 THEN 3000 WHEN streak >= 3 THEN 1000 WHEN streak >= 1 THEN 500 ELSE 0 END AS delay_ms FROM d""")
def health_score(spark, sf):
    known = health.streaks(T.provider_events(spark, sf), "provider_id")
    scored = health.health_score(known, F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return scored.select("provider_id", F.round("score", 6).alias("score"), "mean_ms", "aggressive", "delay_ms")


#: What stands for the last error of a provider, by its number.
ERRORS = ("HTTP 403", "timeout", "Blocked by host", "connection reset", "HTTP 404", "CAPTCHA")


@query(f"""SELECT id, retry, CASE WHEN retry THEN least(1000 * pow(2, attempt), 10000)::BIGINT ELSE 0 END AS delay_ms FROM (SELECT id, attempt, attempt < CASE WHEN rate > 0.8 THEN 3 WHEN rate > 0.5 THEN 2 ELSE 1 END
 AND NOT coalesce(regexp_matches(lower(CASE id % 7 {" ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(ERRORS))} END), '403|404|blocked|cloudflare|captcha'), false) AS retry
 FROM (SELECT id, id % 4 AS attempt, CASE WHEN searches > 0 THEN 1 - failed / searches ELSE 0 END AS rate FROM providers))""")
def retry_decision(spark, sf):
    rate = F.when(F.col("searches") > 0, 1 - F.col("failed") / F.col("searches")).otherwise(0.0)
    error = F.get(F.array(*map(F.lit, ERRORS)), (F.col("id") % 7).cast("int"))
    rows = T.providers(spark, sf).select("id", health.retry_decision(rate, F.col("id") % 4, error).alias("d"))
    return rows.select("id", "d.retry", "d.delay_ms")


@query("SELECT provider_id, event_id, sum(n_results) OVER w AS offset_after, row_number() OVER w AS page_after, n_results > 0 AS has_more FROM provider_events WINDOW w AS (PARTITION BY provider_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def pagination_state(spark, sf):
    return health.running_totals(T.provider_events(spark, sf), "provider_id", F.col("n_results")).select("provider_id", "event_id", F.col("total").alias("offset_after"), F.col("place").alias("page_after"), (F.col("n_results") > 0).alias("has_more"))


@query("SELECT page_id, " + ", ".join(rf"len(regexp_extract_all(html, '(?i)<{t}[\s>]')) AS n_{t}" for t in P.COUNTED_TAGS) + " FROM pages")
def page_dom_counts(spark, sf):
    return P.tag_counts(T.table(spark, sf, "pages"))


@query("""SELECT page_id, i - 1 AS place, hrefs[i] AS href FROM (SELECT page_id, hrefs, unnest(range(1, len(hrefs) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '(?i)<a\\s[^>]*href="([^"]*)"', 1) AS hrefs FROM pages))""")
def page_links(spark, sf):
    return P.links(T.table(spark, sf, "pages"))


@query("SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, coalesce(length(html) >= 80 AND NOT (" + " OR ".join(f"contains(lower(substr(html, 1, 20000)), '{m}')" for m in P.CHALLENGE_MARKS) + "), false) AS usable FROM pages")
def page_bodies(spark, sf):
    return T.table(spark, sf, "pages").select("page_id", P.page_title(F.col("html")).alias("title"), P.usable_body(F.col("html")).alias("usable"))


@query("""WITH c AS (SELECT page_id, list_transform(regexp_extract_all(html, '(?i)\\sclass="([^"]*)"', 1), lambda c: list_distinct(string_split_regex(c, '\\s+'))) AS cs, len(regexp_extract_all(html, '(?i)<article[\\s>]')) AS a FROM pages),
 n AS (SELECT page_id, unnest(['.result', '.item', '.card', 'article', '.video-item', '.movie-item']) AS selector, unnest([0, 1, 2, 3, 4, 5]) AS place,
   unnest([len(list_filter(cs, lambda x: list_contains(x, 'result'))), len(list_filter(cs, lambda x: list_contains(x, 'item'))), len(list_filter(cs, lambda x: list_contains(x, 'card'))), a, len(list_filter(cs, lambda x: list_contains(x, 'video-item'))), len(list_filter(cs, lambda x: list_contains(x, 'movie-item')))]) AS k FROM c)
 SELECT p.page_id, b.selector FROM pages p LEFT JOIN (SELECT page_id, selector FROM n WHERE k >= 2 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY k DESC, place) = 1) b USING (page_id)""")
def page_result_selector(spark, sf):
    return T.table(spark, sf, "pages").select("page_id", P.result_selector(F.col("html")).alias("selector"))


@query("""WITH c AS (SELECT id, url, regexp_replace(url, '/+$', '') AS b FROM providers) SELECT id, array_to_string([url, b || '/search?q=old+film&page=1', b || '/?s=old+film&paged=1', b || '/?q=old+film&page=1', b || '/search?query=old+film&page=1', b || '/search/old+film', b || '/find?q=old+film&page=1'], ' ') AS candidates FROM c""")
def search_candidates(spark, sf):
    return T.providers(spark, sf).select("id", F.array_join(P.search_candidates(F.col("url"), F.lit("old film")), " ").alias("candidates"))


@query("SELECT provider_id AS body_id, trim(title) AS title, url, description FROM results WHERE length(trim(title)) >= 3 QUALIFY row_number() OVER (PARTITION BY provider_id, url ORDER BY pos) = 1")
def json_records(spark, sf):
    # A body for each result, so that the bounds of the walk cut nothing and no provider's rows are gathered. The body's
    # number holds pos and, in its last five bits, the provider (31: none).
    rows = T.results(spark, sf).withColumn("title", F.rtrim("title"))
    item = F.struct(F.col("title").alias("Headline"), F.struct(F.col("url").alias("href")).alias("link"), F.col("description").alias("summary"))
    number = F.col("pos") * 32 + F.coalesce(F.col("provider_id") + 10, F.lit(31))
    bodies = rows.select(number.alias("body_id"), F.lit("https://example.net/").alias("base_url"), F.to_json(F.struct(F.struct(F.array(item).alias("items")).alias("data"))).alias("body"))
    low = F.col("body_id").bitwiseAND(31)
    found = jsonbody.json_records(bodies).withColumn("provider", F.when(low < 31, low - 10))
    first = found.groupBy("provider", "url").agg(F.min(F.struct(F.shiftright("body_id", 5).alias("pos"), "title", "description")).alias("r"))
    return first.select(F.col("provider").alias("body_id"), "r.title", "url", "r.description")


@query("SELECT user_id % 10 AS provider_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS failed, sum(floor(value * 10)::BIGINT)::BIGINT AS ms FROM events GROUP BY 1")
def stream_health(spark, sf):
    return stream.drain(stream.provider_counts(stream.read_events(spark, sf)), "stream_health", "complete")


@query("SELECT event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ts) = 1")
def stream_dedup(spark, sf):
    return stream.drain(stream.first_seen(stream.read_events(spark, sf)), "stream_dedup", "complete").select("event_id", "event_type")


def _normal_sql() -> str:
    s = "lower(trim(text))"
    for short, full in N.CONTRACTIONS.items():
        s = f"replace({s}, '{short.replace(chr(39), chr(39) * 2)}', '{full}')"
    for slang, plain in N.SLANG.items():
        s = f"regexp_replace({s}, '\\b{slang}\\b', '{plain}', 'g')"
    return rf"regexp_replace(regexp_replace(regexp_replace({s}, '!{{2,}}', '!', 'g'), '\?{{2,}}', '?', 'g'), '\.{{3,}}', '...', 'g')"


_IN = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"
_ASKED = f"asked AS (SELECT conv_id * 100 + turn AS ts, text, {_normal_sql()} AS q FROM conversations WHERE role = 'user')"
_TOKENS = _ASKED + r""", tokens AS (SELECT ts, list_filter(list_transform(string_split_regex(q, '[\s,;:!?]+'), lambda w: trim(w, '."''()[]')), lambda w: w <> '') AS t FROM asked)"""


def _asked(spark, sf) -> DataFrame:
    c = T.table(spark, sf, "conversations").where("role = 'user'")
    return c.select((F.col("conv_id") * 100 + F.col("turn")).alias("ts"), "text", N.normal_query(F.col("text")).alias("q"))


def _tokens(spark, sf) -> DataFrame:
    return _asked(spark, sf).select("ts", N.query_tokens(F.col("q")).alias("t"))


@query(f"WITH {_ASKED} SELECT ts, q FROM asked")
def nlp_normalise(spark, sf):
    return _asked(spark, sf).select("ts", "q")


@query(f"WITH {_TOKENS} SELECT ts, array_to_string(t, '|') AS tokens, len(t) AS n FROM tokens")
def nlp_tokens(spark, sf):
    return _tokens(spark, sf).select("ts", F.array_join("t", "|").alias("tokens"), F.size("t").alias("n"))


_COUNTS = ", ".join(f"{' + '.join(f'contains(j, {w!r})::INT' for w in ws)} AS n{i}" for i, ws in enumerate(N.INTENTS.values()))


@query(f"WITH {_TOKENS}, c AS (SELECT ts, {_COUNTS} FROM (SELECT ts, array_to_string(t, ' ') AS j FROM tokens)) SELECT ts, CASE WHEN greatest(n0, n1, n2, n3) = 0 THEN 'GENERAL' WHEN n0 >= greatest(n1, n2, n3) THEN 'VIDEO' WHEN n1 >= greatest(n2, n3) THEN 'DOWNLOAD' WHEN n2 >= n3 THEN 'ARTICLE' ELSE 'IMAGE' END AS intent FROM c")
def nlp_intent(spark, sf):
    return _tokens(spark, sf).select("ts", N.intent(F.col("t")).alias("intent"))


@query(f"WITH {_TOKENS} SELECT ts, len(t) > 2 AND (len(list_filter(t, lambda w: w IN {_IN(N.STOP_WORDS)})) / greatest(len(t), 1) > 0.25 OR (len(list_filter(t, lambda w: w IN {_IN(N.PRONOUNS)})) > 0 AND len(list_filter(t, lambda w: w IN {_IN(("show", "find", "make", "give", "tell", "write", "read", "open", "move"))} OR regexp_matches(w, '({'|'.join(N.VERB_ENDS)})$|^({'|'.join(N.VERB_STARTS)})'))) > 0) OR len(t) >= 6) AS is_natural FROM tokens")
def nlp_natural(spark, sf):
    return _tokens(spark, sf).select("ts", N.is_natural(F.col("t"), language.LEXICON.verbs).alias("is_natural"))


@query(f"WITH base AS (SELECT ts, lower(trim(query)) AS b FROM search_log) SELECT ts, array_to_string(list_distinct_in_order, '|') AS variants FROM (SELECT ts, list_filter([b, replace(b, ' ', '.'), replace(b, ' ', '-'), replace(b, ' ', '+'), b || ' 2024', b || ' 2023'], lambda x, i: list_position([b, replace(b, ' ', '.'), replace(b, ' ', '-'), replace(b, ' ', '+'), b || ' 2024', b || ' 2023'], x) = i) AS list_distinct_in_order FROM base)")
def query_variants(spark, sf):
    return T.search_log(spark, sf).select("ts", F.array_join(N.query_variants(F.col("query"), 2024), "|").alias("variants"))


@query(f"SELECT pos, round(relevance, 6) AS relevance FROM ({_text_sql()})")
def text_relevance(spark, sf):
    return relevance.text_relevance(T.results(spark, sf), TEXT_QUERY).select("pos", F.round("relevance", 6).alias("relevance"))


# Modules that register queries of their own.
from sieveworks.plans import documents, language, layouts, learning, sites, statements, texts  # noqa: E402, F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in FOUND.items() if sql}
