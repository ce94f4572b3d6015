"""Queries of learned state: folds over events, rankings by what was learned, decisions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sieveworks.functions import similarity as M
from sieveworks.functions.querytext import EXPANSIONS
from sieveworks.operators import decisions as D
from sieveworks.operators import folds, lists
from sieveworks.plans.registry import query
from sieveworks.sources import tables as T

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
SELECTORS = (".card", ".item", "article", ".result", "li")
PATTERN_TYPES = ("RESULT", "TITLE", "IMAGE")
TERMS = ("then", "onion", "movie", "then onion", "onion movie")

# The oracle folds whole ordered lists; Spark composes maps of slices.
_STATE = """st AS (SELECT provider_id, list_reduce(list({'ok': ok::DOUBLE, 'c': n_results::DOUBLE, 'ms': ms::DOUBLE, 'k': 0.0::DOUBLE, 'n': 0.0::DOUBLE} ORDER BY ts, event_id),
  lambda s, e: {'ok': s.ok * 0.95::DOUBLE + e.ok * (1 - 0.95::DOUBLE), 'c': s.c * 0.95::DOUBLE + e.c * (1 - 0.95::DOUBLE), 'ms': s.ms * 0.95::DOUBLE + e.ms * (1 - 0.95::DOUBLE),
   'k': CASE WHEN s.n < 3 THEN 0.5::DOUBLE ELSE least(greatest(s.k + CASE WHEN (s.ok > 0.5) = (e.ok > 0.5) THEN 0.1 ELSE -0.1 END::DOUBLE + CASE WHEN abs(e.c - s.c) < 10 THEN 0.1 ELSE -0.05 END::DOUBLE, 0), 1) END, 'n': s.n + 1},
  {'ok': 0.5::DOUBLE, 'c': 0.0::DOUBLE, 'ms': 3000.0::DOUBLE, 'k': 0.5::DOUBLE, 'n': 0.0::DOUBLE}) AS s, NOT arg_max(ok, (ts, event_id)) AS last_failed FROM provider_events GROUP BY 1),
 state AS (SELECT provider_id, s.n::BIGINT AS n, s.ok AS success, s.c AS mean_count, s.ms AS mean_ms, s.k AS consistency, last_failed, s.ok * 0.5::DOUBLE + s.k * 0.3::DOUBLE + CASE WHEN s.ms < 1000 THEN 1.0 WHEN s.ms < 3000 THEN 0.8 WHEN s.ms < 5000 THEN 0.6 WHEN s.ms < 10000 THEN 0.4 ELSE 0.2 END::DOUBLE * 0.2::DOUBLE AS overall FROM st)"""


def _state(spark, sf):
    known = folds.provider_state(T.provider_events(spark, sf), "provider_id")
    return known.withColumn("overall", D.overall_score(F.col("success"), F.col("consistency"), F.col("mean_ms")))


@query(f"WITH {_STATE} SELECT provider_id, n, round(success, 6) AS success, round(mean_count, 6) AS mean_count, round(mean_ms, 4) AS mean_ms, round(consistency, 6) AS consistency, last_failed, round(overall, 6) AS overall FROM state")
def provider_state(spark, sf):
    s = _state(spark, sf)
    return s.select("provider_id", "n", F.round("success", 6).alias("success"), F.round("mean_count", 6).alias("mean_count"), F.round("mean_ms", 4).alias("mean_ms"), F.round("consistency", 6).alias("consistency"), "last_failed", F.round("overall", 6).alias("overall"))


@query(f"""WITH {_STATE} SELECT p.id, round(coalesce((1 - success) * (1 - consistency) * CASE WHEN last_failed THEN 1.5 ELSE 1 END::DOUBLE, 0.2::DOUBLE), 6) AS likelihood,
 CASE WHEN success IS NULL THEN 'First time scraping - proceed with caution' WHEN (1 - success) * (1 - consistency) * CASE WHEN last_failed THEN 1.5 ELSE 1 END::DOUBLE > 0.7 THEN 'Use headless browser with extended timeout'
  WHEN (1 - success) * (1 - consistency) * CASE WHEN last_failed THEN 1.5 ELSE 1 END::DOUBLE > 0.4 THEN 'Try standard scraping with retry' ELSE 'Proceed normally' END AS advice FROM providers p LEFT JOIN state ON p.id = provider_id""")
def failure_prediction(spark, sf):
    rows = T.providers(spark, sf).select("id").join(_state(spark, sf), F.col("id") == F.col("provider_id"), "left")
    rows = rows.select("id", D.failure_risk(1 - F.col("success"), F.col("consistency"), F.col("last_failed")).alias("r"))
    return rows.select("id", F.round("r.likelihood", 6).alias("likelihood"), "r.advice")


_STREAMING = " OR ".join(f"contains('watch the old film', '{w}')" for w in M.CATEGORY_WORDS["STREAMING"])


@query(f"""WITH {_STATE}, r AS (SELECT p.id, CASE WHEN searches > 0 THEN 1 - failed / searches ELSE 0 END * 100::DOUBLE + CASE WHEN avg_ms < 1000 THEN 20 WHEN avg_ms < 3000 THEN 15 WHEN avg_ms < 5000 THEN 10 WHEN avg_ms < 10000 THEN 5 ELSE 0 END
  + coalesce(overall * 30, 0) + CASE WHEN consistency > 0.8 THEN 15 ELSE 0 END - CASE WHEN 1 - success > 0.5 THEN 20 ELSE 0 END + CASE WHEN kind = 'STREAMING' AND ({_STREAMING}) THEN 25 ELSE 0 END + health * 10 AS points FROM providers p LEFT JOIN state ON p.id = provider_id)
 SELECT row_number() OVER (ORDER BY round(least(greatest(points, 0), 200), 6) DESC, id) AS rank, id, round(least(greatest(points, 0), 200), 6) AS points FROM r""")
def providers_ranked(spark, sf):
    p = T.providers(spark, sf).join(_state(spark, sf), F.col("id") == F.col("provider_id"), "left")
    rate = F.when(F.col("searches") > 0, 1 - F.col("failed") / F.col("searches")).otherwise(0.0)
    points = D.provider_points(rate, F.col("avg_ms"), F.col("health"), F.col("kind"), F.lit("watch the old film"), F.col("overall"), F.col("consistency"), 1 - F.col("success"))
    rows = p.select("id", F.round(points, 6).alias("points"))
    # One row for each provider.
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("points"), "id")).cast("long"))


_QW = "least(greatest(" + ", ".join(f"CASE WHEN contains(lower(coalesce(quality, '')), '{q}') OR contains(lower(title), '{q}') THEN {w} ELSE 0 END::DOUBLE" for q, w in D.QUALITY_WEIGHTS.items()) + ") + CASE WHEN regexp_matches(lower(title), '" + "|".join(D.QUALITY_WORDS) + "') THEN 0.1 ELSE 0 END::DOUBLE, 1)"


def _relevance_sql() -> str:
    t, d, single = "lower(title)", "lower(coalesce(description, ''))", [x for x in TERMS if " " not in x]
    parts = [f"CASE WHEN contains({t}, '{' '.join(single)}') THEN 50 ELSE 0 END"]
    for i, x in enumerate(single):
        w = 1 - min(i * 0.08, 0.5)
        parts.append(f"CASE WHEN contains({t}, '{x}') THEN {30 * w} + CASE WHEN list_contains(ws, '{x}') THEN {15 * w} ELSE 0 END::DOUBLE + CASE WHEN starts_with({t}, '{x}') THEN 20 ELSE 0 END ELSE CASE WHEN len(list_filter(ws, lambda v: starts_with(v, '{x}') AND length(v) <= {len(x) + 3})) > 0 THEN {8 * w} ELSE 0 END::DOUBLE END")
        parts.append(f"CASE WHEN contains({d}, '{x}') THEN {8 * w} ELSE 0 END::DOUBLE")
        parts += [f"CASE WHEN contains({t}, '{n}') AND NOT contains({t}, '{x}') THEN 10 ELSE 0 END" for n in EXPANSIONS.get(x, ())]
    parts += [f"CASE WHEN contains({t}, '{x}') THEN 25 WHEN contains({d}, '{x}') THEN 8 ELSE 0 END" for x in TERMS if " " in x]
    parts += [f"{_QW} * 20", "CASE WHEN coalesce(thumbnail, '') <> '' THEN 5 ELSE 0 END", "CASE WHEN seeders > 1000 THEN 15 WHEN seeders > 100 THEN 10 WHEN seeders > 10 THEN 5 WHEN seeders > 0 THEN 2 WHEN seeders IS NOT NULL THEN -5 ELSE 0 END", "coalesce(rating, 0)"]
    return "least(greatest(" + " + ".join(parts) + " - CASE WHEN " + " OR ".join(f"contains({t}, '{r}')" for r in D.RISK_WORDS) + " THEN 15 ELSE 0 END, 0), 100)::DOUBLE"


@query(f"SELECT pos, round({_QW}, 6) AS weight, round({_relevance_sql()}, 6) AS relevance FROM (SELECT *, string_split_regex(lower(title), '\\W+') AS ws FROM results)")
def learned_relevance(spark, sf):
    c = F.col
    rows = T.results(spark, sf)
    return rows.select("pos", F.round(D.quality_weight(c("title"), c("quality")), 6).alias("weight"), F.round(D.result_relevance(c("title"), c("description"), c("quality"), c("thumbnail"), c("seeders"), c("rating"), list(TERMS)), 6).alias("relevance"))


@query(f"SELECT pos, relevance FROM (SELECT pos, round({_relevance_sql()}, 6) AS relevance FROM (SELECT *, string_split_regex(lower(title), '\\W+') AS ws FROM results)) ORDER BY relevance DESC, pos LIMIT 100")
def learned_ranking(spark, sf):
    return learned_relevance(spark, sf).select("pos", "relevance").orderBy(F.desc("relevance"), "pos").limit(100)


_OPTION = "CASE lower(quality) " + " ".join(f"WHEN '{q}' THEN {w}" for q, w in D.QUALITY_WEIGHTS.items()) + " ELSE 0.3 END::DOUBLE * 0.7::DOUBLE + CASE WHEN size IS NULL THEN 0 WHEN size > 10000000000 THEN 0.9 WHEN size > 5000000000 THEN 0.8 WHEN size > 2000000000 THEN 0.7 WHEN size > 1000000000 THEN 0.6 ELSE 0.5 END::DOUBLE * 0.3::DOUBLE"


@query(f"SELECT grp, pos FROM (SELECT pos, pos % 30 AS grp, {_OPTION} AS s FROM (SELECT pos, quality, CASE WHEN pos % 7 <> 0 THEN views * 2000 END AS size FROM results WHERE seeders IS DISTINCT FROM 0)) QUALIFY row_number() OVER (PARTITION BY grp ORDER BY round(s, 6) DESC, pos) = 1")
def quality_choice(spark, sf):
    """The best available option of each group; one that nobody shares is not available."""
    rows = T.results(spark, sf).where("seeders IS DISTINCT FROM 0").withColumn("size", F.when(F.col("pos") % 7 != 0, F.col("views") * 2000))
    rows = rows.select("pos", (F.col("pos") % 30).alias("grp"), F.round(D.quality_option_score(F.coalesce("quality", F.lit("")), F.col("size")), 6).alias("s"))
    best = rows.groupBy("grp").agg(F.max(F.struct("s", (-F.col("pos")).alias("first"))).alias("b"))
    return best.select("grp", (-F.col("b.first")).alias("pos"))


@query("""WITH f AS (SELECT p.id, a.id IS NOT NULL AS known, needs_script, has_api, strategy, CASE p.id % 4 WHEN 0 THEN [] WHEN 1 THEN ['HTML_PARSING'] WHEN 2 THEN ['DYNAMIC_CONTENT'] ELSE ['HTML_PARSING', 'DYNAMIC_CONTENT'] END AS failures FROM providers p LEFT JOIN analyses a ON p.id = a.id),
 t AS (SELECT *, ['Error 403', 'bad format', 'Timeout', 'proxy down', 'other'][id % 5 + 1] AS error, ['JSON_API', 'NEXTJS', 'HTML', 'XML'][id % 4 + 1] AS kind, CASE WHEN id % 3 = 0 THEN ['JSON-LD', 'HTML'] ELSE ['HTML'] END AS methods FROM f)
 SELECT id, CASE WHEN NOT known THEN 'HTML_PARSING' WHEN needs_script THEN CASE WHEN list_contains(failures, 'DYNAMIC_CONTENT') THEN 'HEADLESS_BROWSER' ELSE 'DYNAMIC_CONTENT' END WHEN has_api AND len(failures) = 0 THEN 'API_BASED'
  WHEN len(failures) = 2 THEN 'HEADLESS_BROWSER' WHEN list_contains(failures, 'HTML_PARSING') THEN 'DYNAMIC_CONTENT' ELSE strategy END AS recommended,
  CASE id % 5 WHEN 0 THEN 'USE_PROXY' WHEN 1 THEN 'TRY_ALTERNATE_QUALITY' WHEN 3 THEN 'ROTATE_PROXY' ELSE 'RETRY_WITH_DELAY' END AS recovery,
  CASE id % 4 WHEN 0 THEN 'API_FIRST' WHEN 1 THEN 'FRAMEWORK_DATA' ELSE CASE WHEN id % 3 = 0 THEN 'HYBRID' ELSE 'HTML_PARSING' END END AS extraction FROM t""")
def strategies(spark, sf):
    known = T.analyses(spark, sf).select(F.col("id").alias("a_id"), "needs_script", "has_api", "strategy")
    rows = T.providers(spark, sf).select("id").join(known, F.col("id") == F.col("a_id"), "left")
    i, empty = F.col("id"), F.array().cast("array<string>")
    failures = F.when(i % 4 == 0, empty).when(i % 4 == 1, F.array(F.lit("HTML_PARSING"))).when(i % 4 == 2, F.array(F.lit("DYNAMIC_CONTENT"))).otherwise(F.array(F.lit("HTML_PARSING"), F.lit("DYNAMIC_CONTENT")))
    pick = lambda values: F.get(F.array(*map(F.lit, values)), (i % len(values)).cast("int"))
    methods = F.when(i % 3 == 0, F.array(F.lit("JSON-LD"), F.lit("HTML"))).otherwise(F.array(F.lit("HTML")))
    return rows.select(
        "id", D.recommended_strategy(F.col("a_id").isNotNull(), F.col("needs_script"), F.col("has_api"), F.col("strategy"), failures).alias("recommended"),
        D.recovery_action(pick(("Error 403", "bad format", "Timeout", "proxy down", "other"))).alias("recovery"), D.extraction_strategy(pick(("JSON_API", "NEXTJS", "HTML", "XML")), methods).alias("extraction"),
    )


@query("SELECT round(coalesce(avg(confidence), 0), 6) AS parser, round(coalesce(avg(confidence) FILTER (confidence > 0.5), 0), 6) AS merged, (SELECT string_agg(field, ',' ORDER BY first) FROM (SELECT field, min(id) AS first FROM corrections GROUP BY 1)) AS methods FROM corrections")
def overall_confidence(spark, sf):
    """Mean confidences, and the sources in the order in which they were first seen."""
    rows = T.corrections(spark, sf)
    means = rows.agg(F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 6).alias("parser"), F.round(F.coalesce(F.avg(F.when(F.col("confidence") > 0.5, F.col("confidence"))), F.lit(0.0)), 6).alias("merged"))
    first = rows.groupBy("field").agg(F.min("id").alias("first")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "field"))), lambda x: x["field"]), ",").alias("methods"))
    return means.crossJoin(first)


_USES = "uses AS (SELECT *, ['.card', '.item', 'article', '.result', 'li'][n_results % 5 + 1] AS selector, ['RESULT', 'TITLE', 'IMAGE'][event_id % 3 + 1] AS kind, round((ms % 100) / 100.0, 2)::DOUBLE AS conf FROM provider_events)"


def _uses(spark, sf):
    e = T.provider_events(spark, sf)
    pick = lambda values, at: F.get(F.array(*map(F.lit, values)), (at % len(values)).cast("int"))
    return e.withColumns({"selector": pick(SELECTORS, F.col("n_results")), "kind": pick(PATTERN_TYPES, F.col("event_id")), "conf": F.round(F.col("ms") % 100 / 100, 2)})


@query(f"""WITH {_USES}, p AS (SELECT provider_id, kind, selector, count(*) AS usage, list_reduce(list(conf ORDER BY ts, event_id), lambda s, x: s * 0.7::DOUBLE + x * 0.3::DOUBLE) AS confidence FROM uses GROUP BY ALL)
 SELECT provider_id, kind, selector, usage, round(confidence, 6) AS confidence FROM p QUALIFY row_number() OVER (PARTITION BY provider_id ORDER BY round(confidence * ln(usage + 1), 6) DESC, kind, selector) <= 12""")
def pattern_learning(spark, sf):
    """Confidence of each pattern as an exponential mean that begins with its first value; the best dozen of each provider."""
    keys = ["provider_id", "kind", "selector"]
    uses = _uses(spark, sf)
    first = uses.groupBy(*keys).agg(F.min_by("conf", F.struct("ts", "event_id")).alias("first"))
    # From the first value, the first event leaves it where it is: 0.7 first + 0.3 first.
    moved = folds.fold(uses, keys, {"decay": folds.step(0.7, F.col("conf") * 0.3)}, {"decay": 0.0}).join(first, keys)
    known = moved.select(*keys, F.col("n").alias("usage"), (F.col("decay") + F.pow(F.lit(0.7), F.col("n")) * F.col("first")).alias("confidence"))
    top = lists.top_of_group(known.withColumn("rank", F.round(F.col("confidence") * F.log(F.col("usage") + 1), 6)), ["provider_id"], [F.desc("rank"), F.col("kind"), F.col("selector")], 12)
    return top.select(*keys, "usage", F.round("confidence", 6).alias("confidence"))


@query(f"""WITH {_USES}, s AS (SELECT provider_id, kind, selector, count(*) FILTER (ok) AS wins, count(*) FILTER (NOT ok) AS losses FROM uses GROUP BY ALL), t AS (SELECT *, wins / (wins + losses) AS score FROM s)
 SELECT provider_id, kind, selector, wins, losses, round(score, 6) AS score, row_number() OVER (PARTITION BY provider_id, kind ORDER BY score DESC, selector) = 1 AND score > 0.5 AS best FROM t QUALIFY row_number() OVER (PARTITION BY provider_id, kind ORDER BY score DESC, selector) <= 10""")
def selector_knowledge(spark, sf):
    counts = _uses(spark, sf).groupBy("provider_id", "kind", "selector").agg(F.count_if("ok").alias("wins"), F.count_if(~F.col("ok")).alias("losses"))
    scored = counts.withColumn("score", F.col("wins") / (F.col("wins") + F.col("losses")))
    place = F.row_number().over(Window.partitionBy("provider_id", "kind").orderBy(F.desc("score"), "selector"))
    top = scored.withColumn("place", place).where("place <= 10")
    return top.select("provider_id", "kind", "selector", "wins", "losses", F.round("score", 6).alias("score"), ((F.col("place") == 1) & (F.col("score") > 0.5)).alias("best"))


_ENDPOINTS = """ends AS (SELECT provider_id, '/api/' || (event_id % 7) AS endpoint, count(*) FILTER (ok) AS wins, count(*) FILTER (NOT ok) AS losses, coalesce(arg_max(n_results, (ts, event_id)) FILTER (ok), 0) AS last_size, max(ts) FILTER (ok) AS last_ok, min((ts, event_id)) AS first FROM provider_events GROUP BY ALL)"""


@query(f"WITH {_ENDPOINTS} SELECT provider_id, endpoint, wins, losses, last_size, row_number() OVER (PARTITION BY provider_id ORDER BY wins * last_size DESC, endpoint) AS rank FROM ends WHERE wins > losses")
def endpoints_ranked(spark, sf):
    known = _endpoints(spark, sf).where("wins > losses")
    return known.withColumn("rank", F.row_number().over(Window.partitionBy("provider_id").orderBy(F.desc(F.col("wins") * F.col("last_size")), "endpoint")).cast("long")).select("provider_id", "endpoint", "wins", "losses", "last_size", "rank")


def _endpoints(spark, sf):
    e = T.provider_events(spark, sf).withColumn("endpoint", F.concat(F.lit("/api/"), (F.col("event_id") % 7).cast("string")))
    at = F.struct("ts", "event_id")
    return e.groupBy("provider_id", "endpoint").agg(
        F.count_if("ok").alias("wins"), F.count_if(~F.col("ok")).alias("losses"), F.coalesce(F.max_by("n_results", F.when(F.col("ok"), at)), F.lit(0)).alias("last_size"),
        F.max(F.when(F.col("ok"), F.col("ts"))).alias("last_ok"), F.min(at).alias("first"),
    )


@query(f"""WITH e AS (SELECT provider_id, '/api/' || (event_id % 13) AS endpoint, arg_min(n_results, (ts, event_id)) AS size, min(ts) AS used, min((ts, event_id)) AS first FROM provider_events WHERE ok GROUP BY ALL),
 kept AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY provider_id ORDER BY first DESC) <= 10)
 SELECT provider_id, endpoint, size FROM kept WHERE used > {AS_OF} - INTERVAL 31 DAY QUALIFY row_number() OVER (PARTITION BY provider_id ORDER BY size DESC, first) = 1""")
def endpoint_best(spark, sf):
    """Of the ten endpoints of each provider that were first seen last, the one of most results that is not too old. A repeated
    endpoint keeps its first record."""
    e = T.provider_events(spark, sf).where("ok").withColumn("endpoint", F.concat(F.lit("/api/"), (F.col("event_id") % 13).cast("string")))
    at = F.struct("ts", "event_id")
    known = e.groupBy("provider_id", "endpoint").agg(F.min_by("n_results", at).alias("size"), F.min(at).alias("first"))
    kept = lists.top_of_group(known, ["provider_id"], [F.desc("first")], 10).where(F.col("first.ts") > F.expr(f"{AS_OF} - INTERVAL 31 DAYS"))
    return lists.keep_first(kept, ["provider_id"], [F.desc("size"), "first"]).select("provider_id", "endpoint", "size")


_FAILURES = "fails AS (SELECT * FROM (SELECT *, ['HTML_PARSING', 'API_BASED', 'DYNAMIC_CONTENT'][event_id % 3 + 1] AS strategy FROM provider_events WHERE NOT ok) QUALIFY row_number() OVER (PARTITION BY provider_id ORDER BY ts DESC, event_id DESC) <= 50)"
_KINDS = ("HTML_PARSING", "API_BASED", "DYNAMIC_CONTENT")


def _with_strategy(rows):
    return rows.withColumn("strategy", F.get(F.array(*map(F.lit, _KINDS)), (F.col("event_id") % 3).cast("int")))


@query(f"""WITH {_FAILURES}, eff AS (SELECT ['HTML_PARSING', 'API_BASED', 'DYNAMIC_CONTENT'][event_id % 3 + 1] AS strategy, avg(ok::INT) AS share FROM provider_events GROUP BY 1),
 recent AS (SELECT DISTINCT provider_id, strategy FROM fails WHERE ts > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 1 DAY),
 open AS (SELECT p.provider_id, e.strategy, e.share FROM (SELECT DISTINCT provider_id FROM provider_events) p, eff e WHERE (p.provider_id, e.strategy) NOT IN (SELECT provider_id, strategy FROM recent)),
 best AS (SELECT provider_id, strategy FROM open QUALIFY row_number() OVER (PARTITION BY provider_id ORDER BY share DESC, strategy) = 1),
 n AS (SELECT provider_id, count(*) AS kept, count(*) FILTER (ts > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 12 HOUR) AS late, max(event_id) FILTER (event_id % 11 = 0) AS recovered FROM fails GROUP BY 1)
 SELECT p.provider_id, coalesce(kept, 0) AS kept, CASE WHEN recovered IS NOT NULL THEN 'DYNAMIC_CONTENT' ELSE coalesce(strategy, 'HTML_PARSING') END AS strategy, CASE WHEN late >= 3 THEN 'HEADLESS_BROWSER' END AS alternative
 FROM (SELECT DISTINCT provider_id FROM provider_events) p LEFT JOIN n USING (provider_id) LEFT JOIN best USING (provider_id)""")
def adaptive_strategies(spark, sf):
    """For each provider the last 50 failures, the strategy of a recovered one or else the most successful that did not fail
    lately, and an alternative after several late failures."""
    events = _with_strategy(T.provider_events(spark, sf))
    fails = lists.top_of_group(events.where("NOT ok"), ["provider_id"], [F.desc("ts"), F.desc("event_id")], 50)
    since = lambda hours: F.col("ts") > F.expr(f"{AS_OF} - INTERVAL {hours} HOURS")
    known = fails.groupBy("provider_id").agg(F.count("*").alias("kept"), F.count_if(since(12)).alias("late"), F.max(F.when(F.col("event_id") % 11 == 0, F.col("event_id"))).alias("recovered"))
    share = events.groupBy("strategy").agg(F.avg(F.col("ok").cast("int")).alias("share"))
    providers = events.select("provider_id").distinct()
    lately = fails.where(since(24)).select("provider_id", "strategy").distinct()
    # Three strategies for each provider.
    open_ = providers.crossJoin(F.broadcast(share)).join(lately, ["provider_id", "strategy"], "left_anti")
    best = lists.keep_first(open_, ["provider_id"], [F.desc("share"), "strategy"]).select("provider_id", F.col("strategy").alias("best"))
    rows = providers.join(known, "provider_id", "left").join(best, "provider_id", "left")
    strategy = F.when(F.col("recovered").isNotNull(), "DYNAMIC_CONTENT").otherwise(F.coalesce("best", F.lit("HTML_PARSING")))
    return rows.select("provider_id", F.coalesce("kept", F.lit(0)).alias("kept"), strategy.alias("strategy"), F.when(F.col("late") >= 3, "HEADLESS_BROWSER").alias("alternative"))


@query("""WITH e AS (SELECT *, ['HTML_PARSING', 'API_BASED', 'DYNAMIC_CONTENT'][event_id % 3 + 1] AS strategy FROM provider_events)
 SELECT strategy, count(*) FILTER (ok) AS wins, count(*) FILTER (NOT ok) AS losses, count(DISTINCT provider_id) AS domains, list_reduce(list(ms ORDER BY ts, event_id) FILTER (ok), lambda a, x: (a + x) // 2) AS avg_ms FROM e GROUP BY 1""")
def strategy_stats(spark, sf):
    """Wins, losses and the halving average of times, which begins with the first time."""
    e = _with_strategy(T.provider_events(spark, sf))
    counts = e.groupBy("strategy").agg(F.count_if("ok").alias("wins"), F.count_if(~F.col("ok")).alias("losses"), F.count_distinct("provider_id").alias("domains"))
    wins = e.where("ok")
    at = F.struct("ts", "event_id")
    first = wins.groupBy("strategy").agg(F.min_by(F.struct("ts", "event_id", "ms"), at).alias("f"))
    # Halving from 0 with twice the first time puts the average at it.
    doubled = wins.join(F.broadcast(first), "strategy").withColumn("ms", F.when(at == F.struct("f.ts", "f.event_id"), F.col("ms") * 2).otherwise(F.col("ms")))
    return counts.join(folds.halving_average(doubled, "strategy", "ms").withColumnRenamed("avg", "avg_ms"), "strategy")


_TAGS = "q AS (SELECT *, 'f' || (event_id % 4) AS fingerprint, ['compound', 'emotion', 'synonym', 'broad'][event_id % 4 + 1] AS tag, least(n_results, 50) / 50.0::DOUBLE * CASE WHEN event_id % 5 = 0 THEN 2 ELSE 1 END AS score FROM provider_events)"


def _tagged(spark, sf):
    e = T.provider_events(spark, sf)
    i = F.col("event_id")
    return e.withColumns({
        "fingerprint": F.concat(F.lit("f"), (i % 4).cast("string")), "tag": F.get(F.array(*map(F.lit, ("compound", "emotion", "synonym", "broad"))), (i % 4).cast("int")),
        "score": F.least(F.col("n_results"), F.lit(50)) / 50.0 * F.when(i % 5 == 0, 2).otherwise(1),
    })


@query(f"""WITH {_TAGS} SELECT provider_id, tag, round(list_reduce(list({{'ok': ok, 'x': score}} ORDER BY ts, event_id), lambda s, e: {{'ok': true, 'x': least(greatest(CASE WHEN e.ok THEN s.x * 0.7::DOUBLE + e.x * 0.3::DOUBLE ELSE s.x * 0.8::DOUBLE END, 0), 1)}}, {{'ok': true, 'x': 0.5::DOUBLE}}).x, 6) AS score,
 count(*) FILTER (ok) AS successes, count(*) FILTER (NOT ok) AS failures FROM q GROUP BY ALL""")
def query_feedback(spark, sf):
    """Scores of query strategies: up with each success, down with each failure, between 0 and 1."""
    e = _tagged(spark, sf)
    up = F.col("ok")
    one = folds.step(F.when(up, 0.7).otherwise(0.8), F.when(up, F.col("score") * 0.3).otherwise(0.0), 0.0, 1.0)
    scores = folds.fold(e, ["provider_id", "tag"], {"score": one}, {"score": 0.5})
    counts = e.groupBy("provider_id", "tag").agg(F.count_if("ok").alias("successes"), F.count_if(~F.col("ok")).alias("failures"))
    return scores.select("provider_id", "tag", F.round("score", 6).alias("score")).join(counts, ["provider_id", "tag"])


@query(f"""WITH {_TAGS}, g AS (SELECT tag, list_reduce(list(score ORDER BY ts, event_id), lambda s, x: least(greatest(s * 0.8::DOUBLE + x * 0.2::DOUBLE, 0), 1), 0.5::DOUBLE) AS score FROM q WHERE ok GROUP BY 1) SELECT tag, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, tag) AS rank FROM g""")
def query_strategies(spark, sf):
    """The same over all providers, of successes only; best first."""
    rows = folds.fold(_tagged(spark, sf).where("ok"), ["tag"], {"score": folds.step(0.8, F.col("score") * 0.2, 0.0, 1.0)}, {"score": 0.5})
    # One row for each strategy.
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "tag")).cast("long")).select("tag", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {_TAGS}, p AS (SELECT fingerprint, provider_id, event_id, n_results, event_id % 5 = 0 AS liked FROM q WHERE ok) SELECT fingerprint, event_id, n_results, liked FROM p QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY n_results * CASE WHEN liked THEN 2 ELSE 1 END DESC, event_id) <= 5""")
def similar_queries(spark, sf):
    rows = _tagged(spark, sf).where("ok").withColumn("liked", F.col("event_id") % 5 == 0)
    worth = F.col("n_results") * F.when(F.col("liked"), 2).otherwise(1)
    return lists.top_of_group(rows.withColumn("worth", worth), ["fingerprint"], [F.desc("worth"), F.col("event_id")], 5).select("fingerprint", "event_id", "n_results", "liked")


@query("""WITH e AS (SELECT *, 't' || (event_id % 6) AS template FROM provider_events) SELECT template, count(*) FILTER (ok) AS wins, count(*) FILTER (NOT ok) AS losses, round(coalesce(avg(n_results) FILTER (ok), 0), 6)::DOUBLE AS mean_found FROM e GROUP BY 1""")
def template_stats(spark, sf):
    e = T.provider_events(spark, sf).withColumn("template", F.concat(F.lit("t"), (F.col("event_id") % 6).cast("string")))
    return e.groupBy("template").agg(F.count_if("ok").alias("wins"), F.count_if(~F.col("ok")).alias("losses"), F.round(F.coalesce(F.avg(F.when(F.col("ok"), F.col("n_results"))), F.lit(0.0)), 6).alias("mean_found"))


@query("""SELECT provider_id, round(list_reduce(list({'ok': ok, 'r': 0.0::DOUBLE, 's': 0.0::DOUBLE} ORDER BY ts, event_id), lambda a, e: {'ok': true, 'r': CASE WHEN e.ok THEN least(a.r * 0.9::DOUBLE + 0.1::DOUBLE, 1) ELSE a.r * 0.5::DOUBLE END, 's': CASE WHEN e.ok THEN least(a.s + 5, 100) ELSE a.s * 0.5::DOUBLE END}, {'ok': true, 'r': 1.0::DOUBLE, 's': 50.0::DOUBLE}).r, 6) AS rate,
 round(list_reduce(list({'ok': ok, 's': 0.0::DOUBLE} ORDER BY ts, event_id), lambda a, e: {'ok': true, 's': CASE WHEN e.ok THEN least(a.s + 5, 100) ELSE a.s * 0.5::DOUBLE END}, {'ok': true, 's': 50.0::DOUBLE}).s, 6) AS score FROM provider_events GROUP BY 1""")
def route_health(spark, sf):
    """Rate and score of a route: halved by a failure, raised by a success."""
    up = F.col("ok")
    steps = {"rate": folds.step(F.when(up, 0.9).otherwise(0.5), F.when(up, 0.1).otherwise(0.0), None, F.when(up, 1.0).otherwise(float("inf"))), "score": folds.step(F.when(up, 1.0).otherwise(0.5), F.when(up, 5.0).otherwise(0.0), None, F.when(up, 100.0).otherwise(float("inf")))}
    found = folds.fold(T.provider_events(spark, sf), ["provider_id"], steps, {"rate": 1.0, "score": 50.0})
    return found.select("provider_id", F.round("rate", 6).alias("rate"), F.round("score", 6).alias("score"))


@query("SELECT count(*) AS interactions, count(*) FILTER (ok) AS successes, count(DISTINCT provider_id) AS domains, count(*) FILTER (NOT ok AND event_id % 11 = 0) AS recovered, round(least(0.1::DOUBLE + 0.02::DOUBLE * count(*) FILTER (ok), 1), 6) AS intelligence FROM provider_events")
def learning_stats(spark, sf):
    e = T.provider_events(spark, sf)
    return e.agg(
        F.count("*").alias("interactions"), F.count_if("ok").alias("successes"), F.count_distinct("provider_id").alias("domains"), F.count_if(~F.col("ok") & (F.col("event_id") % 11 == 0)).alias("recovered"),
        F.round(F.least(F.lit(0.1) + 0.02 * F.count_if("ok"), F.lit(1.0)), 6).alias("intelligence"),
    )


@query("WITH h AS (SELECT DISTINCT regexp_extract(url, '://([^/?#:]*)', 1) AS host FROM likes), s AS (SELECT pos, rating * 4 + CASE WHEN regexp_extract(url, '://([^/?#:]*)', 1) IN (SELECT host FROM h) THEN 50 ELSE 0 END AS score FROM results) SELECT pos, round(score, 6)::DOUBLE AS score FROM s WHERE score > 40 ORDER BY score DESC, pos LIMIT 50")
def preferred_hosts(spark, sf):
    """Results lifted by 50 where their host was liked, over 40, the best 50."""
    from sieveworks.functions.scores import url_host

    hosts = T.likes(spark, sf).select(url_host(F.col("url")).alias("host")).distinct().withColumn("liked", F.lit(50.0))
    rows = T.results(spark, sf).withColumn("host", url_host(F.col("url"))).join(hosts, "host", "left")
    rows = rows.select("pos", F.round(F.col("rating") * 4 + F.coalesce("liked", F.lit(0.0)), 6).alias("score"))
    return rows.where("score > 40").orderBy(F.desc("score"), "pos").limit(50)


@query("WITH s AS (SELECT provider_id, arg_max(CASE WHEN event_id % 9 = 0 THEN 'SEARCHING' WHEN ok THEN 'RESULTS' ELSE 'FAILED' END, (ts, event_id)) AS status, arg_max(n_results, (ts, event_id)) AS n FROM provider_events GROUP BY 1) SELECT provider_id, CASE WHEN status = 'SEARCHING' THEN 'FAILED' ELSE status END AS status, n AS n_results FROM s")
def session_status(spark, sf):
    """The last state of each provider in a session; those still searching at its end have failed."""
    status = F.when(F.col("event_id") % 9 == 0, "SEARCHING").when(F.col("ok"), "RESULTS").otherwise("FAILED")
    last = T.provider_events(spark, sf).groupBy("provider_id").agg(F.max_by(F.struct(status.alias("status"), "n_results"), F.struct("ts", "event_id")).alias("s"))
    return last.select("provider_id", F.when(F.col("s.status") == "SEARCHING", "FAILED").otherwise(F.col("s.status")).alias("status"), "s.n_results")


@query("WITH b AS (SELECT pos, provider_id, url, (pos // 10 % 6) // 3 AS batch, contains(lower(title), 'the') AS fits FROM results WHERE pos // 10 % 8 < 6), f AS (SELECT provider_id, min(batch) FILTER (fits) AS stop FROM b GROUP BY 1) SELECT provider_id, url, min(pos) AS pos FROM b JOIN f USING (provider_id) WHERE stop IS NULL OR batch <= stop GROUP BY ALL")
def bounded_candidates(spark, sf):
    """Six candidates of a provider in batches of three; batches after the first with a fitting result are not read."""
    slot = F.floor(F.col("pos") / 10)
    rows = T.results(spark, sf).where(slot % 8 < 6).select("pos", "provider_id", "url", F.floor((slot % 6) / 3).alias("batch"), F.lower("title").contains("the").alias("fits"))
    stop = rows.groupBy("provider_id").agg(F.min(F.when(F.col("fits"), F.col("batch"))).alias("stop"))
    kept = rows.join(F.broadcast(stop), "provider_id").where("stop IS NULL OR batch <= stop")
    return kept.groupBy("provider_id", "url").agg(F.min("pos").alias("pos"))


@query(f"SELECT event_id, ts > {AS_OF} - INTERVAL 10 MINUTE OR event_id % 3 = 0 AS cached, coalesce(epoch_ms(ts) - epoch_ms(lag(ts) OVER (PARTITION BY provider_id ORDER BY ts, event_id)) < 50, false) AS limited FROM provider_events")
def cache_and_limit(spark, sf):
    """Whether an entry is still in a cache of ten minutes (or pinned), and whether it came within 50 ms of the one before."""
    w = Window.partitionBy("provider_id", "slot").orderBy(F.asc_nulls_last("ts"), F.asc_nulls_last("event_id"))
    # Gaps within 50 ms lie in one 100 ms slot or across the edge of two: each event is also put into the slot after its own,
    # where it only stands before others. Each event is so judged once, by itself, and needs no key.
    # epoch_ms rounds to the nearest millisecond, halves away from 1970, where unix_millis would cut; kept as microseconds.
    us = F.round(F.unix_micros(F.col("ts").cast("timestamp")), -3)
    both = T.provider_events(spark, sf).select("event_id", "provider_id", "ts", us.alias("us")).withColumn("later", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("slot", F.floor(F.col("us") / 100_000) + F.col("later"))
    near = both.withColumn("gap", F.col("us") - F.lag("us").over(w)).where("later = 0")
    cached = (F.col("ts") > F.expr(f"{AS_OF} - INTERVAL 10 MINUTES")) | (F.col("event_id") % 3 == 0)
    return near.select("event_id", cached.alias("cached"), F.coalesce(F.col("gap") < 50_000, F.lit(False)).alias("limited"))


@query("SELECT query, max(ts) AS last_ts FROM search_log GROUP BY 1 ORDER BY last_ts DESC, query LIMIT 100")
def cached_queries(spark, sf):
    """The hundred queries that were asked last."""
    return T.search_log(spark, sf).groupBy("query").agg(F.max("ts").alias("last_ts")).orderBy(F.desc("last_ts"), "query").limit(100)
