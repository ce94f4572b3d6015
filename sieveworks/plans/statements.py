"""Statements over the stored tables: look-ups, listings, updates, deletions and merges, each as a DataFrame."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sieveworks.operators import lists
from sieveworks.plans.registry import query
from sieveworks.sources import tables as T

KEY = "https://supplier-000000007.example.net/"
TOP_CORRECTIONS = 8


@query("SELECT id, name, enabled FROM providers ORDER BY name, id")
def providers_by_name(spark, sf):
    return T.providers(spark, sf).select("id", "name", "enabled").orderBy("name", "id")


@query("SELECT id, name FROM providers WHERE enabled ORDER BY name, id")
def providers_enabled_by_name(spark, sf):
    return T.providers(spark, sf).where("enabled").select("id", "name").orderBy("name", "id")


@query(f"SELECT id, name, url FROM providers WHERE url = '{KEY}'")
def provider_by_url(spark, sf):
    return T.providers(spark, sf).where(F.col("url") == KEY).select("id", "name", "url")


@query("SELECT id, rtrim(url, '/') AS base_url FROM providers WHERE rtrim(url, '/') = 'https://supplier-000000009.example.net' ORDER BY id LIMIT 1")
def provider_by_base_url(spark, sf):
    rows = T.providers(spark, sf).select("id", F.regexp_replace("url", "/+$", "").alias("base_url"))
    return rows.where("base_url = 'https://supplier-000000009.example.net'").orderBy("id").limit(1)


@query("SELECT id, name FROM providers WHERE id <> 7")
def provider_delete(spark, sf):
    return T.providers(spark, sf).where("id <> 7").select("id", "name")


@query("SELECT id, CASE WHEN id = 7 THEN false ELSE enabled END AS enabled FROM providers")
def provider_set_enabled(spark, sf):
    return T.providers(spark, sf).select("id", F.when(F.col("id") == 7, False).otherwise(F.col("enabled")).alias("enabled"))


@query("SELECT p.id, CASE WHEN e.n IS NULL THEN health ELSE e.ok_share END AS health, coalesce(e.ms, avg_ms) AS avg_ms FROM providers p LEFT JOIN (SELECT provider_id, count(*) AS n, round(avg(ok::INT), 6) AS ok_share, (sum(ms) // count(*))::BIGINT AS ms FROM provider_events GROUP BY 1) e ON p.id = e.provider_id")
def provider_set_health(spark, sf):
    seen = T.provider_events(spark, sf).groupBy("provider_id").agg(F.round(F.avg(F.col("ok").cast("int")), 6).alias("ok_share"), F.floor(F.sum("ms") / F.count("*")).alias("ms"))
    rows = T.providers(spark, sf).join(seen, F.col("id") == F.col("provider_id"), "left")
    return rows.select("id", F.coalesce("ok_share", "health").alias("health"), F.coalesce("ms", "avg_ms").alias("avg_ms"))


@query("SELECT id, searches, CASE WHEN id % 4 = 1 THEN failed + 1 ELSE failed END AS failed FROM providers")
def provider_count_failure(spark, sf):
    return T.providers(spark, sf).select("id", "searches", (F.col("failed") + (F.col("id") % 4 == 1).cast("long")).alias("failed"))


@query("SELECT p.id, a.at AS last_analyzed FROM providers p LEFT JOIN (SELECT provider_id, max(analyzed_at) AS at FROM analyses GROUP BY 1) a ON p.id = a.provider_id")
def provider_stamp_analysis(spark, sf):
    last = T.analyses(spark, sf).groupBy("provider_id").agg(F.max("analyzed_at").alias("last_analyzed"))
    return T.providers(spark, sf).select("id").join(last, F.col("id") == F.col("provider_id"), "left").select("id", "last_analyzed")


@query("SELECT id, provider_id, analyzed_at FROM analyses ORDER BY analyzed_at DESC, id")
def analyses_recent(spark, sf):
    return T.analyses(spark, sf).select("id", "provider_id", "analyzed_at").orderBy(F.desc("analyzed_at"), "id")


@query("SELECT id, url, analyzed_at FROM analyses WHERE provider_id = 3 ORDER BY analyzed_at DESC, id LIMIT 1")
def analysis_latest(spark, sf):
    return T.analyses(spark, sf).where("provider_id = 3").orderBy(F.desc("analyzed_at"), "id").limit(1).select("id", "url", "analyzed_at")


@query("SELECT * FROM analyses WHERE id = 11")
def analysis_by_id(spark, sf):
    return T.analyses(spark, sf).where("id = 11")


@query("SELECT id, provider_id FROM analyses WHERE provider_id IS DISTINCT FROM 3")
def analyses_delete(spark, sf):
    return T.analyses(spark, sf).where(~F.col("provider_id").eqNullSafe(3)).select("id", "provider_id")


@query("SELECT * FROM configs")
def configs_all(spark, sf):
    return T.configs(spark, sf)


@query("SELECT * FROM configs WHERE provider_id = 5 ORDER BY id LIMIT 1")
def config_of_provider(spark, sf):
    return T.configs(spark, sf).where("provider_id = 5").orderBy("id").limit(1)


@query("SELECT id FROM configs WHERE provider_id <> 5")
def configs_delete(spark, sf):
    return T.configs(spark, sf).where("provider_id <> 5").select("id")


@query("SELECT p.id, c.id AS config_id, c.template FROM providers p LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY provider_id ORDER BY id) AS n FROM configs) c ON p.id = c.provider_id AND c.n = 1")
def provider_config(spark, sf):
    first = lists.keep_first(T.configs(spark, sf), ["provider_id"], ["id"]).select("provider_id", F.col("id").alias("config_id"), "template")
    return T.providers(spark, sf).select("id").join(first, F.col("id") == F.col("provider_id"), "left").select("id", "config_id", "template")


@query("SELECT p.id, a.id AS analysis_id, a.analyzed_at FROM providers p LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY provider_id ORDER BY analyzed_at DESC, id) AS n FROM analyses) a ON p.id = a.provider_id AND a.n = 1")
def provider_latest_analysis(spark, sf):
    last = lists.keep_first(T.analyses(spark, sf), ["provider_id"], [F.desc("analyzed_at"), "id"]).select("provider_id", F.col("id").alias("analysis_id"), "analyzed_at")
    return T.providers(spark, sf).select("id").join(last, F.col("id") == F.col("provider_id"), "left").select("id", "analysis_id", "analyzed_at")


@query("SELECT ts, query FROM search_log WHERE ts <> 101")
def history_delete(spark, sf):
    return T.search_log(spark, sf).where("ts <> 101")


@query("SELECT ts, query FROM search_log WHERE false")
def history_clear(spark, sf):
    return T.search_log(spark, sf).limit(0)


@query("SELECT * FROM preferences WHERE id = 1")
def preferences_row(spark, sf):
    return T.preferences(spark, sf).where("id = 1")


@query("SELECT id, '[\"movies\"]' AS categories, genres, qualities FROM preferences")
def preferences_set_categories(spark, sf):
    return T.preferences(spark, sf).withColumn("categories", F.when(F.col("id") == 1, F.lit('["movies"]')).otherwise(F.col("categories")))


@query("SELECT id, categories, '[\"drama\"]' AS genres, qualities FROM preferences")
def preferences_set_genres(spark, sf):
    return T.preferences(spark, sf).withColumn("genres", F.when(F.col("id") == 1, F.lit('["drama"]')).otherwise(F.col("genres")))


@query("SELECT id, categories, genres, '[\"4k\"]' AS qualities FROM preferences")
def preferences_set_qualities(spark, sf):
    return T.preferences(spark, sf).withColumn("qualities", F.when(F.col("id") == 1, F.lit('["4k"]')).otherwise(F.col("qualities")))


@query("SELECT pos, url, liked_at FROM likes ORDER BY liked_at DESC, pos")
def likes_listed(spark, sf):
    return T.likes(spark, sf).select("pos", "url", "liked_at").orderBy(F.desc("liked_at"), "pos")


@query("SELECT pos, url FROM likes WHERE url = 'https://www.en.example.com/doc-5' ORDER BY pos LIMIT 1")
def like_by_url(spark, sf):
    return T.likes(spark, sf).where("url = 'https://www.en.example.com/doc-5'").orderBy("pos").limit(1).select("pos", "url")


@query("SELECT pos FROM likes WHERE url <> 'https://www.en.example.com/doc-5'")
def likes_delete_url(spark, sf):
    return T.likes(spark, sf).where("url <> 'https://www.en.example.com/doc-5'").select("pos")


@query("SELECT pos FROM likes WHERE pos <> 5")
def likes_delete_id(spark, sf):
    return T.likes(spark, sf).where("pos <> 5").select("pos")


@query("SELECT DISTINCT url FROM likes")
def likes_urls(spark, sf):
    return T.likes(spark, sf).select("url").distinct()


@query("SELECT pos, url FROM likes WHERE url NOT IN (SELECT url FROM results WHERE pos = 17) UNION ALL SELECT pos, url FROM results WHERE pos = 17 AND url NOT IN (SELECT url FROM likes)")
def like_toggle(spark, sf):
    likes, one = T.likes(spark, sf).select("pos", "url"), T.results(spark, sf).where("pos = 17").select("pos", "url")
    return likes.join(F.broadcast(one.select("url")), "url", "left_anti").unionByName(one.join(likes.select("url"), "url", "left_anti")).select("pos", "url")


_PROFILE = "SELECT {k} AS k, count(*) AS n FROM ({s}) WHERE trim({k}::VARCHAR) <> '' GROUP BY 1"
_CODEC = "(SELECT coalesce(string_agg(k || ':' || round(n / m, 4)::VARCHAR, ';' ORDER BY n DESC, k), '') FROM (SELECT k::VARCHAR AS k, n, max(n) OVER () AS m FROM ({t})))"


@query("SELECT " + ", ".join(f"{_CODEC.format(t=_PROFILE.format(k=k, s=s))} AS {name}" for name, k, s in (("providers", "provider_id", "SELECT * FROM likes"), ("qualities", "tag", "SELECT lower(quality) AS tag FROM likes"), ("categories", "tag", "SELECT lower(category) AS tag FROM likes"))) + ", (SELECT count(*) FROM likes) AS total_likes")
def profile_row(spark, sf):
    from sieveworks.operators import profile

    liked = T.likes(spark, sf)
    parts = {"providers": liked.select(F.col("provider_id").cast("string").alias("k")), "qualities": liked.select(F.lower("quality").alias("k")), "categories": liked.select(F.lower("category").alias("k"))}
    out = liked.agg(F.count("*").alias("total_likes"))
    for name, rows in parts.items():
        out = out.crossJoin(profile.encoded_weights(profile.weights(rows, "k"), "k").withColumnRenamed("encoded", name))
    return out.select("providers", "qualities", "categories", "total_likes")


@query("SELECT * FROM schemas WHERE provider_id = 4 LIMIT 1")
def schema_of_provider(spark, sf):
    return T.schemas(spark, sf).where("provider_id = 4").limit(1)


@query(f"SELECT id, field, confidence FROM corrections WHERE provider_id = 4 ORDER BY confidence DESC, ts DESC, id LIMIT {TOP_CORRECTIONS}")
def corrections_top(spark, sf):
    return T.corrections(spark, sf).where("provider_id = 4").orderBy(F.desc("confidence"), F.desc("ts"), "id").limit(TOP_CORRECTIONS).select("id", "field", "confidence")


@query("SELECT id, provider_id, field, confidence FROM corrections UNION ALL SELECT -1, 4, 'title', 0.9::DOUBLE")
def correction_append(spark, sf):
    rows = T.corrections(spark, sf).select("id", "provider_id", "field", "confidence")
    new = spark.range(1).select(F.lit(-1).cast("long").alias("id"), F.lit(4).cast("long").alias("provider_id"), F.lit("title").alias("field"), F.lit(0.9).alias("confidence"))
    return rows.unionByName(new)


@query("""SELECT s.provider_id, coalesce(n.j, s.schema_json) AS schema_json, coalesce(n.c, s.confidence) AS confidence, s.category_map, s.pagination FROM schemas s
 LEFT JOIN (SELECT id AS provider_id, '{"t":"' || id || '"}' AS j, health AS c FROM providers WHERE id % 2 = 1) n USING (provider_id)""")
def schema_update(spark, sf):
    new = T.providers(spark, sf).where("id % 2 = 1").select(F.col("id").alias("own"), F.concat(F.lit('{"t":"'), F.col("id").cast("string"), F.lit('"}')).alias("j"), F.col("health").alias("c"))
    rows = T.schemas(spark, sf).join(new, F.col("provider_id") == F.col("own"), "left")
    return rows.select("provider_id", F.coalesce("j", "schema_json").alias("schema_json"), F.coalesce("c", "confidence").alias("confidence"), "category_map", "pagination")


@query("SELECT provider_id, schema_json, CASE WHEN provider_id < 5 THEN 'offset' ELSE pagination END AS pagination FROM schemas")
def schema_set_pagination(spark, sf):
    return T.schemas(spark, sf).select("provider_id", "schema_json", F.when(F.col("provider_id") < 5, "offset").otherwise(F.col("pagination")).alias("pagination"))


@query("SELECT provider_id, greatest(confidence, 0.5::DOUBLE) AS confidence, json_extract_string(category_map, '$.raw') AS raw, 'Films' AS flicks FROM schemas")
def schema_map_category(spark, sf):
    merged = F.map_concat(F.from_json("category_map", "map<string,string>"), F.create_map(F.lit("flicks"), F.lit("Films")))
    return T.schemas(spark, sf).select("provider_id", F.greatest("confidence", F.lit(0.5)).alias("confidence"), merged["raw"].alias("raw"), merged["flicks"].alias("flicks"))


@query(f"""SELECT s.provider_id, 'schema=' || schema_json || chr(10) || 'pagination=' || coalesce(pagination, '') || coalesce(chr(10) || c.lines, '') AS context FROM schemas s LEFT JOIN
 (SELECT provider_id, string_agg(field || ' ' || round(confidence * 1000)::BIGINT, chr(10) ORDER BY n) AS lines FROM (SELECT *, row_number() OVER (PARTITION BY provider_id ORDER BY confidence DESC, ts DESC, id) AS n FROM corrections) WHERE n <= {TOP_CORRECTIONS} GROUP BY 1) c USING (provider_id)""")
def provider_context(spark, sf):
    order = Window.partitionBy("provider_id").orderBy(F.desc("confidence"), F.desc("ts"), "id")
    top = T.corrections(spark, sf).withColumn("n", F.row_number().over(order)).where(F.col("n") <= TOP_CORRECTIONS)
    line = F.concat_ws(" ", "field", F.round(F.col("confidence") * 1000).cast("long").cast("string"))
    # At most TOP_CORRECTIONS lines of each provider come together.
    lines = top.groupBy(F.col("provider_id").alias("own")).agg(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))).alias("l"))
    rows = T.schemas(spark, sf).join(lines, F.col("provider_id") == F.col("own"), "left")
    head = F.concat(F.lit("schema="), "schema_json", F.lit("\npagination="), F.coalesce("pagination", F.lit("")))
    return rows.select("provider_id", F.concat_ws("\n", head, F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("context"))


@query("SELECT id, url, enabled FROM (SELECT id, url, CASE WHEN url IN (SELECT url FROM providers WHERE id <= 5) THEN true ELSE enabled END AS enabled FROM providers) UNION ALL SELECT 1000000 + id, 'https://new-' || id || '.example.net/', true FROM providers WHERE id BETWEEN 6 AND 8")
def provider_add(spark, sf):
    """Added URLs: known ones are enabled again, others become new rows."""
    known = T.providers(spark, sf).select("id", "url", "enabled")
    added = known.where("id <= 5").select(F.col("url").alias("added_url"), F.lit(None).cast("long").alias("new_id")).unionByName(
        known.where("id BETWEEN 6 AND 8").select(F.concat(F.lit("https://new-"), F.col("id").cast("string"), F.lit(".example.net/")).alias("added_url"), (F.col("id") + 1_000_000).alias("new_id")))
    old = known.join(added, F.col("url") == F.col("added_url"), "left").select("id", "url", (F.col("enabled") | F.col("added_url").isNotNull()).alias("enabled"))
    new = added.join(known, F.col("url") == F.col("added_url"), "left_anti").select(F.col("new_id").alias("id"), F.col("added_url").alias("url"), F.lit(True).alias("enabled"))
    return old.unionByName(new)


@query("""SELECT p.id AS provider_id, coalesce(c.template, '/search?q={query}') AS template, coalesce(c.timeout_ms, 12000) AS timeout_ms, coalesce(a.strategy, 'HTML_PARSING') AS strategy FROM providers p
 LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY provider_id ORDER BY id) AS n FROM configs) c ON p.id = c.provider_id AND c.n = 1
 LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY provider_id ORDER BY analyzed_at DESC, id) AS n FROM analyses) a ON p.id = a.provider_id AND a.n = 1""")
def scraping_configs(spark, sf):
    """Settings of each provider from its stored ones and its latest analysis, with defaults."""
    config = lists.keep_first(T.configs(spark, sf), ["provider_id"], ["id"]).select(F.col("provider_id").alias("c_id"), "template", "timeout_ms")
    last = lists.keep_first(T.analyses(spark, sf), ["provider_id"], [F.desc("analyzed_at"), "id"]).select(F.col("provider_id").alias("a_id"), "strategy")
    rows = T.providers(spark, sf).select(F.col("id").alias("provider_id")).join(config, F.col("provider_id") == F.col("c_id"), "left").join(last, F.col("provider_id") == F.col("a_id"), "left")
    return rows.select("provider_id", F.coalesce("template", F.lit("/search?q={query}")).alias("template"), F.coalesce("timeout_ms", F.lit(12_000)).alias("timeout_ms"), F.coalesce("strategy", F.lit("HTML_PARSING")).alias("strategy"))


@query("SELECT p.id, a.id AS analysis_id, CASE WHEN a.id IS NULL THEN 'no page' WHEN a.size < 80 THEN 'too short' END AS error FROM providers p LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY provider_id ORDER BY analyzed_at DESC, id) AS n FROM analyses) a ON p.id = a.provider_id AND a.n = 1 WHERE p.enabled")
def providers_refresh(spark, sf):
    """The latest analysis of each enabled provider, or what is wrong with it."""
    last = lists.keep_first(T.analyses(spark, sf), ["provider_id"], [F.desc("analyzed_at"), "id"]).select("provider_id", F.col("id").alias("analysis_id"), "size")
    rows = T.providers(spark, sf).where("enabled").select("id").join(last, F.col("id") == F.col("provider_id"), "left")
    return rows.select("id", "analysis_id", F.when(F.col("analysis_id").isNull(), "no page").when(F.col("size") < 80, "too short").alias("error"))


@query("SELECT pos, title FROM results WHERE provider_id = 4 ORDER BY pos LIMIT 50 OFFSET 50")
def provider_page(spark, sf):
    """The second page of one provider, in its own order and without the display filter."""
    return T.results(spark, sf).where("provider_id = 4").orderBy("pos").offset(50).limit(50).select("pos", "title")


@query("SELECT count(*) FILTER (ok) AS succeeded, count(*) FILTER (NOT ok) AS failed, count(DISTINCT event_id % 1000) AS urls FROM provider_events")
def search_stats(spark, sf):
    return T.provider_events(spark, sf).agg(F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"), F.count_distinct(F.col("event_id") % 1000).alias("urls"))


@query("SELECT count(*) AS n_results, count(DISTINCT provider_id) AS n_providers, count(DISTINCT provider_id) FILTER (title <> '') AS successful FROM results")
def history_entry(spark, sf):
    """The row that a search leaves in the history."""
    return T.results(spark, sf).agg(F.count("*").alias("n_results"), F.count_distinct("provider_id").alias("n_providers"), F.count_distinct(F.when(F.col("title") != "", F.col("provider_id"))).alias("successful"))


@query("SELECT pos, url FROM results WHERE provider_id <> 4 UNION ALL SELECT pos, url || '?fresh' FROM results WHERE provider_id = 4")
def provider_replace(spark, sf):
    """One provider's rows are replaced by fresh ones."""
    rows = T.results(spark, sf).select("pos", "provider_id", "url")
    fresh = rows.where("provider_id = 4").withColumn("url", F.concat("url", F.lit("?fresh")))
    return rows.join(F.broadcast(fresh.select("provider_id").distinct()), "provider_id", "left_anti").unionByName(fresh).select("pos", "url")


@query("""WITH w AS (SELECT id, 'a:' || id || ';b:x;c;a:' || (id + 1) || ';d:0.5' AS raw FROM providers) SELECT id, (id + 1)::DOUBLE AS a, 0.0::DOUBLE AS b, 0.5::DOUBLE AS d, 3 AS n FROM w""")
def profile_parse(spark, sf):
    """Stored weights read back: entries without a colon go, what is no number is 0, the last of a key holds."""
    from sieveworks.operators import profile

    i = F.col("id").cast("string")
    raw = F.concat(F.lit("a:"), i, F.lit(";b:x;c;a:"), (F.col("id") + 1).cast("string"), F.lit(";d:0.5"))
    rows = T.providers(spark, sf).select("id", profile.parse_weights(raw).alias("m"))
    return rows.select("id", F.col("m.a").alias("a"), F.col("m.b").alias("b"), F.col("m.d").alias("d"), F.size("m").alias("n"))


@query("SELECT id FROM providers WHERE id NOT IN (SELECT provider_id FROM results) UNION ALL SELECT id FROM providers WHERE id IN (SELECT provider_id FROM results)")
def provider_partition(spark, sf):
    """Providers without results, then those with."""
    ids, seen = T.providers(spark, sf).select("id"), T.results(spark, sf).select(F.col("provider_id").alias("id")).distinct()
    return ids.join(seen, "id", "left_anti").unionByName(ids.join(seen, "id", "left_semi"))
