"""Search-domain views over the stored tables, each with the same definition in SQL (VIEWS)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the views.
DATES = ("today", "3 hours ago", "yesterday", "5 days ago", "2 weeks ago", "1 month ago", "3 months ago", "1 year ago")
QUALITIES = ("4K", "1080p", "720p", "HDTV", "CAM")
CATEGORIES = ("Movies", "TV", "Music", "Games")
STRATEGIES = ("HTML_PARSING", "API_BASED", "DYNAMIC_CONTENT", "HEADLESS_BROWSER", "HYBRID")
KINDS = ("GENERAL", "STREAMING", "TORRENT", "NEWS", "MEDIA", "API_BASED", "CUSTOM", "OTHER")


def _pick(values: tuple[str, ...], place: Column) -> Column:
    """The value at a place; null beyond the last."""
    return F.get(F.array(*map(F.lit, values)), place.cast("int"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search result for each document, in the order of pos. A result shows no more of its page than search pages do: as title the
    first line, up to 120 characters, as description the first 300 characters; the other fields stand in for what documents do not have."""
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    return d.select(
        i.alias("pos"),
        (F.substring("source", 4, 10).cast("int") % 10).alias("provider_id"),
        F.substring(F.split("text", "\n", 2)[0], 1, 120).alias("title"),
        F.substring("text", 1, 300).alias("description"),
        F.concat(F.lit("https://www."), "lang", F.lit(".example.com/doc-"), (i % 97).cast("string")).alias("url"),
        F.when(i % 7 != 0, i % 1500).alias("seeders"),
        (F.col("n_chars") * 97).alias("views"),
        ((i % 101) / 10.0).alias("rating"),
        _pick(DATES, i % 9).alias("date"),
        _pick(QUALITIES, i % 6).alias("quality"),
        _pick(CATEGORIES, i % 5).alias("category"),
        F.when(i % 4 != 0, F.concat(F.lit("https://img.example.com/"), i.cast("string"), F.lit(".jpg"))).alias("thumbnail"),
    )


def provider_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", "ts", (F.col("user_id") % 10).alias("provider_id"), (F.col("event_type") != "error").alias("ok"),
        F.floor(F.col("value") * 10).cast("long").alias("ms"), (F.col("event_id") % 40).alias("n_results"),
    )


def providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as providers, with the counters of their events."""
    counts = provider_events(spark, sf_dir).groupBy("provider_id").agg(
        F.count("*").alias("searches"), F.count_if(~F.col("ok")).alias("failed"), F.floor(F.avg("ms")).cast("long").alias("avg_ms"))
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    base = s.select(
        k.alias("id"), F.col("s_name").alias("name"), F.concat(F.lit("https://"), F.lower(F.translate("s_name", "#", "-")), F.lit(".example.net/")).alias("url"),
        _pick(KINDS, F.col("s_nationkey") % 8).alias("kind"), (k % 5 != 0).alias("enabled"), ((k % 11) / 10.0).alias("health"),
    )
    joined = base.join(counts, F.col("id") == F.col("provider_id"), "left").drop("provider_id")
    return joined.na.fill(0, ["searches", "failed", "avg_ms"])


def likes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of documents labelled good; the keyword list keeps the first place of each title word."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("pos")).distinct()
    liked = results(spark, sf_dir).join(good, "pos", "left_semi").withColumn("liked_at", F.col("pos"))
    found = F.filter(F.split(F.lower("title"), r"\W+"), lambda w: F.length(w) > 2)
    return liked.withColumn("title_keywords", F.array_join(F.array_distinct(found), ","))


def search_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches: the first two words of what users say stand for what they search for."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    first = F.slice(F.filter(F.split(F.lower("text"), r"[ \t\n\f\r]+"), lambda w: w != ""), 1, 2)
    return c.select((F.col("conv_id") * 100 + F.col("turn")).alias("ts"), F.array_join(first, " ").alias("query"))


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as analyses of providers' sites."""
    p = table(spark, sf_dir, "pages")
    i = F.col("page_id")
    return p.select(
        i.alias("id"), (i % 10).alias("provider_id"), (i * 37 % 1009).alias("analyzed_at"), "url", F.length("html").cast("long").alias("size"),
        (i % 3 == 0).alias("needs_script"), (i % 4 == 1).alias("has_api"), _pick(STRATEGIES, i % 5).alias("strategy"),
    )


def configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several scraping settings for each provider."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        k.alias("id"), (k % 20).alias("provider_id"), F.when(k % 3 != 0, F.concat(F.lit("/find?q={query}&n="), k.cast("string"))).alias("template"), (1000 + k * 10).alias("timeout_ms"))


#: Stored selectors by the number of a configuration modulo 4: result, title, url, description, thumbnail.
SELECTORS = (
    ("nav li", "a", "a[href]", None, "img"),
    ("body", "article > h1", "nav > ul > li > a", ".ad, #ad", None),
    ("ul > li + li", "a[href^='/']", "li > a[href*=/]", "a", None),
    ("nav li:first-child, .missing", "b, a", "*[href]", "footer", "img[src]"),
)


def config_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selectors of the first configuration of each provider."""
    first = configs(spark, sf_dir).groupBy("provider_id").agg(F.min("id").alias("id"))
    pick = lambda n: _pick(tuple(s[n] for s in SELECTORS), F.col("id") % len(SELECTORS))
    return first.select("provider_id", "id", *[pick(n).alias(c) for n, c in enumerate(("result", "title", "url", "description", "thumbnail"))])


def provider_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored pages, dealt to the providers of the configurations."""
    return table(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % 20).alias("provider_id"), "url", "html")


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as corrections of providers' fields."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), (F.col("user_id") % 10).alias("provider_id"), F.col("event_type").alias("field"),
        F.round(F.col("value") / 500, 3).alias("confidence"), "ts",
    )


def schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A learned schema for each of 25 providers."""
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        k.alias("provider_id"), F.concat(F.lit('{"name":"'), "n_name", F.lit('"}')).alias("schema_json"), ((k % 10) / 10.0).alias("confidence"),
        F.concat(F.lit('{"raw":"'), F.lower("n_name"), F.lit('"}')).alias("category_map"), F.when(k % 2 == 0, "page").alias("pagination"),
    )


def preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one row of stored preferences."""
    return table(spark, sf_dir, "region").where("r_regionkey = 1").select("r_regionkey", F.lit("[]").alias("categories"), F.lit("[]").alias("genres"), F.concat(F.lit('["'), F.lower("r_name"), F.lit('"]')).alias("qualities")).withColumnRenamed("r_regionkey", "id")


def _sql_pick(values: tuple[str, ...], place: str) -> str:
    return "CASE " + " ".join(f"WHEN {place} = {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


VIEWS = {
    "results": f"""SELECT doc_id AS pos, substr(source, 4)::INT % 10 AS provider_id, substr(split_part(text, chr(10), 1), 1, 120) AS title,
        substr(text, 1, 300) AS description, 'https://www.' || lang || '.example.com/doc-' || (doc_id % 97)::VARCHAR AS url,
        CASE WHEN doc_id % 7 <> 0 THEN doc_id % 1500 END AS seeders, n_chars * 97 AS views, (doc_id % 101)::DOUBLE / 10 AS rating,
        {_sql_pick(DATES, 'doc_id % 9')} AS date, {_sql_pick(QUALITIES, 'doc_id % 6')} AS quality, {_sql_pick(CATEGORIES, 'doc_id % 5')} AS category,
        CASE WHEN doc_id % 4 <> 0 THEN 'https://img.example.com/' || doc_id::VARCHAR || '.jpg' END AS thumbnail FROM documents""",
    "provider_events": "SELECT event_id, ts, user_id % 10 AS provider_id, event_type <> 'error' AS ok, floor(value * 10)::BIGINT AS ms, event_id % 40 AS n_results FROM events",
    "providers": f"""SELECT s_suppkey AS id, s_name AS name, 'https://' || lower(translate(s_name, '#', '-')) || '.example.net/' AS url,
        {_sql_pick(KINDS, 's_nationkey % 8')} AS kind, s_suppkey % 5 <> 0 AS enabled, (s_suppkey % 11)::DOUBLE / 10 AS health,
        coalesce(searches, 0) AS searches, coalesce(failed, 0) AS failed, coalesce(avg_ms, 0) AS avg_ms
        FROM supplier LEFT JOIN (SELECT provider_id, count(*) AS searches, count(*) FILTER (NOT ok) AS failed, floor(avg(ms))::BIGINT AS avg_ms
                                 FROM provider_events GROUP BY 1) ON s_suppkey = provider_id""",
    "likes": r"""SELECT *, pos AS liked_at, (SELECT coalesce(string_agg(w, ',' ORDER BY i), '') FROM (SELECT w, min(i) AS i FROM (SELECT unnest(ws) AS w, unnest(range(len(ws))) AS i
        FROM (SELECT string_split_regex(lower(title), '\W+') AS ws)) WHERE length(w) > 2 GROUP BY w)) AS title_keywords
        FROM results WHERE pos IN (SELECT doc_id FROM labels WHERE quality = 1)""",
    "search_log": r"""SELECT conv_id * 100 + turn AS ts, array_to_string(list_filter(string_split_regex(lower(text), '[ \t\n\f\r]+'), lambda w: w <> '')[1:2], ' ') AS query
        FROM conversations WHERE role = 'user'""",
    "analyses": f"""SELECT page_id AS id, page_id % 10 AS provider_id, page_id * 37 % 1009 AS analyzed_at, url, length(html) AS size, page_id % 3 = 0 AS needs_script,
        page_id % 4 = 1 AS has_api, {_sql_pick(STRATEGIES, 'page_id % 5')} AS strategy FROM pages""",
    "configs": "SELECT s_suppkey AS id, s_suppkey % 20 AS provider_id, CASE WHEN s_suppkey % 3 <> 0 THEN '/find?q={query}&n=' || s_suppkey END AS template, 1000 + s_suppkey * 10 AS timeout_ms FROM supplier",
    "corrections": "SELECT event_id AS id, user_id % 10 AS provider_id, event_type AS field, round(value / 500, 3) AS confidence, ts FROM events",
    "schemas": """SELECT n_nationkey AS provider_id, '{"name":"' || n_name || '"}' AS schema_json, (n_nationkey % 10)::DOUBLE / 10 AS confidence,
        '{"raw":"' || lower(n_name) || '"}' AS category_map, CASE WHEN n_nationkey % 2 = 0 THEN 'page' END AS pagination FROM nation""",
    "preferences": """SELECT r_regionkey AS id, '[]' AS categories, '[]' AS genres, '["' || lower(r_name) || '"]' AS qualities FROM region WHERE r_regionkey = 1""",
}


def with_views(sql: str) -> str:
    """SQL over the views, as one statement."""
    return "WITH " + ", ".join(f"{name} AS ({body})" for name, body in VIEWS.items()) + (", " + sql[5:] if sql.startswith("WITH ") else " " + sql)
