"""Addresses that sites offer: endpoints that scripts name, templates of many addresses, pages that nested sitemaps list.

Templates are found by counting: addresses of one host and shape (segments and query keys) are laid side by side, and a place that
takes many values is a variable. Counts are combined where addresses are read; nothing of a host is gathered. Sitemaps are
followed in rounds over stored documents, each document once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveworks.operators.containers import holds_any
from sieveworks.sources import dom
from sieveworks.sources.store import write_table

# Fixed values.
SCRIPT_PATTERNS = (
    r"(?i)(?:fetch|axios\.get|axios\.post|\$\.ajax|\$\.get|\$\.post|XMLHttpRequest)\s*\(\s*['\"`](/?(?:api|ajax|graphql|search|json)[^'\"`\s]*?)['\"`]", r"(?i)['\"`](https?://[^'\"`\s]*?/api/[^'\"`\s]*?)['\"`]",
    r"(?i)['\"`](/api/[^'\"`\s]*?)['\"`]", r"(?i)['\"`](/?wp-json/[^'\"`\s]*?)['\"`]", r"(?i)apiUrl\s*[:=]\s*['\"`]([^'\"`\s]+)['\"`]", r"(?i)baseUrl\s*[:=]\s*['\"`]([^'\"`\s]+)['\"`]",
    r"(?i)searchUrl\s*[:=]\s*['\"`]([^'\"`\s]+)['\"`]", r"(?i)endpoint\s*[:=]\s*['\"`]([^'\"`\s]+)['\"`]",
)
NOT_ENDPOINTS = ("analytics", "tracking", "pixel")
SEARCH_MARKS, API_MARKS = ("search", "query", "q="), ("api", "ajax", "json")
#: A place of an address with more distinct values than this is a variable.
MOST_VALUES = 8
#: Rows of hosts and shapes that are sent to all executors.
BROADCAST_SHAPES = 200_000


def script_endpoints(found: DataFrame) -> DataFrame:
    """page_id and endpoint, each once, of the addresses that a page's scripts of more than 10 characters, search links and
    API metas name; what measures visits is left out."""
    scripts = found.where((F.col("tag") == "script") & (F.length("text") > 10))
    named = F.flatten(F.array(*[F.regexp_extract_all("text", F.lit(p), F.lit(1)) for p in SCRIPT_PATTERNS]))
    rows = scripts.select("page_id", F.explode(F.transform(named, lambda u: F.trim(u))).alias("endpoint"))
    rows = rows.where((F.length("endpoint") > 3) & ~holds_any(F.col("endpoint"), NOT_ENDPOINTS))
    links = found.where((F.col("tag") == "link") & (F.lower(dom.attr("rel")) == "search") & (dom.attr("href") != "")).select("page_id", dom.attr("href").alias("endpoint"))
    metas = found.where((F.col("tag") == "meta") & F.lower(dom.attr("name")).isin("api-url", "api-base") & (dom.attr("content") != "")).select("page_id", dom.attr("content").alias("endpoint"))
    return rows.unionByName(links).unionByName(metas).distinct()


def endpoint_uses(endpoints: DataFrame, robots: DataFrame) -> DataFrame:
    """endpoints: host, endpoint of scripts. robots: host, endpoint of robots files. host, endpoint, is_search, is_api, each once:
    those of scripts are all taken for APIs, those of robots files by their names."""
    scripts = endpoints.select("host", "endpoint", holds_any(F.col("endpoint"), SEARCH_MARKS).alias("is_search"), F.lit(True).alias("is_api"))
    paths = robots.where(holds_any(F.col("endpoint"), API_MARKS)).select("host", "endpoint", F.lit(False).alias("is_search"), F.lit(True).alias("is_api"))
    return scripts.unionByName(paths).groupBy("host", "endpoint").agg(F.max("is_search").alias("is_search"), F.max("is_api").alias("is_api"))


def _parts(url: Column) -> Column:
    """The path's segments, then the query's fields, in order, as struct(name, value); name is empty for segments."""
    path, query = F.regexp_extract(url, r"^[^?#]*?://[^/?#]*([^?#]*)", 1), F.regexp_extract(url, r"\?([^#]*)", 1)
    segments = F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), lambda s: F.struct(F.lit("").alias("name"), s.alias("value")))
    fields = F.transform(F.filter(F.split(query, "&"), lambda f: f != ""), lambda f: F.struct(F.split(f, "=", 2)[0].alias("name"), F.coalesce(F.get(F.split(f, "=", 2), F.lit(1)), F.lit("")).alias("value")))
    return F.concat(segments, fields)


def url_templates(urls: DataFrame, most_values: int = MOST_VALUES) -> DataFrame:
    """urls: host, url. host, template, n_urls, n_variables and example (the least) of all addresses that are not null.

    In a template the places with more than most_values distinct values, over all addresses of a host with as many segments
    and the same query keys, read {1}, {2} and so on. Fragments are left out; repeats count. A host may have any share of the rows."""
    rows = urls.where("url IS NOT NULL AND host IS NOT NULL").select("host", "url", _parts(F.col("url")).alias("parts"))
    names = F.transform("parts", lambda p: p["name"])
    rows = rows.withColumn("shape", F.concat_ws("&", F.size("parts").cast("string"), names))
    values = rows.select("host", "shape", F.posexplode("parts").alias("at", "p")).groupBy("host", "shape", "at", F.col("p.value").alias("value")).agg(F.lit(1).alias("one"))
    wide = values.groupBy("host", "shape", "at").agg(F.count("*").alias("n")).where(F.col("n") > most_values)
    shapes = write_table(wide.groupBy("host", "shape").agg(F.sort_array(F.collect_list("at")).alias("variables")), "url-shapes")
    joined = rows.join(F.broadcast(shapes) if shapes.count() <= BROADCAST_SHAPES else shapes, ["host", "shape"], "left")
    variables = F.coalesce("variables", F.array().cast("array<int>"))
    shown = F.transform("parts", lambda p, i: F.struct(p["name"].alias("name"), F.when(F.array_contains(variables, i), F.concat(F.lit("{"), F.array_position(variables, i).cast("string"), F.lit("}"))).otherwise(p["value"]).alias("value")))
    made = joined.select("host", "url", F.size(variables).alias("n_variables"), shown.alias("s"))
    path = F.concat(F.lit("/"), F.array_join(F.transform(F.filter("s", lambda p: p["name"] == ""), lambda p: p["value"]), "/"))
    query = F.array_join(F.transform(F.filter("s", lambda p: p["name"] != ""), lambda p: F.concat(p["name"], F.lit("="), p["value"])), "&")
    made = made.withColumn("template", F.concat(path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))
    return made.groupBy("host", "template").agg(F.count("*").alias("n_urls"), F.max("n_variables").alias("n_variables"), F.min("url").alias("example"))


def sitemap_pages(documents: DataFrame, roots: DataFrame) -> DataFrame:
    """documents: url (each once), body. roots: url. url, level and sitemap of the pages that the roots and all sitemaps listed
    by them list: the first level (0 for a root's own) and on it the least sitemap.

    Each round reads the documents of one level, and the sitemaps that no round before has met are the next; so
    sitemaps that list each other end. A listed sitemap that is not stored gives nothing; nor does a body without locations."""
    loc = r"(?is)<{0}[\s>](?:(?!</{0}>).)*?<loc>\s*(?:<!\[CDATA\[)?\s*([^<\]]*?)\s*(?:\]\]>)?\s*</loc>"
    locations = lambda kind: F.transform(F.regexp_extract_all("body", F.lit(loc.format(kind)), F.lit(1)), lambda u: F.replace(u, F.lit("&amp;"), F.lit("&")))
    frontier = write_table(roots.select("url").where("url IS NOT NULL").distinct(), "sitemap-frontier")
    seen, pages, level = frontier, [], 0
    while frontier.limit(1).count():
        met = write_table(documents.join(frontier, "url").select("url", locations("sitemap").alias("children"), locations("url").alias("pages")), "sitemaps-met")
        pages.append(met.select(F.explode("pages").alias("page"), F.lit(level).alias("level"), F.col("url").alias("sitemap")))
        children = met.select(F.explode("children").alias("url")).distinct()
        frontier = write_table(children.join(seen, "url", "left_anti"), "sitemap-frontier")
        seen, level = seen.unionByName(frontier), level + 1
    if not pages:
        return roots.select(F.col("url").cast("string"), F.lit(0).alias("level"), F.lit("").alias("sitemap")).limit(0)
    listed = reduce(DataFrame.unionByName, pages)
    best = listed.groupBy("page").agg(F.min(F.struct("level", "sitemap")).alias("b"))
    return best.select(F.col("page").alias("url"), "b.level", "b.sitemap")


def snapshot_difference(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of two snapshots of one table: keys and state: same, changed, added or gone. Rows are told apart by keys (a null
    is a key like others); of repeated keys the rows together count. A row is changed if any other column is, by its hash."""
    others = [c for c in new.columns if c not in keys]

    def hashed(rows: DataFrame, name: str) -> DataFrame:
        # A sum over rows of one key needs no order.
        own = F.xxhash64(*others, *[F.col(c).isNull() for c in others]).cast("decimal(38,0)") if others else F.lit(0).cast("decimal(38,0)")
        return rows.groupBy(*keys).agg(F.struct(F.count("*").alias("n"), F.sum(own).alias("h")).alias(name))

    both = hashed(new, "now").withColumnsRenamed({k: f"new_{k}" for k in keys}).join(
        hashed(old, "then"), reduce(Column.__and__, [F.col(f"new_{k}").eqNullSafe(F.col(k)) for k in keys]), "full_outer"
    )
    state = F.when(F.col("then").isNull(), "added").when(F.col("now").isNull(), "gone").when(F.col("now") == F.col("then"), "same").otherwise("changed")
    return both.select(*[F.when(F.col("now").isNull(), F.col(k)).otherwise(F.col(f"new_{k}")).alias(k) for k in keys], state.alias("state"))
