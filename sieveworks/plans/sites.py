"""Queries of page sources and headers."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveworks.plans.registry import query
from sieveworks.sources import pages as P
from sieveworks.sources import sitemarks as K
from sieveworks.sources import tables as T

#: Sources of many kinds: pages, and marks put before some of them.
MARKS = ("", "<script>window.__NUXT__={}</script>", '<script type="application/ld+json">{"@type":"Movie"}</script>', "<div ng-app>", '<link href="/wp-content/x.css">', "<rss>", "{", '<form action="/login">', '<script src="/a.chunk.js"></script><script src="b.js.map"></script>', "<noscript>Enable JavaScript</noscript>", 'var u = "https://cdn.e.net/v.mp4?x=1";', "<div data-reactroot>")
_Q = [m.replace("'", "''") for m in MARKS]
_PAGES = "m AS (SELECT page_id, url, CASE page_id % 12 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(_Q)) + " END || html AS h FROM pages)"


def _pages(spark, sf):
    mark = F.get(F.array(*map(F.lit, MARKS)), (F.col("page_id") % len(MARKS)).cast("int"))
    return T.table(spark, sf, "pages").select("page_id", "url", F.concat(mark, "html").alias("h"))


def _any(parts, text="h"):
    return "(" + " OR ".join("contains({}, '{}')".format(text, p.replace("'", "''")) for p in parts) + ")"


@query(rf"""WITH {_PAGES} SELECT page_id, CASE WHEN regexp_matches(h, '(?i)<(rss|feed|channel)[\s>]') THEN 'RSS' WHEN ends_with(url, '.xml') OR contains(url, '/feed') THEN 'XML' WHEN {_any(("__NEXT_DATA__", "_next/static", "/_next/"))} THEN 'NEXTJS' WHEN {_any(("__NUXT__", "_nuxt/"))} THEN 'NUXTJS'
 WHEN {_any(("data-reactroot", "__REACT_DEVTOOLS", "reactProps"))} THEN 'SPA_REACT' WHEN {_any(("data-v-", "__VUE__", "v-app"))} THEN 'SPA_VUE' WHEN {_any(("ng-app", "ng-controller", "[ng-"))} THEN 'SPA_ANGULAR' WHEN contains(h, 'type="application/ld+json"') THEN 'JSON_LD'
 WHEN contains(h, 'application/json') THEN 'JSON_EMBEDDED' WHEN starts_with(ltrim(h), chr(123)) OR starts_with(ltrim(h), '[') THEN 'JSON_API' ELSE 'HTML_STANDARD' END AS format FROM m""")
def page_formats(spark, sf):
    return _pages(spark, sf).select("page_id", K.data_format(F.col("h"), F.col("url")).alias("format"))


@query(f"""WITH {_PAGES}, l AS (SELECT *, lower(h) AS x FROM m) SELECT page_id, CASE {" ".join(f"WHEN {_any(ms, 'x')} THEN '{n}'" for n, ms in K.SYSTEMS.items())} WHEN {_any(("__NEXT_DATA__", "/_next/"))} THEN 'Next.js' WHEN {_any(("__NUXT__", "_nuxt/"))} THEN 'Nuxt.js'
 WHEN {_any(("data-reactroot", "_ReactDOM"))} THEN 'React SPA' WHEN {_any(("ng-version", "ng-app"))} THEN 'Angular' WHEN contains(h, 'data-v-') AND contains(h, '__vue_') THEN 'Vue.js' WHEN contains(h, 'sveltekit') THEN 'SvelteKit' WHEN contains(h, 'astro-island') THEN 'Astro' ELSE 'Unknown' END AS system FROM l""")
def page_systems(spark, sf):
    return _pages(spark, sf).select("page_id", K.content_system(F.col("h"), F.lit("")).alias("system"))


@query(rf"""WITH {_PAGES} SELECT page_id, {_any(K.SCRIPT_MARKS)} OR length(h) < 200 AND len(regexp_extract_all(h, '<script[^>]+src')) >= 3 OR contains(lower(regexp_extract(h, '(?is)<noscript[^>]*>(.*?)</noscript>', 1)), 'javascript') AND length(h) < 500 AS script,
 regexp_matches(h, '(?i)<form[^>]+action="[^"]*login|<input[^>]+(name|type)="password"|id="login-required"') AS login FROM m""")
def page_needs(spark, sf):
    h = F.col("h")
    n = F.regexp_count(h, F.lit(r"<script[^>]+src"))
    return _pages(spark, sf).select("page_id", K.needs_script(h, h, n).alias("script"), K.needs_login(h).alias("login"))


@query(rf"""WITH {_PAGES}, s AS (SELECT *, regexp_extract_all(h, '(?i)<script[^>]+src="([^"]*)"', 1) AS srcs FROM m) SELECT page_id, (len(list_filter(srcs, lambda s: regexp_matches(lower(s), 'chunk|webpack|_next/'))) + len(regexp_extract_all(h, 'webpackJsonp|__webpack_require__|webpackChunk')))::BIGINT AS chunks,
 (len(regexp_extract_all(h, 'sourceMappingURL=[^*\s]+')) + len(list_filter(srcs, lambda s: ends_with(lower(s), '.map'))))::BIGINT AS maps, len(regexp_extract_all(h, '(?i)[''"`][^''"`]*(?:api|ajax|graphql|search|endpoint)[^''"`]*[''"`]'))::BIGINT AS endpoints,
 array_to_string(list_distinct(regexp_extract_all(h, '(?i)[''"`]([^''"`]+(?:\.m3u8|\.mpd|\.mp4|\.webm)[^''"`]*)[''"`]', 1))[1:20], ' ') AS media FROM s""")
def page_bundles(spark, sf):
    rows = _pages(spark, sf).select("page_id", K.bundle_counts(F.col("h")).alias("b"), K.media_in_source(F.col("h")).alias("u"))
    return rows.select("page_id", "b.chunks", "b.maps", "b.endpoints", F.array_join("u", " ").alias("media"))


@query(r"""WITH m AS (SELECT page_id, '<meta property="og:title" content="T' || page_id || '"><meta name="twitter:card" content="old"><meta content="new" name="twitter:card"><meta name="robots" content="x"><meta name="author" content="">' || html AS h FROM pages),
 t AS (SELECT page_id, unnest(regexp_extract_all(h, '(?is)<meta\s[^>]*>')) AS tag, generate_subscripts(regexp_extract_all(h, '(?is)<meta\s[^>]*>'), 1) AS i FROM m),
 p AS (SELECT page_id, i, regexp_extract(tag, '(?is)\s(?:property|name)\s*=\s*"([^"]*)"', 1) AS k, regexp_extract(tag, '(?is)\scontent\s*=\s*"([^"]*)"', 1) AS v FROM t),
 l AS (SELECT page_id, k, arg_max(v, i) AS v FROM p WHERE v <> '' AND regexp_matches(k, '^(og:|twitter:)|^(description|keywords|author)$') GROUP BY ALL) SELECT page_id, string_agg(k || '=' || v, '|' ORDER BY k) AS tags FROM l GROUP BY 1""")
def page_meta(spark, sf):
    head = F.concat(F.lit('<meta property="og:title" content="T'), F.col("page_id").cast("string"), F.lit('"><meta name="twitter:card" content="old"><meta content="new" name="twitter:card"><meta name="robots" content="x"><meta name="author" content="">'))
    rows = T.table(spark, sf, "pages").select("page_id", K.meta_tags(F.concat(head, "html")).alias("m"))
    return rows.select("page_id", F.array_join(F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat_ws("=", e["key"], e["value"])), "|").alias("tags"))


@query("""SELECT page_id, CASE WHEN starts_with(url, 'https') THEN 20 ELSE 0 END + CASE WHEN page_id % 2 = 0 THEN 20 ELSE 0 END + CASE WHEN page_id % 3 = 0 THEN 15 ELSE 0 END + CASE WHEN page_id % 5 = 0 THEN 5 ELSE 0 END AS points,
 CASE page_id % 4 WHEN 0 THEN 'Secure, HttpOnly' WHEN 1 THEN 'No security flags' WHEN 2 THEN 'SameSite' ELSE 'No cookies' END AS cookie, CASE page_id % 6 WHEN 0 THEN 'Cloudflare' WHEN 1 THEN 'Fastly' WHEN 2 THEN 'Generic CDN' ELSE 'Unknown' END AS cdn,
 CASE WHEN page_id % 7 = 0 THEN 'via,x-cache' ELSE '' END AS relays, CASE WHEN page_id % 6 = 0 THEN 'Cloudflare' ELSE 'None detected' END AS shield FROM pages""")
def header_profiles(spark, sf):
    i = F.col("page_id")
    entry = lambda when, k, v: F.when(when, F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")))
    headers = F.map_from_entries(F.array_compact(F.array(
        entry(i % 2 == 0, "Content-Security-Policy", "default-src"), entry(i % 3 == 0, "x-frame-options", "DENY"), entry(i % 5 == 0, "Referrer-Policy", "origin"),
        F.coalesce(entry(i % 4 == 0, "Set-Cookie", "a=1; Secure; HTTPONLY"), entry(i % 4 == 1, "Set-Cookie", "a=1"), entry(i % 4 == 2, "Set-Cookie", "a=1; samesite=lax")),
        F.coalesce(entry(i % 6 == 0, "CF-RAY", "1"), entry(i % 6 == 1, "X-Served-By", "fastly"), entry(i % 6 == 2, "Server", "my-cdn")), entry(i % 7 == 0, "Via", "1.1"), entry(i % 7 == 0, "X-Cache", "HIT"))))
    rows = T.table(spark, sf, "pages").select("page_id", K.header_profile(F.col("url"), headers).alias("p"), K.shield_label(headers, F.lit("")).alias("shield"))
    return rows.select("page_id", "p.*", "shield")


@query("""WITH a AS (SELECT conv_id * 100 + turn AS ts, text, 'noise {"is_fresh":' || CASE conv_id % 3 WHEN 0 THEN 'false' WHEN 1 THEN 'true' ELSE 'null' END || ',"freshness_score":0.' || (conv_id % 10) || ',"corrected_category":"Films","confidence":0.' || (turn % 10) || '} end' AS raw FROM conversations)
 SELECT ts, CASE WHEN regexp_matches(lower(text), 'not found|404|login|sign in|captcha|just a moment|enable javascript') THEN 0.25 ELSE 0.82 END::DOUBLE AS quality, CASE ts // 100 % 3 WHEN 0 THEN false WHEN 1 THEN true ELSE ts // 100 % 10 >= 8 END AS fresh, CASE WHEN ts % 100 % 10 >= 8 THEN 'Films' ELSE 'TV' END AS category, raw[7:-5] AS part FROM a""")
def response_rules(spark, sf):
    c = T.table(spark, sf, "conversations")
    i, t = F.col("conv_id"), F.col("turn")
    fresh = F.when(i % 3 == 0, "false").when(i % 3 == 1, "true").otherwise("null")
    raw = F.concat(F.lit('noise {"is_fresh":'), fresh, F.lit(',"freshness_score":0.'), (i % 10).cast("string"), F.lit(',"corrected_category":"Films","confidence":0.'), (t % 10).cast("string"), F.lit("} end"))
    part = K.json_part(raw)
    return c.select((i * 100 + t).alias("ts"), K.response_quality(F.col("text")).alias("quality"), K.freshness_verdict(part).alias("fresh"), K.fixed_category(F.lit("TV"), part).alias("category"), part.alias("part"))


@query(r"""WITH r AS (SELECT page_id, 'User-agent: *' || chr(10) || 'Disallow: /a' || page_id || chr(10) || 'Allow: /b ' || chr(10) || 'Sitemap: https://e.net/s.xml' || chr(10) || 'Allow: /b' AS t,
  '#EXTM3U' || chr(10) || '#EXT-X-STREAM-INF:BANDWIDTH=' || (page_id * 10) || chr(10) || '# c' || chr(10) || 'low.m3u8' || chr(10) || '#EXT-X-STREAM-INF:BANDWIDTH=1500' || chr(10) || 'high.m3u8' AS m FROM pages)
 SELECT page_id, '/a' || page_id || ' /b https://e.net/s.xml' AS paths, CASE WHEN page_id * 10 >= 1500 THEN 'low.m3u8' ELSE 'high.m3u8' END AS variant, page_id % 3 = 0 AS finite FROM r""")
def text_sources(spark, sf):
    i = F.col("page_id")
    robots = F.concat(F.lit("User-agent: *\nDisallow: /a"), i.cast("string"), F.lit("\nAllow: /b \nSitemap: https://e.net/s.xml\nAllow: /b"))
    master = F.concat(F.lit("#EXTM3U\n#EXT-X-STREAM-INF:BANDWIDTH="), (i * 10).cast("string"), F.lit("\n# c\nlow.m3u8\n#EXT-X-STREAM-INF:BANDWIDTH=1500\nhigh.m3u8"))
    media = F.concat(F.lit("#EXTM3U\n#EXTINF:4\na.ts\n"), F.when(i % 3 == 1, "#EXT-X-KEY:METHOD=AES-128\n").otherwise(""), F.when(i % 3 == 2, "").otherwise("#EXT-X-ENDLIST"))
    return T.table(spark, sf, "pages").select("page_id", F.array_join(P.robots_paths(robots), " ").alias("paths"), P.best_variant(master).alias("variant"), P.finite_playlist(media).alias("finite"))
