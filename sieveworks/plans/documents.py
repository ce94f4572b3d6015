"""Queries of pages' elements. Those whose rows can be told from the source by patterns have SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveworks.plans.registry import query
from sieveworks.sources import dom
from sieveworks.sources import pages as P
from sieveworks.sources import tables as T


def _pages(spark, sf):
    return T.table(spark, sf, "pages").select("page_id", "html")


def _elements(spark, sf):
    return dom.stored(_pages(spark, sf))


def _base():
    return F.lit("https://e.net/")


_COUNT = lambda tag: f"len(regexp_extract_all(html, '(?i)<{tag}[\\s>]'))"
#: Addresses and texts of the links in the first menu, which the stored pages write as list items.
_LINKS = """l AS (SELECT page_id, unnest(regexp_extract_all(n, '(?s)<li><a href="([^"]*)">(.*?)</a></li>', 1)) AS href, replace(replace(replace(unnest(regexp_extract_all(n, '(?s)<li><a href="([^"]*)">(.*?)</a></li>', 2)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS text,
 generate_subscripts(regexp_extract_all(n, '(?s)<li><a href="([^"]*)">(.*?)</a></li>', 1), 1) AS i FROM (SELECT page_id, regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1) AS n FROM pages))"""


@query("SELECT page_id, " + ", ".join(f"{_COUNT(t)} AS n_{t}" for t in ("form", "a", "script", "iframe", "img", "video")) + ", CASE WHEN " + _COUNT("iframe") + " = 0 THEN 0 WHEN " + _COUNT("iframe") + " < 3 THEN 1 ELSE 2 END AS frame_depth FROM pages")
def dom_structure(spark, sf):
    from sieveworks.functions.urls import iframe_depth

    found = dom.structure(dom.elements(_pages(spark, sf)))
    return found.select("page_id", "n_form", "n_a", "n_script", "n_iframe", "n_img", "n_video", iframe_depth(F.col("n_iframe")).alias("frame_depth"))


@query()
def dom_areas(spark, sf):
    return dom.content_areas(_elements(spark, sf))


@query(f"WITH {_LINKS} SELECT page_id, text AS title, 'https://e.net' || href AS url, NULL::VARCHAR AS thumbnail, nullif(regexp_extract(text, '(\\d{{1,2}}:\\d{{2}}(:\\d{{2}})?)'), '') AS duration FROM l WHERE length(text) >= 2")
def dom_items(spark, sf):
    """The list items of pages as results."""
    return dom.items(_elements(spark, sf), F.col("tag") == "li", _base()).select("page_id", "title", "url", "thumbnail", "duration")


@query("""SELECT page_id, action, 'q' AS name, 'https://e.net' || action || '?q=old+film' AS url FROM (SELECT page_id, regexp_extract(html, '(?i)<form[^>]*\\saction="(/[^"?]*search[^"?]*)"', 1) AS action FROM pages) WHERE action <> ''""")
def dom_search_forms(spark, sf):
    return dom.search_forms(_elements(spark, sf), _base(), F.lit("old film"))


@query(f"WITH {_LINKS} SELECT page_id, text, href AS url FROM l")
def dom_menus(spark, sf):
    return dom.menu_links(_elements(spark, sf)).select("page_id", "text", "url")


@query(f"""WITH {_LINKS}, u AS (SELECT page_id, 'https://e.net' || href AS url, min(i) AS i FROM l WHERE (contains(lower(text), 'next') OR contains(text, '>')) AND href <> '' AND NOT starts_with(href, '#') GROUP BY ALL)
 SELECT * FROM (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i)::INT AS rank, url FROM u) WHERE rank <= 5""")
def dom_further_pages(spark, sf):
    return dom.page_links(_elements(spark, sf), _base())


@query(r"""SELECT page_id, 'data' AS kind, regexp_extract(tag, '\sdata-title="([^"]*)"', 1) AS title, regexp_extract(tag, '\sdata-url="([^"]*)"', 1) AS url FROM (SELECT page_id, unnest(regexp_extract_all(html, '<\w[^>]*\sdata-title="[^>]*>')) AS tag FROM pages) WHERE title <> '' AND url <> ''
 UNION ALL SELECT page_id, 'linked', regexp_extract(j, '"name"\s*:\s*"([^"]*)"', 1) AS t, regexp_extract(j, '"url"\s*:\s*"([^"]*)"', 1) AS u FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<script type="application/ld.json">(.*?)</script>', 1)) AS j FROM pages) WHERE t <> '' AND u <> ''
 UNION ALL SELECT page_id, 'embedded', regexp_extract(j, '"title"\s*:\s*"([^"]*)"', 1) AS t, regexp_extract(j, '"url"\s*:\s*"([^"]*)"', 1) AS u FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?s)(?:var|const)\s+(?:videos?|movies?|items?|results?|data)\s*=\s*(\[\{.+?\}\]);', 1)) AS j FROM pages) WHERE t <> '' AND u <> ''
 UNION ALL SELECT page_id, k, n, u FROM (SELECT page_id, unnest(['linked', 'embedded', 'data']) AS k, unnest([t, t, host]) AS n, unnest([url, url, '/of/' || host]) AS u FROM (SELECT page_id, url, trim(regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1)) AS t, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages WHERE starts_with(url, 'http') AND html IS NOT NULL)) WHERE k <> 'data' OR n <> ''""")
def dom_data(spark, sf):
    """What pages name as linked data, in scripts' arrays and as data attributes; each is given its title and address in the first two, and its host in the third."""
    title, host = F.trim(P.page_title(F.col("html"))), F.regexp_extract("url", "://([^/?#]*)", 1)
    linked = F.to_json(F.struct(F.lit("Movie").alias("@type"), title.alias("name"), F.col("url").alias("url")))
    listed = F.to_json(F.array(F.struct(title.alias("title"), F.col("url").alias("url"))))
    head = F.concat(F.lit('<script type="application/ld+json">'), linked, F.lit("</script><script>var items = "), listed, F.lit(';</script><div data-title="'), host, F.lit('" data-url="/of/'), host, F.lit('"></div>'))
    own = F.when(F.col("url").startswith("http"), head).otherwise("")
    found = dom.stored(T.table(spark, sf, "pages").select("page_id", F.concat(F.coalesce(own, F.lit("")), "html").alias("html")))
    parts = {"linked": dom.linked_data(found), "embedded": dom.embedded_items(found), "data": dom.data_items(found)}
    rows = [p.select("page_id", F.lit(k).alias("kind"), "title", "url") for k, p in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(r"""SELECT page_id, lower(tag) || '_tag' AS method, 'https://e.net' || src AS url FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<(video|source)\s[^>]*src="(/[^"]*)"', 1)) AS tag, unnest(regexp_extract_all(html, '(?i)<(video|source)\s[^>]*src="(/[^"]*)"', 2)) AS src FROM pages)
 UNION ALL SELECT page_id, 'json_ld', unnest(regexp_extract_all(j, '"(?:contentUrl|embedUrl|url|contentURL)"\s*:\s*"(http[^"]+)"', 1)) FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<script type="application/ld.json">(.*?)</script>', 1)) AS j FROM pages)
 UNION ALL SELECT page_id, 'meta_tag', trim(u) FROM (SELECT page_id, unnest(regexp_extract_all(html, '<meta property="(?:og:video|og:video:url|og:video:secure_url|twitter:player:stream)" content="([^"]*)"', 1)) AS u FROM pages) WHERE starts_with(trim(u), 'http')""")
def dom_media(spark, sf):
    return dom.media_candidates(_elements(spark, sf), _base()).select("page_id", "method", "url")


@query("SELECT page_id, url || '/long-name.mp4' AS url FROM pages WHERE starts_with(url, 'http')")
def hidden_media(spark, sf):
    """Addresses below each page's own, written as base64 in its source."""
    url = F.concat("url", F.lit("/long-name.mp4"))
    rows = T.table(spark, sf, "pages").select("page_id", F.concat(F.lit("x = atob('"), F.regexp_replace(F.base64(url.cast("binary")), r"\s", ""), F.lit("');"), "html").alias("h"))
    return rows.select("page_id", F.explode(dom.decoded_urls(F.col("h"))).alias("url"))


@query("SELECT page_id, 0 AS place, t AS title, url, regexp_extract(url, '([0-9]{1,4})', 1) AS year FROM (SELECT page_id, trim(regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1)) AS t, url FROM pages) WHERE t <> '' AND url <> ''")
def feed_entries(spark, sf):
    """Each page's title and address as a feed's item, dated by the first number of its address."""
    year, title = F.regexp_extract("url", "([0-9]{1,4})", 1), P.page_title(F.col("html"))
    xml = F.concat(F.lit("<rss><item><title><![CDATA["), title, F.lit("]]></title><link>"), F.col("url"), F.lit("</link><pubDate>"), year, F.lit("</pubDate></item></rss>"))
    return dom.feed_items(T.table(spark, sf, "pages").select("page_id", xml.alias("xml"))).select("page_id", "place", "title", "url", "year")
