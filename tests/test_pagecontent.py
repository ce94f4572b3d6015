"""All that pages say of items, by literal pages."""

from pyspark.sql import functions as F

from sieveworks.operators import pagecontent

ONE = """<script id="__NEXT_DATA__">{"props":{"pageProps":{"items":[{"title":"State","url":"http://e.net/s","overview":"o"},{"title":"Film","url":"/dup"}]}}}</script>
<script type="application/ld+json">{"@type":"Movie","name":"FILM","url":"//dup"}</script><script type="application/ld+json">{"@type":"Movie","name":"Film","url":"http://e.net/f"}</script><script>var items = [{"title":"film","url":"http://e.net/f"},{"title":"Own","url":"x"}];</script>
<div data-title="Data" data-url="/d"></div><div class="card"><h2>Card one</h2><a href="/c1">x</a><p>text</p></div><div class="card"><h2>Card two</h2><a href="/c2">x</a></div><div class="grid-item"><a href="/g">Grid</a></div><div class="grid-item"><a href="/g2">Grid</a></div>"""


def test_page_content(spark):
    pages = spark.createDataFrame([(1, "https://e.net/", ONE), (2, None, None), (3, "https://e.net/feed", "<rss><item><title>A</title><link>http://e.net/a</link><description>d</description></item></rss>"), (4, "x", "")], "page_id long, url string, html string")
    content = pagecontent.page_content(pages, F.lit("https://e.net")).cache()
    got = [(r["page_id"], r["rank"], r["source"], r["title"], r["url"], r["description"], r["confidence"]) for r in content.orderBy("page_id", "rank").collect()]
    assert got == [
        (1, 1, "JSON-LD:Movie", "Film", "http://e.net/f", None, 0.9), (1, 2, "NextJS", "State", "http://e.net/s", "o", 0.85), (1, 3, "NextJS", "Film", "//dup", None, 0.85), (1, 4, "EmbeddedJSON", "Own", "/x", None, 0.85),
        (1, 5, "DataAttributes", "Data", "/d", None, 0.75), (1, 6, "HTML", "Card one", "https://e.net/c1", "text", 0.65), (1, 7, "HTML", "Card two", "https://e.net/c2", None, 0.65), (3, 1, "RSS/XML", "A", "http://e.net/a", "d", 0.8),
    ]
    summary = {r["page_id"]: (r["n_items"], round(r["confidence"], 4), r["methods"]) for r in pagecontent.content_confidence(content).collect()}
    assert summary == {1: (7, round((0.9 + 3 * 0.85 + 0.75 + 2 * 0.65) / 7, 4), ["JSON-LD:Movie", "NextJS", "EmbeddedJSON", "DataAttributes", "HTML"]), 3: (1, 0.8, ["RSS/XML"])}
    assert pagecontent.page_content(pages.limit(0), F.lit("")).count() == 0


def test_the_format_of_a_page_is_told_once(spark):
    """What follows reads the written formats: no plan over stored tables tells them from the sources again, or shuffles these."""
    pages = spark.createDataFrame([(1, "https://e.net/", ONE), (3, "https://e.net/feed", "<rss><item><title>A</title><link>/a</link></item></rss>")], "page_id long, url string, html string")
    content = pagecontent.page_content(pages, F.lit("https://e.net"))
    plan = content._jdf.queryExecution().optimizedPlan().toString()
    assert "rss|feed|channel" not in plan and "html" not in plan
    assert content.where("source = 'RSS/XML'").count() == 1
