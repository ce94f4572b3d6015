"""Elements and extractors of pages, by literal cases."""

import base64

import pytest
from pyspark.sql import functions as F

from sieveworks.sources import dom

HTML = """<html><head><title>T</title><meta property="og:video" content="https://c.net/og.mp4"><script type="application/ld+json">[{"@type":"Movie","name":"Film","url":"/f","datePublished":"2020-02-03"},{"@type":"Person","name":"x","url":"/p"}]</script>
<script>var videos = [{"title":"One","url":"/1","thumb":"t.jpg"},{"name":"Two"}];</script></head><body>
<nav class="menu"><a href="/a">A</a><a href="/b">B <b>bold</b></a></nav>
<form action="/go"><input name="x"></form><form action="/find" id="search"><input name="query"><input name="s"></form>
<main><div class="card"><h2>First film</h2><a href="/one"><img data-src="//c.net/1.jpg" src="data:x"></a><span class="duration">1:02:03</span><span class="badge">HD</span><p>Some text 1999</p><i class="rating">8.5/10</i></div>
<div class="card"><a href="javascript:x()">Bad</a></div><div class="card"><a href="https://o.net/two">Second one 12:30</a><br><div style="background-image:url('/bg.png')"></div></div></main>
<video data-hls="/v.m3u8"><source src="v.mp4"></video><div data-title="D" data-url="/d" data-year="2001"></div>
<div class="pagination"><a href="?p=2">2</a><a href="#x">3</a><a href="?p=2">2</a></div><a rel="next" href="/n">more</a></body></html>"""


@pytest.fixture(scope="module")
def found(spark):
    return dom.elements(spark.createDataFrame([(1, HTML), (2, ""), (3, None), (4, "<p>open <b>x")], "page_id int, html string")).cache()


def base():
    return F.lit("https://e.net/")


def test_elements_are_nested_and_hold_their_text(found):
    rows = {(r["page_id"], r["place"]): r for r in found.collect()}
    assert {p for p, _ in rows} == {1, 4}
    menu = next(r for r in rows.values() if r["tag"] == "nav")
    assert menu["text"] == "AB bold" and menu["classes"] == ["menu"]
    assert [r["tag"] for r in rows.values() if r["page_id"] == 1 and menu["place"] < r["place"] <= menu["last"]] == ["a", "a", "b"]
    assert rows[4, 0]["text"] == "open x" and rows[4, 0]["last"] == 1
    assert dom.elements(found.sparkSession.createDataFrame([], "page_id int, html string")).count() == 0


def test_structure_and_areas(found):
    one = {r["page_id"]: r for r in dom.structure(found).collect()}[1]
    assert (one["n_form"], one["n_a"], one["n_video"], one["n_img"]) == (2, 9, 1, 1)
    areas = [(r["rule"], r["tag"], r["n_children"], round(r["confidence"], 2)) for r in dom.content_areas(found).collect()]
    assert areas == [(0, "main", 3, 0.5)]


def test_items_of_cards(found):
    got = [tuple(r)[2:] for r in dom.items(found, dom.has_class("card"), base()).orderBy("item").collect()]
    assert got == [
        ("First film", "https://e.net/one", "Some text 1999", "https://c.net/1.jpg", "1:02:03", "HD", "1999", "8.5"),
        ("Second one 12:30", "https://o.net/two", None, "https://e.net/bg.png", "12:30", None, None, None),
    ]


def test_forms_menus_and_further_pages(found):
    assert [tuple(r)[1:] for r in dom.search_forms(found, base(), F.lit("old film")).collect()] == [("/find", "query", "https://e.net/find?query=old+film")]
    assert [(r["text"], r["url"]) for r in dom.menu_links(found).orderBy("place").collect()] == [("A", "/a"), ("B bold", "/b")]
    assert [r["url"] for r in dom.page_links(found, base()).orderBy("rank").collect()] == ["https://e.net/?p=2", "https://e.net/n"]


def test_data_in_scripts_and_attributes(found):
    assert [(r["type"], r["title"], r["url"], r["year"]) for r in dom.linked_data(found).collect()] == [("Movie", "Film", "/f", "2020")]
    assert [(r["title"], r["url"], r["thumbnail"]) for r in dom.embedded_items(found).collect()] == [("One", "/1", "t.jpg")]
    assert [(r["title"], r["url"], r["year"]) for r in dom.data_items(found).collect()] == [("D", "/d", "2001")]


def test_media(found):
    got = {(r["method"], r["url"]) for r in dom.media_candidates(found, base()).collect()}
    assert got == {("video_tag", "https://e.net/v.m3u8"), ("source_tag", "https://e.net/v.mp4"), ("meta_tag", "https://c.net/og.mp4")}


def test_hidden_urls(spark):
    url = "https://cdn.example.net/a/b.mp4"
    escaped = "".join(f"\\u{ord(c):04x}" for c in url)
    percent = "".join(f"%{ord(c):02X}" for c in url)
    html = f"atob('{base64.b64encode(url.encode()).decode()}') unescape(\"{percent}\") x = '{escaped}'"
    got = spark.createDataFrame([(html,), ("plain",), (None,)], "h string").select(dom.decoded_urls(F.col("h")).alias("u")).collect()
    assert got[0]["u"] == [url] * 3 and got[1]["u"] == [] and got[2]["u"] is None


def test_feeds(spark):
    xml = "<rss><channel><item><title>A</title><link>https://e.net/a</link><pubDate>2021-01-01</pubDate><description><![CDATA[<b>x</b> y]]></description></item><item><title>No link</title></item></channel></rss>"
    atom = '<feed><entry><title>B</title><link href="https://e.net/b"/><summary>s</summary><updated>2022-05-01</updated></entry></feed>'
    got = dom.feed_items(spark.createDataFrame([(1, xml), (2, atom), (3, None)], "page_id int, xml string")).orderBy("page_id").collect()
    assert [tuple(r)[2:] for r in got] == [("A", "https://e.net/a", "x y", "2021"), ("B", "https://e.net/b", "s", "2022")]
