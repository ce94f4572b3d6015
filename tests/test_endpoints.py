"""Endpoints of scripts, address templates, nested sitemaps, differences of snapshots."""

import random
from collections import Counter, defaultdict
from urllib.parse import urlsplit

import pytest

from sieveworks.operators import endpoints
from sieveworks.sources import dom

HTML = """<link rel="search" href="/open.xml"><meta name="api-base" content="https://a.net/v2"><script>fetch("/api/list?q=1"); $.get('search/all'); var u = "https://b.net/api/x"; tracker("/api/pixel.gif")</script>
<script>var apiUrl = 'https://c.net/x', endpoint: "/e"; fetch('/other')</script><script>"/api/a"</script>"""


def test_endpoints_of_scripts(spark):
    found = dom.elements(spark.createDataFrame([(1, HTML), (2, None), (3, "<p>/api/x</p>")], "page_id long, html string"))
    got = {(r["page_id"], r["endpoint"]) for r in endpoints.script_endpoints(found).collect()}
    # The last script is too short.
    assert got == {(1, e) for e in ("/open.xml", "https://a.net/v2", "/api/list?q=1", "search/all", "https://b.net/api/x", "https://c.net/x")}


def test_uses_of_endpoints(spark):
    scripts = spark.createDataFrame([("a", "/find?q=1"), ("a", "/x"), ("b", "/search")], "host string, endpoint string")
    robots = spark.createDataFrame([("a", "/api/y"), ("a", "/private"), ("b", "/search")], "host string, endpoint string")
    got = {tuple(r) for r in endpoints.endpoint_uses(scripts, robots).collect()}
    assert got == {("a", "/find?q=1", True, True), ("a", "/x", False, True), ("b", "/search", True, True), ("a", "/api/y", False, True)}


def brute_templates(rows, most):
    groups = defaultdict(list)
    for host, url in rows:
        parts = urlsplit(url)
        named = [("", s) for s in parts.path.split("/") if s] + [tuple([*f.split("=", 1), ""][:2]) for f in parts.query.split("&") if f]
        groups[host, len(named), tuple(n for n, _ in named)].append((url, named))
    out = Counter()
    for (host, *_), listed in groups.items():
        wide = [i for i in range(len(listed[0][1])) if len({named[i][1] for _, named in listed}) > most]
        for _, named in listed:
            shown = [(n, f"{{{wide.index(i) + 1}}}" if i in wide else v) for i, (n, v) in enumerate(named)]
            query = "&".join(f"{n}={v}" for n, v in shown if n)
            out[host, "/" + "/".join(v for n, v in shown if not n) + (f"?{query}" if query else "")] += 1
    return out


def test_templates_equal_brute_force(spark):
    rng = random.Random(5)
    rows = [(f"h{rng.randint(0, 2)}", f"https://x.net/{rng.choice(['en', 'fr'])}/{rng.randint(0, 30)}" + rng.choice(["", "/", f"?page={rng.randint(0, 20)}", f"?a=1&b={rng.randint(0, 3)}", "?flag", "#top", "/more/x"])) for _ in range(400)] + [("h9", "https://x.net"), ("h9", "https://x.net/?")]
    frame = spark.createDataFrame([*rows, (None, "https://x.net/1"), ("h", None)], "host string, url string")
    got = {(r["host"], r["template"]): r["n_urls"] for r in endpoints.url_templates(frame).collect()}
    assert got == dict(brute_templates(rows, endpoints.MOST_VALUES)) and ("h0", "/en/{1}") in got
    assert endpoints.url_templates(frame.limit(0)).count() == 0


def test_sitemaps_of_three_levels_and_a_cycle(spark):
    index = lambda *urls: "<sitemapindex>" + "".join(f"<sitemap><loc>{u}</loc><lastmod>2020</lastmod></sitemap>" for u in urls) + "</sitemapindex>"
    pages = lambda *urls: "<urlset>" + "".join(f"<url>\n<loc> {u} </loc></url>" for u in urls) + "</urlset>"
    stored = [("root", index("a", "b", "missing")), ("a", index("c", "root")), ("b", pages("/1", "/2?x=1&amp;y=2")), ("c", pages("/1", "<![CDATA[/3]]>")), ("d", pages("/never")), ("e", "no map"), ("f", None)]
    documents = spark.createDataFrame(stored, "url string, body string")
    got = {tuple(r) for r in endpoints.sitemap_pages(documents, spark.createDataFrame([("root",), ("e",), ("f",), (None,)], "url string")).collect()}
    assert got == {("/1", 1, "b"), ("/2?x=1&y=2", 1, "b"), ("/3", 2, "c")}
    assert endpoints.sitemap_pages(documents, spark.createDataFrame([], "url string")).count() == 0


@pytest.mark.parametrize("keys", [["k"], ["k", "v"]])
def test_differences_of_snapshots(spark, keys):
    old = [(1, "a", "x"), (2, "b", None), (3, "c", "x"), (None, "n", "x"), (5, "r", "1"), (5, "r", "2"), (6, "s", None)]
    new = [(1, "a", "x"), (2, "b", "y"), (4, "d", "x"), (None, "n", "x"), (5, "r", "2"), (5, "r", "1"), (6, "s", "")]
    schema = "k long, v string, w string"
    got = {(r["k"], r["state"]) for r in endpoints.snapshot_difference(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema), keys).collect()}
    assert got == {(1, "same"), (2, "changed"), (3, "gone"), (4, "added"), (None, "same"), (5, "same"), (6, "changed")}
