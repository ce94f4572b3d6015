"""Selectors against a matcher by definition, and results drawn by stored selectors."""

import random
import re

import pytest

from sieveworks.sources import dom, selectors

HTML = """<html><body class="Main"><nav id="top"><ul><li class="a item">One <a href="/1">x</a></li><li class="item b"><a HREF="/2" title="T">y</a><li>Three<a>z</a></ul></nav>
<div class="card item" data-id="7"><h2>Card</h2><div class="card"><h2>Inner</h2><a href="/in">go</a><img data-src="/i.png"></div><p>text <b>bold</b><p>more</div>
<table><tr><td>1<td class="item">2<tr><td>3</table><a href="https://o.net/z">end</a><span lang="EN-us"></span></body></html>"""
LISTED = [
    "li", "*", "nav li", "nav > li", "ul > li + li", "li ~ li", "li + li + li", ".item", ".ITEM", "li.item.b", "#top", "nav#top ul", "div div", "div .card h2", "div > .card > h2, nav a", "[href]",
    "a[href^='/']", "a[href$=\"/Z\"]", "a[href*=in]", "[title=t]", "[lang=en-US]", "[^data-]", "a[href!='/1']", "[href~=^/[12]$]", "li:first-child", "td:nth-child(2)", "body  >  *", "h2,p , b",
    ".card .card, .card", "tr + tr td", "p + p", "body * * h2", "missing", "div[data-id] > p ~ p", "[class*='ard']", "li:contains(THREE) a", "p:contains(bold)",
]


def brute(elements, selector):
    """Places of the elements of one page that a selector matches."""
    by = {e["place"]: e for e in elements}

    def simple(e, s):
        attrs = dict(e["attrs"])

        def test(name, op, value):
            own = attrs.get(name)
            low = None if own is None else own.strip().lower()
            if op == "contains":
                return value in e["text"].lower()
            if op == "prefix":
                return any(k.startswith(name) for k in attrs)
            if op == "!=":
                return low != value
            if low is None:
                return False
            return {"has": True, "=": low == value, "^=": low.startswith(value), "$=": low.endswith(value), "*=": value in low, "~=": bool(re.search(value, own)) if op == "~=" else None}[op]

        siblings = [x["place"] for x in elements if x["parent"] == e["parent"]]
        return (
            s["tag"] in (None, e["tag"]) and s["id"] in (None, e["id"]) and set(s["classes"]) <= {c.lower() for c in e["classes"]}
            and all(test(*t) for t in s["tests"]) and (s["nth"] is None or siblings.index(e["place"]) + 1 == s["nth"])
        )

    def fits(e, chain):
        if not simple(e, chain[-1]):
            return False
        if len(chain) == 1:
            return True
        joint = chain[-1]["combinator"]
        before = [x for x in elements if x["parent"] == e["parent"] and x["place"] < e["place"]]
        if joint == " ":
            near, up = [], e["parent"]
            while up >= 0:
                near.append(by[up])
                up = by[up]["parent"]
        else:
            near = {">": [by[e["parent"]]] if e["parent"] >= 0 else [], "+": before[-1:], "~": before}[joint]
        return any(fits(x, chain[:-1]) for x in near)

    return {e["place"] for e in elements if any(fits(e, c) for c in selectors.parse(selector))}


@pytest.fixture(scope="module")
def found(spark):
    rng = random.Random(4)

    def tree(depth):
        return "".join(f"<{t} class='{rng.choice(['a', 'b', 'a b', ''])}'>{tree(depth - 1) if depth else 'x'}</{t}>" for t in rng.choices(["div", "span", "ul"], k=rng.randint(1, 3)))

    pages = [(1, HTML), (2, tree(5)), (3, None), (4, ""), (5, "plain")]
    return dom.stored(spark.createDataFrame(pages, "page_id long, html string"))


def test_matches_equal_the_definition(spark, found):
    listed = [*LISTED, "div div div", "div > span div", ".a + .b > .a", ".a ~ .b .a.b", "ul *", "span ~ div ~ ul", "div > div > *", ".a .b, .b .a", None, "", "[", "a >", "> a", "a:unknown", "a,,b"]
    table = spark.createDataFrame(list(enumerate(listed)), "selector_id long, selector string")
    got = selectors.match(found, dom.write_table(selectors.compile_selectors(table), "steps")).collect()
    by_page = {p: [r.asDict() for r in found.where(f"page_id = {p}").orderBy("place").collect()] for p in (1, 2)}
    for i, selector in enumerate(listed):
        for p, elements in by_page.items():
            try:
                expected = brute(elements, selector or "")
            except ValueError:
                expected = set()
            mine = [r["place"] for r in got if r["page_id"] == p and r["selector_id"] == i]
            assert sorted(mine) == sorted(expected), (selector, p)
    assert not [r for r in got if r["page_id"] > 2] and any(r["page_id"] == 2 for r in got)


def test_many_steps_meet_elements_by_a_shuffle(spark, found, monkeypatch):
    monkeypatch.setattr(selectors, "BROADCAST_STEPS", 0)
    table = spark.createDataFrame([(1, "nav li")], "selector_id long, selector string")
    assert selectors.match(found, dom.write_table(selectors.compile_selectors(table), "steps")).count() == 3


def test_open_tags_end_where_html_ends_them(found):
    rows = {(r["tag"], r["text"]): r for r in found.where("page_id = 1").collect()}
    assert ("p", "text bold") in rows and ("p", "more") in rows and ("td", "1") in rows and ("li", "y") in rows
    assert rows["p", "more"]["parent"] == rows["p", "text bold"]["parent"] and rows["p", "more"]["sibling"] == 3
    inner = rows["h2", "Inner"]
    assert inner["path"][-1] == inner["parent"] and len(inner["path"]) == inner["depth"] and inner["size"] == 5


def test_first_selector_of_each_kind(spark, found):
    kinds = {"title": ("h1", "h2.title", "h2"), "date": (".date", "[datetime]"), "nav": (".menu", "nav")}
    got = {(r["page_id"], r["kind"], r["selector"], r["n_matches"]) for r in selectors.first_matching(found, kinds).collect()}
    assert got == {(1, "title", "h2", 2), (1, "nav", "nav", 1)}


def test_results_by_stored_selectors(spark):
    pages = spark.createDataFrame([(1, 1, HTML), (2, 2, HTML), (3, 9, HTML), (4, 1, None)], "page_id long, provider_id long, html string")
    configs = spark.createDataFrame(
        [(1, "nav li", "a", "a[href]", None, None), (2, ".card", "h2", "a", "b", "img"), (3, "body", "h2", "a", None, None), (9, None, "a", "a", None, None)],
        "provider_id long, result string, title string, url string, description string, thumbnail string",
    )
    bases = spark.createDataFrame([(i, f"https://p{i}.net/") for i in range(10)], "provider_id long, base string")
    got = [tuple(r) for r in selectors.items_of_configs(pages, configs, bases).drop("item").orderBy("page_id", "item").collect()]
    assert got == [
        (1, 1, "x", "https://p1.net/1", None, None),
        (1, 1, "y", "https://p1.net/2", None, None),
        (2, 2, "Card Inner", "https://p2.net/in", "bold", "https://p2.net/i.png"),
        (2, 2, "Inner", "https://p2.net/in", None, "https://p2.net/i.png"),
    ]


def test_no_pages_and_no_selectors(spark, found):
    none = spark.createDataFrame([], "selector_id long, selector string")
    assert selectors.match(found, dom.write_table(selectors.compile_selectors(none), "steps")).count() == 0
    assert selectors.match(found.limit(0), dom.write_table(selectors.compile_selectors(spark.createDataFrame([(1, "a b")], none.schema)), "steps")).count() == 0
