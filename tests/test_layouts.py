"""Containers, their classes and items, and layout patterns, by literal pages and by definition."""

import random

import pytest

from sieveworks.operators import containers, layout
from sieveworks.plans import layouts
from sieveworks.sources import dom

CARD = '<div class="card"><img src="/t{0}.jpg"><h3>Film number {0}</h3><a href="/watch/{0}">Watch film {0} now</a><span class="duration">1:0{0}:00</span><span class="rating">7.{0}/10</span></div>'
SHOP = f"""<html><head><title>Home of films</title></head><body><nav class="genre-menu"><a href="/genre/a">Action (12)</a><a href="/genre/b">Comedy</a><a href="/genre/c">Drama</a><a href="/genre/d">Horror</a><a href="/genre/e">Comedy</a><a href="">None</a></nav>
<div class="results"><div class="grid">{''.join(CARD.format(i) for i in range(4))}<div class="card">No link 2019 HD season</div></div></div>
<div class="sponsor banner ads">Buy the premium offer now, a deal for each and every subscriber</div>
<table><thead><tr><th>a</th><th>b</th></tr></thead><tr><td>1<td>2<tr><td>3<td>4</table><img data-src="/late.png"></body></html>"""
PLAIN = "<p>one</p><ul><li><a>1</a></li><li><a>2</a></li><li>3</li><li><a>4</a></li><li><a>5</a></li><li><img></li></ul><script>new IntersectionObserver(f)</script><form id='enter'><input type='PASSWORD'></form><button>load more</button>"


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(1, "https://films.net/", SHOP), (2, "https://o.net/x", PLAIN), (3, None, None), (4, "https://o.net/search?a", ""), (5, "https://o.net/genre/x", "text")], "page_id long, url string, html string")


@pytest.fixture(scope="module")
def found(pages):
    return dom.stored(pages.select("page_id", "html"))


@pytest.fixture(scope="module")
def classed(found):
    return dom.write_table(containers.classify(found, containers.find_containers(found)), "classed")


def test_containers_keep_the_outer_one(found, classed):
    # The grid fills most of the results, so it goes; the address part of a class name counts as well as the class.
    assert {r["selector"] for r in classed.collect()} == {"nav.genre-menu", "div.results"}


def test_outermost_equals_brute_force(spark):
    rng, rows = random.Random(2), []

    def nest(page, place, depth):
        last, size = place, rng.randint(5, 20)
        for _ in range(rng.randint(0, 3) if depth else 0):
            last, inner = nest(page, last + 1, depth - 1)
            size += inner
        rows.append((page, place, last, size))
        return last, size

    for page in range(30):
        nest(page, 0, 4)
    rows = [r for r in rows if rng.random() < 0.7]
    kept = {(r["page_id"], r["place"]) for r in containers.outermost(spark.createDataFrame(rows, "page_id long, place int, last int, size int")).collect()}
    inside = lambda a, b: a[0] == b[0] and b[1] < a[1] <= b[2]
    assert kept == {r[:2] for r in rows if not any(inside(r, o) and o[3] < 2 * r[3] for o in rows)}


def test_classes_and_scores(classed):
    got = {r["selector"]: (r["kind"], r["confidence"], r["category_score"], r["content_score"], r["ad_score"]) for r in classed.collect()}
    # Two words in the attributes, the class, six short links, five addresses; its links run together, so its words are long.
    assert got["nav.genre-menu"] == ("CATEGORY_NAVIGATION", 1.05, 1.05, 0.0, 0.0)
    # The class 25, items 20, images and links 15, lengths and ratings 20, a badge 15, a year, a rating and a word 10 each, addresses 25; it has one child.
    assert got["div.results"] == ("CONTENT_RESULTS", 1.5, 0.0, 1.5, 0.0)


def test_subtree_sums_equal_brute_force(found):
    rows = found.where("page_id = 1").orderBy("place").collect()
    roots = found.select("page_id", "place", "last")
    got = {r["place"]: r["n"] for r in containers.subtree_sums(found, roots, {"n": found["tag"] == "a"}).where("page_id = 1").collect()}
    assert got == {r["place"]: sum(x["tag"] == "a" for x in rows if r["place"] <= x["place"] <= r["last"]) for r in rows}


def test_page_types(pages, found, classed):
    got = {r["page_id"]: r["kind"] for r in containers.page_types(pages.select("page_id", "url"), found, classed).collect()}
    assert got == {1: "CONTENT_LISTING", 2: "UNKNOWN", 3: "UNKNOWN", 4: "SEARCH_RESULTS", 5: "CATEGORY_LISTING"}


def test_items_of_the_main_container(found, classed):
    got = [tuple(r)[2:] for r in containers.result_items(found, classed).orderBy("place").collect()]
    assert got == [(f"Film number {i}", f"/watch/{i}", f"/t{i}.jpg", f"1:0{i}:00", None, None, f"7.{i}", "MOVIE") for i in range(4)]


def test_items_of_categories(found, classed):
    got = sorted(tuple(r)[1:] for r in containers.category_items(found, classed).collect())
    assert got == [("Action (12)", "/genre/a", 12), ("Comedy", "/genre/b", None), ("Drama", "/genre/c", None), ("Horror", "/genre/d", None)]


def test_layouts(pages, found):
    got = {(r["page_id"], r["kind"]): (r["selector"], round(r["confidence"], 4), r["n_items"], r["n_columns"]) for r in layout.layout_patterns(found, pages.select("page_id", "html")).collect()}
    assert got == {
        # Of the grid's cards the last has no image, link, heading or child: a fifth agrees, so the mean over four is 0.8.
        (1, "GRID"): (".grid", 0.84, 5, 2), (1, "CARD_LAYOUT"): (".card", 0.8, 5, None), (1, "LIST"): ("html > body > div.results > div.grid", 0.8, 5, None),
        (1, "TABLE"): ("html > body > table", 0.9, 3, 2), (1, "LAZY_LOADING"): ("[data-src], [loading='lazy']", 0.9, None, None),
        (2, "LIST"): ("ul", round((10 + 6 + 10 + 10) / 40, 4), 6, None), (2, "INFINITE_SCROLL"): ("[data-infinite-scroll], .infinite-scroll", 0.8, None, None),
    }


def test_sibling_groups_equal_brute_force(found):
    rows = [r for r in found.where("page_id IN (1, 2)").orderBy("page_id", "place").collect()]

    def build(e):
        inside = [x for x in rows if x["page_id"] == e["page_id"] and e["place"] <= x["place"] <= e["last"]]
        return e["tag"], [x["tag"] for x in inside if x["parent"] == e["place"]], *(any(x["tag"] in tags for x in inside) for tags in (("img",), ("a",), ("h1", "h2", "h3", "h4", "h5", "h6")))

    def agree(a, b):
        same = set(a[1]) & set(b[1])
        children = 1 if set(a[1]) == set(b[1]) else 0.5 if len(same) > len(a[1]) * 0.5 else 0
        return (children + sum(x == y for x, y in zip((a[0], *a[2:]), (b[0], *b[2:])))) / 5

    expected = {}
    for e in rows:
        children = [x for x in rows if x["page_id"] == e["page_id"] and x["parent"] == e["place"]]
        if len(children) > 1:
            first, *others = map(build, children[:5])
            expected[e["page_id"], e["place"]] = (len(children), pytest.approx(sum(agree(first, o) for o in others) / len(others)))
    got = {(r["page_id"], r["parent"]): (r["n_members"], r["similarity"]) for r in layout.sibling_groups(found).collect()}
    assert got == expected


def test_sibling_similarity_compares_all_children(spark, tmp_path):
    # Four items agree with the first; twenty hold an image instead of the link, so they agree in tag and heading alone.
    html = "<ul>" + 5 * "<li><a>x</a></li>" + 20 * "<li><img></li>" + "</ul><p>y</p>"
    spark.createDataFrame([(7, html)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    rows = layouts.sibling_similarity(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in rows] == [(7, 0, 25, (4 * 10 + 20 * 4) / 240)]


def test_columns_by_class_and_number(spark):
    rows = spark.createDataFrame([(["x", "grid-cols-4"], 3), (["col-6"], 20), ([], 12), ([], 6), (["y"], 5)], "classes array<string>, n int")
    assert [r[0] for r in rows.select(layout.columns_of(rows["classes"], rows["n"])).collect()] == [4, 2, 4, 3, 2]


def test_site_patterns(pages, found):
    got = {(r["page_id"], r["kind"]): (r["selector"], r["confidence"], r["n_matches"]) for r in layout.site_patterns(found, pages.select("page_id", "html")).collect() if r["kind"] != "RESULT_LIST"}
    assert got == {
        (1, "NAVIGATION"): ("nav", 0.5, 1), (1, "RESULT_ITEM"): (".card", 0.25, 5), (1, "RATING_SYSTEM"): ("html > body > div.results > div.grid > div.card:nth-child(1) > span.rating", 0.8, None),
        (2, "INFINITE_SCROLL"): ("[data-infinite-scroll]", 0.7, None), (2, "LOGIN_FORM"): ("form", 0.9, None), (2, "LOAD_MORE_BUTTON"): ("button", 0.9, None),
    }


def test_no_pages(spark, pages, found):
    none = found.limit(0)
    assert containers.find_containers(none).count() == 0 and layout.sibling_groups(none).count() == 0
    assert layout.layout_patterns(none, pages.limit(0).select("page_id", "html")).count() == 0
