"""Layout patterns of pages: grids, cards, lists, tables, told by how alike siblings are built; and the patterns that selectors tell.

An element's build is its tag, the tags of its children, and whether an image, a link or a heading lies in it. These
come bottom-up: child tags by one aggregation over parents, the rest from running sums over document order. Members of a group
are compared with its first, so a group costs as many comparisons as it has members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveworks.operators.containers import child_counts, css_paths, holds_any, subtree_sums
from sieveworks.sources import dom, selectors

# Fixed values.
#: A pattern's confidence is defined on so many first members of its group.
HEAD = 5
GRIDS = (".grid", "[class*='grid']", ".row > .col", ".flex-wrap", ".masonry")
CARDS = (".card", "[class*='card']", ".tile", ".box", ".item", ".entry", "article")
LAZY = ("[data-src]", "[data-lazy-src]", "[loading='lazy']", ".lazy", "[class*='lazy']", "[data-original]")
SCROLL_MARKS = ("infinite-scroll", "infinitescroll", "infinite_scroll", "data-infinite", "intersectionobserver", "scroll-trigger", "load-more-trigger", "waypoint")
COLUMN_HINTS = (("col-3", 4), ("col-4", 3), ("col-6", 2), ("grid-cols-2", 2), ("grid-cols-3", 3), ("grid-cols-4", 4), ("columns-2", 2), ("columns-3", 3), ("columns-4", 4))
SEARCH_FORMS = ("form[action*='search']", "form[role='search']", "form#search", "form.search", ".search-form", "#searchForm", "form[method='get']")
SEARCH_INPUTS = ("input[type='search']", "input[name*='search']", "input[name='q']", "input[name='query']", "input[placeholder*='search' i]", "#search-input")
RESULT_LISTS = (".results", "#results", ".search-results", "#search-results", ".result-list", ".content-list", ".items", ".videos", ".movies")
RESULT_ITEMS = (".result", ".item", ".card", ".video-item", ".movie-item", ".torrent", ".row", "article", ".entry", ".post")
PAGINATION = (".pagination", ".pager", ".page-numbers", ".pages", "nav.pagination", ".paginate", "[class*='pagination']")
PLAYERS = ("video", "iframe[src*='player']", ".video-player", "#player", "iframe[src*='youtube']", "iframe[src*='vimeo']", ".jwplayer", ".plyr")
NAVIGATION = ("nav", ".navigation", ".menu", "#menu", ".navbar", "header nav")
FIELDS = {
    "title": ("h1", "h2.title", ".title", "#title", "[class*='title']", ".name", ".item-title", ".video-title", ".movie-title"),
    "description": (".description", "#description", ".desc", ".synopsis", ".summary", "[class*='description']", "p.info"),
    "date": (".date", ".time", ".timestamp", "[datetime]", ".posted", ".published", "[class*='date']"),
    "rating": (".rating", ".stars", ".score", "[data-rating]", ".imdb-rating", "[class*='rating']"),
    "search_input": SEARCH_INPUTS,
}
#: Kind, confidence in hundredths and selector of what is told by its first element.
MARKED = (
    ("LOAD_MORE_BUTTON", 90, "button:contains(Load More), a:contains(Load More), .load-more, #load-more"), ("THUMBNAIL_GRID", 85, ".thumbnails, .thumb-grid, .video-grid, .image-grid"),
    ("CARD_LAYOUT", 85, ".cards, .card-container, .card-grid"), ("FILTER_PANEL", 80, ".filters, .filter-panel, #filters, [class*='filter']"), ("CATEGORY_LIST", 85, ".categories, .category-list, #categories"),
    ("RATING_SYSTEM", 80, ".rating, .stars, [class*='rating'], [data-rating]"), ("LOGIN_FORM", 90, "form[action*='login'], form#login, .login-form"),
)


def similarity(found: DataFrame, members: DataFrame, keys: list[str], most: int | None = None) -> DataFrame:
    """members: page_id, keys, n (0 for the first), place, last, tag. For each group its number of members and how alike they are, or
    the first `most` if given: the mean agreement with the first in tag, child tags, image, link and heading; 0 for a group of one."""
    compared = members if most is None else members.where(F.col("n") < most)
    tags = found.where("parent >= 0").groupBy("page_id", F.col("parent").alias("place")).agg(F.collect_set("tag").alias("tags"), F.count("*").alias("n_tags"))
    built = subtree_sums(found, compared.join(tags, ["page_id", "place"], "left"), {"images": F.col("tag") == "img", "links": F.col("tag") == "a", "headings": F.col("tag").isin("h1", "h2", "h3", "h4", "h5", "h6")})
    none = F.array().cast("array<string>")
    build = F.struct("tag", F.coalesce("tags", none).alias("tags"), F.coalesce("n_tags", F.lit(0)).alias("n_tags"), (F.col("images") > 0).alias("image"), (F.col("links") > 0).alias("link"), (F.col("headings") > 0).alias("heading"))
    rows = built.select("page_id", *keys, "n", build.alias("b"))
    rows = rows.withColumn("r", F.min_by("b", "n").over(Window.partitionBy("page_id", *keys)))
    b, r = F.col("b"), F.col("r")
    both = F.size(F.array_intersect(r["tags"], b["tags"]))
    children = F.when((both == F.size(r["tags"])) & (both == F.size(b["tags"])), 2).when(both * 2 > r["n_tags"], 1).otherwise(0)
    halves = children + sum((F.when(b[f] == r[f], 2).otherwise(0) for f in ("image", "link", "heading")), F.when(b["tag"] == r["tag"], 2).otherwise(0))
    alike = rows.groupBy("page_id", *keys).agg(F.count("*").alias("n_members"), F.sum(F.when(F.col("n") > 0, halves)).alias("halves"), F.count_if(F.col("n") > 0).alias("others"))
    if most is not None:
        alike = members.groupBy("page_id", *keys).agg(F.count("*").alias("n_members")).join(alike.drop("n_members"), ["page_id", *keys])
    share = F.when(F.col("others") > 0, F.col("halves") / (F.col("others") * 10)).otherwise(0.0)
    return alike.select("page_id", *keys, "n_members", share.alias("similarity"))


def sibling_groups(found: DataFrame, most: int | None = HEAD) -> DataFrame:
    """page_id, parent, n_members and similarity (of all members if `most` is None) of the children of each element that has two at least."""
    members = found.where("parent >= 0").select("page_id", "parent", F.col("sibling").alias("n"), "place", "last", "tag")
    return similarity(found, members, ["parent"], most).where("n_members > 1")


def _selected(found: DataFrame, kinds: dict[str, tuple[str, ...]]) -> DataFrame:
    """page_id, kind, rank, selector, place of all matches of selectors by kind."""
    rows = [(k, n, s) for k, listed in kinds.items() for n, s in enumerate(listed)]
    table = found.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(rows)], "selector_id long, kind string, rank int, selector string")
    marked = selectors.match(found, dom.write_table(selectors.compile_selectors(table), "steps"))
    return dom.write_table(marked.join(F.broadcast(table), "selector_id").drop("selector_id"), "selected")


def columns_of(classes: Column, n: Column) -> Column:
    """How many columns a grid has: by the first class that tells, else by the number of its items."""
    told = lambda name: F.coalesce(*[F.when(name.contains(part), columns) for part, columns in COLUMN_HINTS])
    first = F.get(F.filter(F.transform(classes, told), lambda v: v.isNotNull()), F.lit(0))
    return F.coalesce(first, F.when(n >= 12, 4).when(n >= 6, 3).otherwise(2))


def layout_patterns(found: DataFrame, pages: DataFrame) -> DataFrame:
    """pages: page_id, html. page_id, kind, selector, confidence, n_items and n_columns of the grid, cards, list and table that come
    first in a page, and whether it scrolls on or loads late. A selector that is none (as for a style rule) matches nothing."""
    chosen = _selected(found, {"grid": GRIDS, "card": CARDS, "lazy": LAZY})
    counts = child_counts(found)
    narrow = found.select("page_id", "place", "last", "tag", "classes")

    # The groups to compare: of grids the first match of each selector, of cards all matches, of lists the children.
    grids = chosen.where("kind = 'grid'").groupBy("page_id", "rank", "selector").agg(F.min("place").alias("holder"))
    grids = grids.join(counts.withColumnRenamed("place", "holder"), ["page_id", "holder"]).where("n_children >= 4")
    grids = grids.groupBy("page_id").agg(F.min(F.struct("rank", "selector", "holder", "n_children")).alias("g")).select("page_id", "g.*")
    cards = chosen.where("kind = 'card'").withColumn("n", F.row_number().over(Window.partitionBy("page_id", "rank").orderBy("place")) - 1)
    child = found.where("parent >= 0").select("page_id", F.col("parent").alias("holder"), F.col("sibling").alias("n"), "place", "last", F.col("tag").alias("child_tag"))
    uniform = child.groupBy("page_id", "holder").agg(F.count("*").alias("n_children"), (F.min("child_tag") == F.max("child_tag")).alias("uniform"))
    lists = narrow.withColumnRenamed("place", "holder").join(uniform, ["page_id", "holder"])
    lists = lists.where((F.col("tag").isin("ul", "ol") & (F.col("n_children") >= 5)) | (F.col("tag").isin("div", "section") & F.col("uniform") & (F.col("n_children") >= 4)))
    held = grids.select("page_id", "holder", F.lit("grid").alias("kind")).unionByName(lists.select("page_id", "holder", F.lit("list").alias("kind")))
    groups = child.join(held, ["page_id", "holder"]).select("page_id", "kind", F.col("holder").alias("key"), "n", "place", "last", F.col("child_tag").alias("tag"))
    cards = cards.join(narrow, ["page_id", "place"]).select("page_id", "kind", F.col("rank").alias("key"), "n", "place", "last", "tag")
    groups = dom.write_table(groups.unionByName(cards), "layout-groups")
    alike = dom.write_table(similarity(found, groups, ["kind", "key"], HEAD), "layout-alike")

    c = F.col
    grid = alike.where("kind = 'grid'").join(grids.withColumnRenamed("holder", "key"), ["page_id", "key"]).join(narrow.withColumnRenamed("place", "key"), ["page_id", "key"])
    sure = F.least(F.lit(0.6) + F.when(c("n_children") >= 8, 0.1).otherwise(0.0) + c("similarity") * 0.3, F.lit(1.0))
    grid = grid.select("page_id", F.lit("GRID").alias("kind"), "selector", sure.alias("confidence"), c("n_children").alias("n_items"), columns_of(c("classes"), c("n_children")).alias("n_columns"))
    names = F.element_at(F.array(*map(F.lit, CARDS)), (c("key") + 1).cast("int"))
    card = alike.where("kind = 'card' AND n_members >= 3 AND similarity > 0.7").groupBy("page_id").agg(F.min(F.struct("key", "similarity", "n_members")).alias("g")).select("page_id", "g.*")
    card = card.select("page_id", F.lit("CARD_LAYOUT").alias("kind"), names.alias("selector"), c("similarity").alias("confidence"), c("n_members").alias("n_items"), F.lit(None).cast("int").alias("n_columns"))
    plain = F.when(c("tag").isin("ul", "ol"), 0).otherwise(1)
    listed = alike.where("kind = 'list'").join(narrow.withColumnRenamed("place", "key"), ["page_id", "key"]).withColumn("order", plain)
    listed = listed.where(c("similarity") > F.when(c("order") == 0, 0.6).otherwise(0.7)).groupBy("page_id").agg(F.min(F.struct("order", "key", "similarity", "n_members")).alias("g")).select("page_id", "g.*")
    listed = listed.withColumnRenamed("key", "place").join(css_paths(found, listed.select("page_id", c("key").alias("place"))), ["page_id", "place"])
    listed = listed.select("page_id", F.lit("LIST").alias("kind"), c("css_path").alias("selector"), c("similarity").alias("confidence"), c("n_members").alias("n_items"), F.lit(None).cast("int").alias("n_columns"))

    # A table's rows, and the cells of its first row.
    tables = subtree_sums(found, found.where("tag = 'table'").select("page_id", "place", "last"), {"rows": c("tag") == "tr"}).where("rows >= 3")
    tables = tables.groupBy("page_id").agg(F.min(F.struct("place", "last", "rows")).alias("t")).select("page_id", "t.*")
    first = found.where("tag = 'tr'").select("page_id", c("place").alias("tr"), c("last").alias("tr_last")).join(tables, "page_id").where("tr BETWEEN place AND last")
    first = first.groupBy("page_id").agg(F.min(F.struct("tr", "tr_last")).alias("r")).select("page_id", c("r.tr").alias("place"), c("r.tr_last").alias("last"))
    cells = subtree_sums(found, first, {"cells": c("tag").isin("td", "th")}).select("page_id", "cells")
    table = tables.join(css_paths(found, tables.select("page_id", "place")), ["page_id", "place"]).join(cells, "page_id")
    table = table.select("page_id", F.lit("TABLE").alias("kind"), c("css_path").alias("selector"), F.lit(0.9).alias("confidence"), c("rows").alias("n_items"), c("cells").cast("int").alias("n_columns"))

    flag = lambda rows, kind, selector, sure: rows.select("page_id", F.lit(kind).alias("kind"), F.lit(selector).alias("selector"), F.lit(sure).alias("confidence"), F.lit(None).cast("long").alias("n_items"), F.lit(None).cast("int").alias("n_columns"))
    scrolls = flag(pages.where(holds_any(F.lower("html"), SCROLL_MARKS)), "INFINITE_SCROLL", "[data-infinite-scroll], .infinite-scroll", 0.8)
    late = flag(chosen.where("kind = 'lazy'").select("page_id").distinct(), "LAZY_LOADING", "[data-src], [loading='lazy']", 0.9)
    out = grid
    for part in (card, listed, table, scrolls, late):
        out = out.unionByName(part)
    return out


def site_patterns(found: DataFrame, pages: DataFrame) -> DataFrame:
    """pages: page_id, html. page_id, kind, selector, confidence and n_matches of the patterns that selectors tell.

    Each form, list, page bar and menu selector with a match is a row; of item selectors the one with most matches (three at
    least; data attributes count as their selector's length), of players the first; the others are told by
    their first element, whose path is the selector."""
    kinds = {"SEARCH_FORM": SEARCH_FORMS, "RESULT_LIST": RESULT_LISTS, "PAGINATION": PAGINATION, "NAVIGATION": NAVIGATION, "item": RESULT_ITEMS, "data": ("[data-id], [data-item], [data-result]",), "player": PLAYERS}
    kinds |= {"scroll": ("[data-infinite-scroll], .infinite-scroll, [class*='infinite']",), "password": ("form input[type='password']",)} | {k: (s,) for k, _, s in MARKED}
    chosen, c = _selected(found, kinds), F.col
    counts = dom.write_table(chosen.groupBy("page_id", "kind", "rank", "selector").agg(F.count("*").alias("n_matches"), F.min("place").alias("place")), "selector-counts")
    tenths = F.lit(5) + F.when(c("selector").startswith("#"), 3).otherwise(0) + F.when(holds_any(c("selector"), ("search", "result", "item", "content")), 2).otherwise(0) - F.when(c("n_matches") > 5, 1).otherwise(0)
    row = lambda rows, kind, sure, n="n_matches": rows.select("page_id", kind.alias("kind"), "selector", sure.alias("confidence"), (c(n) if n else F.lit(None)).cast("long").alias("n_matches"))
    out = [row(counts.where(c("kind").isin("SEARCH_FORM", "RESULT_LIST", "PAGINATION", "NAVIGATION")), c("kind"), tenths / 10)]
    data = counts.where("kind = 'data' AND n_matches >= 3").join(found.select("page_id", "place", "attrs"), ["page_id", "place"])
    name = F.when(dom.attr("data-id").isNotNull(), "[data-id]").when(dom.attr("data-item").isNotNull(), "[data-item]").otherwise("[data-result]")
    data = data.select("page_id", F.lit(len(RESULT_ITEMS)).alias("rank"), name.alias("selector"), F.length(name).cast("long").alias("n_matches"))
    items = counts.where("kind = 'item' AND n_matches >= 3").select("page_id", "rank", "selector", "n_matches").unionByName(data)
    best = items.groupBy("page_id").agg(F.max_by(F.struct("selector", "n_matches"), F.struct("n_matches", -c("rank"))).alias("b")).select("page_id", "b.*")
    out.append(row(best, F.lit("RESULT_ITEM"), F.least(c("n_matches") / 20, F.lit(1.0))))
    player = counts.where("kind = 'player'").groupBy("page_id").agg(F.min_by(F.struct("selector", "n_matches"), "rank").alias("b")).select("page_id", "b.*")
    out.append(row(player, F.lit("VIDEO_PLAYER"), F.lit(0.9)))
    scrolls = pages.where(holds_any(c("html"), ("IntersectionObserver", "infinite"))).select("page_id").unionByName(counts.where("kind = 'scroll'").select("page_id")).distinct()
    out.append(row(scrolls.withColumn("selector", F.lit("[data-infinite-scroll]")), F.lit("INFINITE_SCROLL"), F.lit(0.7), None))
    login = chosen.where("kind = 'password'").join(found.select("page_id", "place", "path"), ["page_id", "place"]).select("page_id", F.explode("path").alias("place"))
    login = login.join(found.where("tag = 'form'").select("page_id", "place"), ["page_id", "place"]).select("page_id", F.lit("LOGIN_FORM").alias("kind"), "place")
    named = counts.where(c("kind").isin(*[k for k, _, _ in MARKED])).select("page_id", "kind", "place").unionByName(login).groupBy("page_id", "kind").agg(F.min("place").alias("place"))
    sure = F.lit(0)
    for k, points, _ in MARKED:
        sure = F.when(c("kind") == k, points).otherwise(sure)
    named = named.join(css_paths(found, named.select("page_id", "place").distinct()), ["page_id", "place"]).withColumn("selector", c("css_path"))
    out.append(row(named, c("kind"), sure / 100, None))
    rows = out[0]
    for part in out[1:]:
        rows = rows.unionByName(part)
    return rows
