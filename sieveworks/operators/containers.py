"""The containers of pages and what they hold: chosen, scored, classed and read by sums over document order.

Counts over a subtree are differences of two running sums: one sort of a page's elements serves all counts of all containers.
Which containers stay is decided in one pass over a page's candidates in document order with a stack of open ones. Scores
are kept in hundredths, so that sums and thresholds are exact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveworks.sources import dom, selectors

# Fixed values.
CONTAINERS = (
    ".results", "#results", ".search-results", "#search-results", ".videos", ".movies", ".content-list", ".video-list", ".movie-list", ".items", ".grid", ".list", ".catalog",
    ".collection", "[class*='result']", "[class*='video']", "[class*='movie']", "[data-results]", "[data-content]", ".categories", ".genres", ".filters", ".sidebar", "nav", ".navigation",
    ".menu", ".tabs", ".browse", "[class*='category']", "[class*='genre']", "[class*='filter']", "main", "#main", ".main", "#content", ".content", "article", ".container", "section", ".section",
)
CATEGORY_WORDS = (
    "genre", "category", "categories", "type", "filter", "sort", "browse", "explore", "discover", "top", "popular", "trending", "new", "latest", "recent", "all", "home", "menu",
    "navigation", "action", "comedy", "drama", "horror", "thriller", "romance", "sci-fi", "documentary", "animation", "anime", "sports", "news", "music", "kids", "family", "adventure",
    "fantasy", "crime", "mystery", "western", "war", "history", "biography",
)
CONTENT_WORDS = (
    "episode", "season", "part", "chapter", "video", "movie", "watch", "play", "stream", "download", "quality", "hd", "4k", "1080p", "720p", "480p", "subtitle", "sub", "dub", "duration",
    "runtime", "minutes", "hours", "views", "rating", "imdb", "year", "release", "cast", "director", "trailer",
)
AD_WORDS = ("ad", "ads", "advertisement", "sponsor", "sponsored", "promo", "promotion", "banner", "affiliate", "partner", "buy", "shop", "subscribe", "premium", "vip", "upgrade", "offer", "deal")
CONTENT_CLASSES, CATEGORY_CLASSES = ("result", "item", "video", "movie", "episode"), ("categor", "genre", "filter", "nav", "menu")
BADGES = ("hd", "4k", "1080p", "720p", "480p", "cam", "hdcam", "bluray")
CONTENT_TEXTS = (r"\d+\s*(min|hour|hr|episode|ep|season|s\d+)", r"\d{4}", r"\d+\.\d+", r"\d+\s*views?", r"(watch|play|stream)\s+(now|online|free)?")
CONTENT_PATHS = ("/watch", "/video", "/movie", "/episode", "/play", "/stream", "/view", "/v/", "/e/", "/embed")
CATEGORY_PATHS = ("/genre", "/category", "/browse", "/filter", "/type", "/tag", "/search?", "?genre=", "?category=")
ITEMS = (".item", ".card", ".video-item", ".movie-item", ".result", "article", ".entry", "li", "[class*='item']", "[class*='card']")
QUALITIES = ("4K", "2160p", "1080p", "720p", "480p", "HD", "CAM")
CATEGORY_POINTS, CONTENT_POINTS, AD_POINTS = 60, 55, 50


def holds_any(text: Column, parts: tuple[str, ...]) -> Column:
    """Whether a text holds any of the parts; false for null."""
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return F.coalesce(out, F.lit(False))


def count_any(text: Column, parts: tuple[str, ...]) -> Column:
    """How many of the parts a text holds."""
    return sum((F.when(text.contains(p), 1).otherwise(0) for p in parts[1:]), F.when(text.contains(parts[0]), 1).otherwise(0))


def subtree_sums(found: DataFrame, roots: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """roots (page_id, place, last, and more) with the sum of each measure over the root and all that lies in it.

    The running sums at last, less those before place: one window over a page, and a join by place."""
    order = Window.partitionBy("page_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    values = found.select("page_id", "place", *[v.cast("long").alias(m) for m, v in measures.items()])
    running = values.select("page_id", "place", *[F.sum(m).over(order).alias(m) for m in measures], *[F.col(m).alias(f"own_{m}") for m in measures])
    sums = dom.write_table(running, "running-sums")
    before = sums.select("page_id", "place", *[(F.col(m) - F.col(f"own_{m}")).alias(f"before_{m}") for m in measures])
    upto = sums.select("page_id", F.col("place").alias("last"), *measures)
    joined = roots.join(before, ["page_id", "place"]).join(upto, ["page_id", "last"])
    return dom.shuffled(joined.select(*roots.columns, *[(F.col(m) - F.col(f"before_{m}")).alias(m) for m in measures]))


def outermost(rows: DataFrame, times: int = 2) -> DataFrame:
    """rows: page_id, place, last, size of nested intervals. Those that lie in no other of less than so many times their size.

    One pass in document order keeps the stack of the intervals that are open; the innermost open one is the smallest."""
    listed = rows.groupBy("page_id").agg(F.array_sort(F.collect_set(F.struct("place", "last", "size"))).alias("all"))
    interval = "struct<place:int,last:int,size:int>"
    start = F.struct(F.array().cast(f"array<{interval}>").alias("open"), F.array().cast("array<int>").alias("kept"))

    def step(a: Column, x: Column) -> Column:
        still = F.filter(a["open"], lambda o: o["last"] >= x["place"])
        near = F.get(still, F.size(still) - 1)
        stays = near.isNull() | (near["size"].cast("long") >= x["size"].cast("long") * times)
        return F.struct(F.array_append(still, x).alias("open"), F.when(stays, F.array_append(a["kept"], x["place"])).otherwise(a["kept"]).alias("kept"))

    return listed.select("page_id", F.explode(F.aggregate("all", start, step)["kept"]).alias("place"))


def child_counts(found: DataFrame) -> DataFrame:
    """page_id, place and n_children of each element that has children."""
    return found.where("parent >= 0").groupBy("page_id", F.col("parent").alias("place")).agg(F.count("*").alias("n_children"))


def find_containers(found: DataFrame) -> DataFrame:
    """The containers of each page: page_id, place, rank (the number of the first selector that matches it).

    Candidates lie in the body, and have two children or 50 characters; one that fills most of another goes with it."""
    table = found.sparkSession.createDataFrame(list(enumerate(CONTAINERS)), "selector_id long, selector string")
    marked = selectors.match(found, dom.write_table(selectors.compile_selectors(table), "steps")).groupBy("page_id", "place").agg(F.min("selector_id").alias("rank"))
    body = found.where("tag = 'body'").groupBy("page_id").agg(F.min("place").alias("body"))
    rows = found.join(marked, ["page_id", "place"]).join(child_counts(found), ["page_id", "place"], "left").join(body, "page_id", "left")
    within = F.col("body").isNull() | (F.col("place") == F.col("body")) | F.array_contains("path", F.col("body"))
    large = (F.coalesce("n_children", F.lit(0)) >= 2) | (F.length("text") > 50)
    rows = dom.write_table(rows.where(within & large).select("page_id", "place", "last", "size", "rank"), "container-candidates")
    return dom.shuffled(rows.join(outermost(rows), ["page_id", "place"]).select("page_id", "place", "rank"))


def alike_children(found: DataFrame) -> DataFrame:
    """page_id, place, alike: whether of the first five children (three at least) most have the same tags as children."""
    tags = found.where("parent >= 0").groupBy("page_id", F.col("parent").alias("place")).agg(F.array_sort(F.collect_list("tag")).alias("tags"))
    first = found.where("parent >= 0 AND sibling < 5").join(tags, ["page_id", "place"], "left").select("page_id", F.col("parent").alias("place"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))
    same = first.groupBy("page_id", "place", "tags").agg(F.count("*").alias("n"))
    totals = same.groupBy("page_id", "place").agg(F.max("n").alias("most"), F.sum("n").alias("all"))
    return dom.shuffled(totals.select("page_id", "place", ((F.col("all") >= 3) & (F.col("most") >= F.floor(F.col("all") * 6 / 10))).alias("alike")))


def _class_like(*parts: str) -> Column:
    return holds_any(F.lower(dom.attr("class")), parts)


def _is_title() -> Column:
    return F.col("tag").isin("h1", "h2", "h3", "h4") | _class_like("title")


def _points(c, texts, names, classes) -> tuple[Column, Column, Column]:
    """Hundredths of the category, content and advertisement scores."""
    point = lambda condition, n: F.when(condition, n).otherwise(0)
    words = F.split(texts, r"\s+")
    short = (F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w)) < F.size(words) * 8) & (F.size(words) < 50)
    category = (
        count_any(names, CATEGORY_WORDS) * 15 + point(holds_any(classes, CATEGORY_CLASSES), 25)
        + point((c("n_links") >= 5) & (c("n_images") <= 2) & (c("link_chars") < c("n_links") * 20), 25)
        + point(short & holds_any(texts, CATEGORY_WORDS), 15) + point(c("category_urls") >= 3, 25)
    )
    content = (
        count_any(names, CONTENT_WORDS) * 12 + point(holds_any(classes, CONTENT_CLASSES), 25) + point(c("n_items") >= 3, 20) + point((c("n_items") >= 3) & c("alike"), 20)
        + point((c("n_images") >= 3) & (c("n_links") >= 3), 15) + point(c("pairs") >= 3, 30) + point(c("n_facts") >= 3, 20) + point(holds_any(texts, BADGES), 15)
        + sum((point(texts.rlike(p), 10) for p in CONTENT_TEXTS[1:]), point(texts.rlike(CONTENT_TEXTS[0]), 10)) + point(c("content_urls") >= 3, 25)
    )
    return category, content, count_any(names, AD_WORDS) * 20


def classify(found: DataFrame, chosen: DataFrame) -> DataFrame:
    """chosen: page_id, place, rank. page_id, place, last, rank, selector, kind, confidence and the three scores of each."""
    href = F.lower(dom.attr("href"))
    link, tag = F.col("tag") == "a", F.col("tag")
    named = link & F.length("text").between(5, 100)
    measures = {
        "n_links": link, "n_images": tag == "img", "n_items": tag.isin("li", "article") | dom.has_class("item") | dom.has_class("card"),
        "n_facts": _class_like("duration", "time", "views", "date", "rating") | ((tag == "span") & dom.has_class("meta")), "n_titles": _is_title() | named,
        "link_chars": F.when(link, F.length("text")).otherwise(0), "content_urls": link & holds_any(href, CONTENT_PATHS), "category_urls": link & holds_any(href, CATEGORY_PATHS),
    }
    held = found.join(chosen, ["page_id", "place"]).select("page_id", "place", "last", F.lit(None).cast("int").alias("holder"))
    children = found.join(chosen.select("page_id", F.col("place").alias("holder")), (F.col("parent") == F.col("holder")) & (found["page_id"] == chosen["page_id"]))
    children = children.select(found["page_id"], "place", "last", "holder")
    sums = dom.write_table(subtree_sums(found, held.unionByName(children), measures), "subtree-sums")
    pairs = sums.where("holder IS NOT NULL AND n_images > 0 AND n_titles > 0").groupBy("page_id", F.col("holder").alias("place")).agg(F.count("*").alias("pairs"))
    rows = sums.where("holder IS NULL").drop("holder", "last").join(pairs, ["page_id", "place"], "left").join(alike_children(found), ["page_id", "place"], "left")
    rows = rows.fillna(0, ["pairs"]).fillna(False, ["alike"]).join(chosen, ["page_id", "place"]).join(found.select("page_id", "place", "last", "tag", "id", "classes", "attrs", "text"), ["page_id", "place"])
    classes = F.lower(F.array_join("classes", " "))
    names = F.concat_ws(" ", classes, F.lower(F.coalesce("id", F.lit(""))), F.lower(F.array_join(F.map_values("attrs"), " ")))
    parts = _points(F.col, F.lower("text"), names, classes)
    scored = rows.select("page_id", "place", "last", "rank", "tag", "id", "classes", *[p.alias(n) for p, n in zip(parts, ("category", "content", "ad"))])
    c = F.col
    top = F.greatest("category", "content", "ad", F.lit(1))
    kind = (
        F.when((c("ad") > AD_POINTS) & (c("ad") * 10 >= top * 8), "ADVERTISEMENT").when((c("content") > CONTENT_POINTS) & (c("content") > c("category")), "CONTENT_RESULTS")
        .when((c("category") > CATEGORY_POINTS) & (c("category") > c("content")), "CATEGORY_NAVIGATION").when(c("content") > c("category"), "CONTENT_RESULTS").otherwise("UNKNOWN")
    )
    points = F.when(c("kind") == "ADVERTISEMENT", c("ad")).when(c("kind") == "CONTENT_RESULTS", c("content")).when(c("kind") == "CATEGORY_NAVIGATION", c("category")).otherwise(0)
    name = F.when(c("id") != "", F.concat(F.lit("#"), "id")).when(F.size("classes") > 0, F.concat_ws(".", "tag", F.slice("classes", 1, 2)))
    out = scored.withColumn("kind", kind).withColumns({"confidence": points / 100, "selector": name})
    paths = css_paths(found, out.where("selector IS NULL").select("page_id", "place"))
    out = out.join(paths, ["page_id", "place"], "left").withColumn("selector", F.coalesce("selector", "css_path"))
    return out.select("page_id", "place", "last", "rank", "selector", "kind", "confidence", *[(c(s) / 100).alias(f"{s}_score") for s in ("category", "content", "ad")])


def css_paths(found: DataFrame, rows: DataFrame) -> DataFrame:
    """rows (page_id, place) with css_path: from the root down, tag and classes of each element, with its number where others of its parent have the same."""
    part = F.concat_ws(".", "tag", "classes")
    same = F.count("*").over(Window.partitionBy("page_id", "parent", part))
    parts = found.select("page_id", F.col("place").alias("step"), F.when((same > 1) & (F.col("parent") >= 0), F.concat(part, F.lit(":nth-child("), (F.col("sibling") + 1).cast("string"), F.lit(")"))).otherwise(part).alias("part"))
    chains = rows.join(found.select("page_id", "place", "path"), ["page_id", "place"]).select("page_id", "place", F.explode(F.concat("path", F.array("place"))).alias("step"))
    listed = chains.join(parts, ["page_id", "step"]).groupBy("page_id", "place").agg(F.array_sort(F.collect_list(F.struct("step", "part"))).alias("all"))
    return dom.shuffled(listed.select("page_id", "place", F.array_join(F.transform("all", lambda e: e["part"]), " > ").alias("css_path")))


def page_types(pages: DataFrame, found: DataFrame, classed: DataFrame) -> DataFrame:
    """pages: page_id, url. page_id and kind of each page, by its address, else its containers, else its title."""
    strong = classed.where("kind = 'CONTENT_RESULTS' AND content_score > 0.7").select("page_id").distinct().withColumn("listing", F.lit(True))
    titles = found.where("tag = 'title'").groupBy("page_id").agg(F.min_by(F.lower("text"), "place").alias("title"))
    u = F.coalesce("url", F.lit(""))
    kind = (
        F.when(holds_any(u, ("/search", "?q=", "?query=")), "SEARCH_RESULTS").when(holds_any(u, ("/watch", "/video/", "/play")), "VIDEO_PLAYER").when(holds_any(u, ("/genre/", "/category/", "/browse")), "CATEGORY_LISTING")
        .when(F.col("listing"), "CONTENT_LISTING").when(F.col("title").contains("home") | u.endswith("/") | u.rlike("^https?://[^/]+/?$"), "HOME_PAGE").otherwise("UNKNOWN")
    )
    return pages.join(strong, "page_id", "left").join(titles, "page_id", "left").select("page_id", kind.alias("kind"))


def main_container(classed: DataFrame) -> DataFrame:
    """The content container of most confidence of each page, the first among equals: page_id, place, last."""
    best = classed.where("kind = 'CONTENT_RESULTS'").groupBy("page_id").agg(F.min_by(F.struct("place", "last"), F.struct((-F.col("confidence")).alias("c"), "rank", "place")).alias("m"))
    return best.select("page_id", "m.place", "m.last")


def content_type(text: Column) -> Column:
    """What lower-cased text and address together tell an item to be."""
    return (
        F.when(text.contains("episode") | text.rlike(r"s\d+e\d+"), "EPISODE").when(holds_any(text, ("season", "series")), "SERIES").when(holds_any(text, ("movie", "film")), "MOVIE")
        .when(text.contains("trailer"), "TRAILER").otherwise("VIDEO")
    )


def _read_items(found: DataFrame, items: DataFrame) -> DataFrame:
    """items: page_id, place, rank. page_id, rank, place and the fields of each that has a link and a title of two characters."""
    link, image = F.col("tag") == "a", F.col("tag") == "img"
    length, rated = _class_like("duration", "time") | dom.has_class("length"), _class_like("rating", "imdb") | dom.has_class("score")
    useful = found.where(link | image | _is_title() | length | rated)
    inner = useful.withColumn("item", F.explode(F.concat("path", F.array("place")))).withColumns({"is_title": _is_title(), "is_length": length, "is_rated": rated})
    first = lambda value, condition: F.min_by(value, F.when(condition, F.col("inner_place")))
    inner = inner.select("page_id", "item", F.col("place").alias("inner_place"), "tag", "text", "attrs", "is_title", "is_length", "is_rated")
    fields = inner.join(items.select("page_id", F.col("place").alias("item")).distinct(), ["page_id", "item"]).groupBy("page_id", "item").agg(
        F.max_by(F.struct("text", dom.attr("href").alias("href")), F.when(link, F.struct(F.length("text"), (-F.col("inner_place")).alias("p")))).alias("a"), first(F.col("text"), F.col("is_title")).alias("title"),
        first(F.struct(dom.attr("src").alias("src"), dom.attr("data-src").alias("data")), image).alias("img"), first(F.col("text"), F.col("is_length")).alias("duration"), first(F.col("text"), F.col("is_rated")).alias("rated"))
    rows = items.join(dom.shuffled(fields.withColumnRenamed("item", "place")), ["page_id", "place"]).join(found.select("page_id", "place", F.col("text").alias("whole")), ["page_id", "place"])
    quality = F.lit(None).cast("string")
    for q in reversed(QUALITIES):
        quality = F.when(F.lower("whole").contains(q.lower()), q).otherwise(quality)
    found_in = lambda text, pattern: F.nullif(F.regexp_extract(text, pattern, 0), F.lit(""))
    thumbnail = F.when(F.col("img").isNotNull(), F.coalesce(F.nullif(F.col("img.src"), F.lit("")), F.col("img.data"), F.lit("")))
    made = rows.select(
        "page_id", "rank", "place", F.trim(F.coalesce("title", "a.text")).alias("title"), F.col("a.href").alias("url"), thumbnail.alias("thumbnail"), "duration", quality.alias("quality"),
        found_in("whole", r"\b(19|20)\d{2}\b").alias("year"), found_in("rated", r"\d+\.?\d*").alias("rating"), content_type(F.lower(F.concat_ws(" ", "whole", "a.href"))).alias("type"),
    )
    return made.where("url <> '' AND length(title) >= 2")


def result_items(found: DataFrame, classed: DataFrame) -> DataFrame:
    """The items of each page's main container: those of the first item selector with three matches in it and any readable
    one, else its children that hold a link and an image. page_id, place, title, url, thumbnail, duration, quality, year, rating, type."""
    main = main_container(classed).select("page_id", F.col("place").alias("holder"), F.col("last").alias("holder_last"))
    table = found.sparkSession.createDataFrame(list(enumerate(ITEMS)), "selector_id long, selector string")
    marked = selectors.match(found, dom.write_table(selectors.compile_selectors(table), "steps")).join(main, "page_id").where("place BETWEEN holder AND holder_last")
    enough = F.count("*").over(Window.partitionBy("page_id", "selector_id")) >= 3
    listed = marked.withColumn("enough", enough).where("enough").select("page_id", "place", F.col("selector_id").alias("rank"))
    children = found.join(main, "page_id").where("parent = holder").select("page_id", "place", "last")
    whole = subtree_sums(found, children, {"n_links": F.col("tag") == "a", "n_images": F.col("tag") == "img"}).where("n_links > 0 AND n_images > 0")
    rows = dom.write_table(_read_items(found, listed.unionByName(whole.select("page_id", "place", F.lit(len(ITEMS)).cast("long").alias("rank")))), "result-items")
    best = rows.groupBy("page_id").agg(F.min("rank").alias("rank"))
    return rows.join(best, ["page_id", "rank"]).drop("rank")


def category_items(found: DataFrame, classed: DataFrame) -> DataFrame:
    """The links of category containers with a text of less than 50 characters: page_id, text, url, count (a number in brackets); the first of each text."""
    held = classed.where("kind = 'CATEGORY_NAVIGATION'").select("page_id", F.col("place").alias("holder"), "rank")
    links = found.where("tag = 'a'").withColumn("holder", F.explode(F.concat("path", F.array("place")))).join(held, ["page_id", "holder"])
    rows = links.where((F.col("text") != "") & (dom.attr("href") != "") & (F.length("text") < 50))
    first = rows.groupBy("page_id", "text").agg(F.min_by(dom.attr("href"), F.struct("rank", "holder", "place")).alias("url"))
    return first.select("page_id", "text", "url", F.regexp_extract("text", r"\((\d+)\)", 1).try_cast("int").alias("count"))
