"""Pages as tables of elements, and what is drawn from them: structure, content areas, items, forms, links, media.

elements() gives one row for each element in document order; place and last bound its subtree, so an element lies within
another if its place is between them; path lists the places of all it lies in, outermost first, sibling its number among
the children of its parent, and size the characters of source within it. A page is parsed whole in one task; pages
meet nothing but themselves. stored() writes the table, so that several steps read it and parse nothing again."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveworks.functions.scores import resolve_url
from sieveworks.sources.store import shuffled, write_table

# Fixed values.
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
AREAS = (("main", None, None), (None, "main", None), (None, None, "main"), (None, "content", None), (None, None, "content"), ("article", None, None), (None, None, "articles"), (None, "articles", None), (None, None, "container"))
BLOCKS = frozenset((
    "address", "article", "aside", "blockquote", "body", "br", "dd", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "tbody", "td",
    "th", "thead", "title", "tr", "ul", "video",
))
#: Of the elements whose end may be left out: what a start tag ends, and what it does not look beyond.
ENDS = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "body": ({"head"}, set()),
}
ENDS_PARAGRAPH = frozenset((
    "address", "article", "aside", "blockquote", "dd", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4",
    "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "ul",
))
KEEPS_PARAGRAPH = frozenset(("button", "caption", "object", "table", "td", "th", "html"))
SEARCH_NAMES = ("q", "query", "search", "s", "keyword", "keywords", "term", "text", "search_query", "kw", "wd", "k")
IMAGE_ATTRIBUTES = ("src", "data-src", "data-lazy-src", "data-original", "data-lazy", "data-thumb", "data-thumbnail", "data-poster", "data-image", "poster")
VIDEO_ATTRIBUTES = ("src", "data-src", "data-url", "data-video", "data-hls", "data-file")
MEDIA_DATA = ("data-src", "data-url", "data-video", "data-stream", "data-file", "data-hls", "data-dash", "data-mp4", "data-video-url", "data-stream-url", "data-source", "data-media", "data-content", "data-embed")
MEDIA_META = ("og:video", "og:video:url", "og:video:secure_url", "twitter:player:stream")
SCHEMA_TYPES = ("Movie", "TVSeries", "TVEpisode", "VideoObject", "MediaObject", "Article", "SearchResultsPage", "ItemList", "WebPage")
#: Rows of elements that leave a Python worker together, at least.
LEAST_ROWS = 1000
SCHEMA = "page_id long, place int, parent int, last int, depth int, tag string, id string, classes array<string>, attrs map<string,string>, text string, sibling int, path array<int>, size int"


class _Tree(HTMLParser):
    """Rows of one page: [place, parent, last, depth, tag, attrs, texts, sibling, first and last offset of what is within]."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.open: list[int] = []
        self.children: dict[int, int] = {}
        self.lines = [0, *(m.end() for m in re.finditer("\n", html))]
        self.length = len(html)
        self.feed(html)

    def _offset(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def _leave(self, depth: int) -> None:
        """Ends all open elements from this depth on."""
        for place in self.open[depth:]:
            self.rows[place][2], self.rows[place][9] = len(self.rows) - 1, self._offset()
        del self.open[depth:]

    def _end_implied(self, names, stops) -> None:
        depth = None
        for i in range(len(self.open) - 1, -1, -1):
            tag = self.rows[self.open[i]][4]
            if tag in names:
                depth = i
            elif tag in stops:
                break
        if depth is not None:
            self._leave(depth)

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_PARAGRAPH:
            self._end_implied({"p"}, KEEPS_PARAGRAPH)
        if tag in ENDS:
            self._end_implied(*ENDS[tag])
        self._parted(tag)
        place, parent = len(self.rows), self.open[-1] if self.open else -1
        sibling = self.children[parent] = self.children.get(parent, -1) + 1
        begin = self._offset() + len(self.get_starttag_text() or "")
        self.rows.append([place, parent, place, len(self.open), tag, {k: v or "" for k, v in reversed(attrs)}, [], sibling, begin, begin])
        if tag not in VOID:
            self.open.append(place)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if self.open and self.open[-1] == len(self.rows) - 1:
            self.open.pop()

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.rows[self.open[i]][4] == tag:
                self._leave(i)
                self._parted(tag)
                return

    def _parted(self, tag: str) -> None:
        """Blocks part the words before and after them."""
        if tag in BLOCKS and self.open and self.rows[self.open[-1]][4] not in ("script", "style"):
            self.handle_data(" ")

    def handle_data(self, data):
        if self.open:
            self.rows[self.open[-1]][6].append((len(self.rows) - 1, data))

    def done(self) -> list[tuple]:
        self.close()
        for place in self.open:
            self.rows[place][2], self.rows[place][9] = len(self.rows) - 1, self.length
        pieces = sorted((at, n, place, text) for place, row in enumerate(self.rows) for n, (at, text) in enumerate(row[6]))
        own: list[list[str]] = [[] for _ in self.rows]
        for _, _, place, text in pieces:
            # Scripts and styles keep their source; other elements have the text of all that lies in them.
            kept = self.rows[place][4] in ("script", "style")
            up = place
            while up >= 0:
                if up == place or not kept:
                    own[up].append(text)
                up = self.rows[up][1]
        out, paths = [], {-1: []}
        for (place, parent, last, depth, tag, attrs, _, sibling, begin, end), texts in zip(self.rows, own, strict=True):
            paths[place] = [*paths[parent], place]
            joined = "".join(texts)
            text = joined if tag in ("script", "style") else " ".join(joined.split())
            out.append((place, parent, last, depth, tag, attrs.get("id"), list(dict.fromkeys(attrs.get("class", "").split())), list(attrs.items()), text, sibling, paths[parent], end - begin))
        return out


def elements(pages: DataFrame) -> DataFrame:
    """pages: page_id, html. A row for each element; null and empty pages give none. A start tag ends the paragraph, list item,
    row or cell that it cannot lie in; what else is not closed ends with what is around it."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.map_(pa.string(), pa.string()), pa.string(), pa.int32(), pa.list_(pa.int32()), pa.int32())
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        for batch in batches:
            rows = []
            for n, (page, html) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True), 1):
                rows += [(page, *r) for r in _Tree(html.as_py() or "").done()]
                # The rows of several small pages go together.
                if rows and (len(rows) >= LEAST_ROWS or n == batch.num_rows):
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows = []

    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(parse, SCHEMA)


def open_references_kept(html: Column) -> Column:
    """A source in which character references without their semicolon stand for themselves, where parsers would read some."""
    return F.regexp_replace(html, r"&(?=(?:[A-Za-z][A-Za-z0-9]*|#[0-9]+|#[xX][0-9A-Fa-f]+)(?![A-Za-z0-9;]))", "&amp;")


def stored(pages: DataFrame) -> DataFrame:
    """The element table of pages, written once to the shared folder."""
    return write_table(elements(pages), "elements")


def has_class(name: str) -> Column:
    return F.array_contains("classes", name)


def class_like(part: str) -> Column:
    return F.coalesce(F.col("attrs")["class"].contains(part), F.lit(False))


def attr(name: str) -> Column:
    return F.col("attrs")[name]


def first_attr(*names: str) -> Column:
    """The first of the attributes that is there and not blank."""
    return F.coalesce(*[F.when(F.trim(attr(n)) != "", F.trim(attr(n))) for n in names])


def structure(found: DataFrame) -> DataFrame:
    """Counts of elements, kinds, depth, forms, links, scripts, frames, images and videos by page."""
    count = lambda tag: F.count_if(F.col("tag") == tag).alias(f"n_{tag}")
    return found.groupBy("page_id").agg(F.count("*").alias("n_elements"), F.count_distinct("tag").alias("n_tags"), F.max("depth").alias("depth"), *map(count, ("form", "a", "script", "iframe", "img", "video")))


def within(found: DataFrame, inner: DataFrame, outer: DataFrame) -> DataFrame:
    """Pairs of inner elements and the outer ones they lie in; outer: page_id, item, item_last."""
    return inner.join(outer, "page_id").where((F.col("place") > F.col("item")) & (F.col("place") <= F.col("item_last")))


def _first(rows: DataFrame, keys: list[str], value: Column, order: Column | None = None) -> DataFrame:
    """The value of the first row of each key, by order and place."""
    return rows.groupBy(*keys).agg(F.min_by(value, F.struct(order if order is not None else F.lit(0), F.col("place"))).alias("value"))


def content_areas(found: DataFrame) -> DataFrame:
    """The first element of each usual main area: number of the rule, tag, children, length of text, confidence; best first by rank."""
    rules = F.lit(None).cast("int")
    conditions = []
    for tag, ident, name in AREAS:
        conditions.append(F.col("tag") == tag if tag else F.coalesce(F.col("id") == ident, F.lit(False)) if ident else has_class(name))
    marked = found.withColumn("rule", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(i)).otherwise(rules) for i, c in enumerate(conditions)]))))
    first = marked.groupBy("page_id", "rule").agg(F.min(F.struct("place", "last", "tag", F.length("text").alias("n_text"))).alias("e")).select("page_id", "rule", F.col("e.place").alias("item"), F.col("e.last").alias("item_last"), "e.tag", "e.n_text")
    inner = found.select("page_id", "place", "parent", F.col("tag").alias("inner_tag"), (F.col("tag").isin("article") | has_class("item") | has_class("card")).alias("is_item"))
    inside = within(found, inner, first).groupBy("page_id", "rule").agg(
        F.count_if(F.col("parent") == F.col("item")).alias("n_children"), F.max(F.col("inner_tag") == "a").alias("has_link"), F.max(F.col("inner_tag") == "img").alias("has_image"), F.max("is_item").alias("has_item"))
    rows = first.join(inside, ["page_id", "rule"], "left")
    points = F.when(F.col("n_text") > 500, 0.3).otherwise(0.0) + F.when(F.col("n_text") > 2000, 0.2).otherwise(0.0)
    for flag, n in (("has_link", 0.2), ("has_image", 0.15), ("has_item", 0.15)):
        points = points + F.when(F.col(flag), n).otherwise(0.0)
    scored = rows.withColumn("confidence", F.least(points, F.lit(1.0)))
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("confidence"), "rule"))
    return scored.select("page_id", "rule", "tag", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_text", "confidence", rank.alias("rank"))


def image_of(base: Column) -> Column:
    """The image an element names: an attribute that is no inline data, the first of a source set, or its background."""
    names = [F.when((F.trim(attr(n)) != "") & ~F.lower(attr(n)).startswith("data:"), attr(n)) for n in IMAGE_ATTRIBUTES]
    sources = F.filter(F.transform(F.split(first_attr("srcset", "data-srcset"), ","), lambda s: F.split(F.trim(s), r"\s+")[0]), lambda s: (s != "") & ~F.lower(s).startswith("data:"))
    back = F.regexp_extract(F.coalesce(attr("style"), F.lit("")), r"(?i)background(?:-image)?\s*:\s*url\(['\"]?([^'\")]+)['\"]?\)", 1)
    return resolve_url(F.coalesce(*names, F.get(sources, F.lit(0)), F.when(back != "", back)), base)


def is_image() -> Column:
    styled = F.coalesce(attr("style").contains("background-image"), F.lit(False))
    named = F.coalesce(*[attr(n) for n in ("data-thumb", "data-thumbnail", "data-poster", "data-image")]).isNotNull()
    return F.col("tag").isin("img", "source", "video") | named | styled


def items(found: DataFrame, selector: Column, base: Column) -> DataFrame:
    """The elements of a selector as result rows: page_id, item, title, url, description, thumbnail, duration, quality, year,
    rating. Items without a title of two characters or a link, or with a script link, are left out."""
    outer = found.where(selector).select("page_id", F.col("place").alias("item"), F.col("last").alias("item_last"), F.col("text").alias("item_text"))
    inner = within(found, found, outer.drop("item_text"))
    heads = F.col("tag").isin("h1", "h2", "h3", "h4") | class_like("title") | has_class("name") | ((F.col("tag") == "a") & attr("title").isNotNull())
    keys = ["page_id", "item"]
    text = F.trim("text")
    parts = {
        "title": _first(inner.where(heads), keys, text),
        "longest": inner.where(F.col("tag") == "a").groupBy(*keys).agg(F.max_by(text, F.struct(F.length("text"), (-F.col("place")).alias("p"))).alias("value")),
        "href": _first(inner.where((F.col("tag") == "a") & (F.trim(attr("href")) != "")), keys, attr("href")),
        "description": _first(inner.where((F.col("tag") == "p") | has_class("description") | has_class("desc") | has_class("synopsis")), keys, F.substring("text", 1, 200)),
        "thumbnail": _first(inner.where(is_image()), keys, image_of(base)),
        "length": _first(inner.where(class_like("duration") | class_like("time") | has_class("length") | has_class("runtime")), keys, text),
        "tagged": _first(inner.where(class_like("quality") | has_class("resolution") | has_class("badge")), keys, text),
        "rated": _first(inner.where(class_like("rating") | class_like("imdb") | has_class("score") | has_class("stars")), keys, text),
    }
    rows = outer.select(*keys, "item_text")
    for name, part in parts.items():
        rows = rows.join(part.withColumnRenamed("value", name), keys, "left")
    named = lambda pattern, at=1: F.nullif(F.regexp_extract("item_text", pattern, at), F.lit(""))
    rows = rows.select(
        *keys, F.coalesce(F.nullif(F.col("title"), F.lit("")), "longest").alias("title"), resolve_url(F.col("href"), base).alias("url"), "description", "thumbnail",
        F.coalesce("length", named(r"(\d{1,2}:\d{2}(?::\d{2})?)")).alias("duration"), F.coalesce("tagged", named(r"(?i)(4K|2160p|1080p|720p|480p|HD)")).alias("quality"),
        named(r"\b((?:19|20)\d{2})\b").alias("year"), F.nullif(F.regexp_extract(F.coalesce("rated", F.lit("")), r"(\d\.\d|\d{1,2})", 1), F.lit("")).alias("rating"),
    )
    return rows.where((F.length("title") >= 2) & F.col("url").isNotNull() & ~F.lower("url").contains("javascript:"))


def search_forms(found: DataFrame, base: Column, query: Column) -> DataFrame:
    """The search form of each page and the URL it makes of a query: page_id, action, name, url."""
    forms = found.where("tag = 'form'").select("page_id", F.col("place").alias("item"), F.col("last").alias("item_last"), F.coalesce(attr("action"), F.lit("")).alias("action"), "id", "classes", F.coalesce(attr("role"), F.lit("")).alias("role"))
    inputs = within(found, found.where("tag = 'input'").select("page_id", "place", attr("name").alias("name"), attr("type").alias("type")), forms.select("page_id", "item", "item_last"))
    names = inputs.groupBy("page_id", "item").agg(F.collect_set("name").alias("names"), F.max(F.coalesce(F.col("type") == "search", F.lit(False))).alias("typed"))
    rows = forms.join(names, ["page_id", "item"], "left").withColumns({"names": F.coalesce("names", F.array().cast("array<string>")), "typed": F.coalesce("typed", F.lit(False))})
    c = F.col
    named = lambda n: F.array_contains("names", n)
    rules = [c("action").contains("search"), c("role") == "search", c("id") == "search", F.array_contains("classes", "search"), c("id") == "searchForm", F.array_contains("classes", "search-form"), c("typed"), named("q"), named("query"), named("search"), named("s")]
    rule = F.array_min(F.array_compact(F.array(*[F.when(F.coalesce(r, F.lit(False)), i) for i, r in enumerate(rules)])))
    best = rows.withColumn("rule", rule).where("rule IS NOT NULL")
    best = best.groupBy("page_id").agg(F.min_by(F.struct("action", "names"), F.struct("rule", "item")).alias("f")).select("page_id", "f.action", "f.names")
    name = F.lit("q")
    for n in reversed(SEARCH_NAMES):
        name = F.when(named(n), n).otherwise(name)
    root = F.regexp_replace(base, "/+$", "")
    target = F.when(c("action").startswith("http"), c("action")).when(c("action").startswith("/"), F.concat(root, "action")).when(c("action") == "", base).otherwise(F.concat(root, F.lit("/"), "action"))
    made = best.select("page_id", "action", name.alias("name"), target.alias("target"))
    return made.select("page_id", "action", "name", F.concat("target", F.when(c("target").contains("?"), "&").otherwise("?"), "name", F.lit("="), F.url_encode(query)).alias("url"))


def menu_links(found: DataFrame) -> DataFrame:
    """page_id, place, text and url of the links in each page's first menu."""
    menus = found.where((F.col("tag") == "nav") | has_class("navigation") | has_class("menu") | F.col("id").isin("nav", "menu"))
    first = menus.groupBy("page_id").agg(F.min(F.struct("place", "last")).alias("m")).select("page_id", F.col("m.place").alias("item"), F.col("m.last").alias("item_last"))
    return within(found, found.where("tag = 'a'"), first).select("page_id", "place", "text", F.coalesce(attr("href"), F.lit("")).alias("url"))


def page_links(found: DataFrame, base: Column, most: int = 5) -> DataFrame:
    """page_id, rank and url of links to further pages, in document order, each once."""
    paged = found.where(class_like("pagination") | has_class("pager") | has_class("pages") | has_class("page-numbers") | has_class("next-page") | class_like("next")).select("page_id", F.col("place").alias("item"), F.col("last").alias("item_last"))
    links = found.where("tag = 'a'").select("page_id", "place", "text", "classes", "attrs")
    inside = within(found, links, paged).select(links.columns)
    alone = links.where(has_class("page-link") | has_class("next") | F.coalesce(attr("rel") == "next", F.lit(False)) | F.lower("text").contains("next") | F.col("text").contains(">") | F.coalesce(attr("aria-label") == "Next", F.lit(False)))
    hrefs = inside.unionByName(alone).where((attr("href") != "") & ~attr("href").startswith("#")).select("page_id", "place", resolve_url(attr("href"), base).alias("url"))
    once = hrefs.groupBy("page_id", "url").agg(F.min("place").alias("place"))
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy("place"))
    return once.withColumn("rank", rank).where(F.col("rank") <= most).select("page_id", "rank", "url")


def linked_data(found: DataFrame) -> DataFrame:
    """Items of application/ld+json scripts of known types that have a title and a URL: page_id, type, title, url, description, image, year."""
    scripts = found.where((F.col("tag") == "script") & (attr("type") == "application/ld+json"))
    text = F.trim("text")
    listed = F.when(text.startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]")))
    fields = ("@type", "name", "headline", "title", "url", "@id", "description", "abstract", "image", "thumbnailUrl", "datePublished", "dateCreated")
    schema = "array<struct<" + ",".join(f"`{f}`:string" for f in fields) + ">>"
    each = scripts.select("page_id", "place", F.posexplode(F.from_json(listed, schema)).alias("n", "j"))
    first = lambda *names: F.coalesce(*[F.col("j")[n] for n in names])
    rows = each.select("page_id", "place", "n", first("@type").alias("type"), first("name", "headline", "title").alias("title"), first("url", "@id").alias("url"), first("description", "abstract").alias("description"), first("image", "thumbnailUrl").alias("image"), F.substring(first("datePublished", "dateCreated"), 1, 4).alias("year"))
    return rows.where(F.col("type").isin(*SCHEMA_TYPES) & F.col("title").isNotNull() & F.col("url").isNotNull())


def embedded_items(found: DataFrame) -> DataFrame:
    """Items of arrays that scripts assign to names like videos or results: page_id, title, url, thumbnail."""
    patterns = [r'(?s)(?:var|const)\s+(?:videos?|movies?|items?|results?|data)\s*=\s*(\[\{.+?\}\]);', r'(?s)"(?:videos?|movies?|items?|results?)"\s*:\s*(\[\{.+?\}\])']
    arrays = F.concat(*[F.regexp_extract_all("text", F.lit(p), F.lit(1)) for p in patterns])
    each = found.where("tag = 'script'").select("page_id", "place", F.explode(arrays).alias("a"))
    each = each.select("page_id", "place", F.posexplode(F.from_json("a", "array<map<string,string>>")).alias("n", "j"))
    first = lambda *names: F.coalesce(*[F.col("j")[n] for n in names])
    rows = each.select("page_id", "place", "n", first("title", "name", "headline").alias("title"), first("url", "link", "href").alias("url"), first("thumbnail", "thumb", "image", "poster").alias("thumbnail"))
    return rows.where("title IS NOT NULL AND url IS NOT NULL")


def data_items(found: DataFrame) -> DataFrame:
    """Elements whose data attributes name a title and a URL: page_id, place, title, url, thumbnail, duration, year, rating, quality."""
    marked = found.where(F.coalesce(*[attr(f"data-{n}") for n in ("title", "name", "video", "movie", "id")]).isNotNull())
    data = lambda *names: F.coalesce(*[attr(f"data-{n}") for n in names])
    rows = marked.select("page_id", "place", data("title", "name", "video-title").alias("title"), F.coalesce(F.nullif(attr("href"), F.lit("")), data("url", "link")).alias("url"), data("poster", "thumb", "image").alias("thumbnail"), data("duration", "length").alias("duration"), data("year", "release").alias("year"), data("rating", "score").alias("rating"), data("quality").alias("quality"))
    return rows.where("title <> '' AND url <> ''")


def feed_items(feeds: DataFrame) -> DataFrame:
    """feeds: page_id, xml. Items and entries with a title and a link (its text, else its href): place, title, url, description, year."""
    blocks = F.regexp_extract_all("xml", F.lit(r"(?is)<(?:item|entry)[\s>].*?</(?:item|entry)>"), F.lit(0))
    each = feeds.select("page_id", F.posexplode(blocks).alias("place", "b"))
    inner = lambda names: F.trim(F.regexp_replace(F.regexp_extract("b", rf"(?is)<(?:{names})[^>]*>(.*?)</(?:{names})>", 1), r"<!\[CDATA\[|\]\]>|<[^>]+>", ""))
    href = F.regexp_extract("b", r"(?is)<link[^>]*\shref=[\"']([^\"']*)[\"']", 1)
    rows = each.select("page_id", "place", inner("title").alias("title"), F.coalesce(F.nullif(inner("link"), F.lit("")), href).alias("url"), inner("description|summary|content").alias("description"), F.substring(inner("pubDate|published|updated"), 1, 4).alias("year"))
    return rows.where("title <> '' AND url <> ''")


def media_candidates(found: DataFrame, base: Column) -> DataFrame:
    """page_id, place, method and url of media that video and source tags, data attributes, metas and linked data name."""
    rows = []
    tagged = found.where("tag = 'video'").select("page_id", "place", F.explode(F.array(*[attr(a) for a in VIDEO_ATTRIBUTES])).alias("raw"))
    rows.append(tagged.where("trim(raw) <> ''").select("page_id", "place", F.lit("video_tag").alias("method"), resolve_url(F.trim("raw"), base).alias("url")))
    source = found.where("tag = 'source'").select("page_id", "place", first_attr("src", "data-src").alias("raw"))
    rows.append(source.where("raw IS NOT NULL").select("page_id", "place", F.lit("source_tag").alias("method"), resolve_url(F.col("raw"), base).alias("url")))
    data = found.select("page_id", "place", F.explode(F.array(*[F.trim(attr(a)) for a in MEDIA_DATA])).alias("url")).where("url LIKE 'http%'")
    rows.append(data.select("page_id", "place", F.lit("data_attr").alias("method"), "url"))
    meta = found.where((F.col("tag") == "meta") & F.coalesce(attr("property"), attr("name")).isin(*MEDIA_META)).select("page_id", "place", F.lit("meta_tag").alias("method"), F.trim(attr("content")).alias("url"))
    rows.append(meta.where("url LIKE 'http%'"))
    ld = found.where((F.col("tag") == "script") & (attr("type") == "application/ld+json"))
    urls = F.regexp_extract_all("text", F.lit(r'"(?:contentUrl|embedUrl|url|contentURL)"\s*:\s*"([^"]+)"'), F.lit(1))
    rows.append(ld.select("page_id", "place", F.lit("json_ld").alias("method"), F.explode(urls).alias("url")).where("url LIKE 'http%'"))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def decoded_urls(html: Column) -> Column:
    """URLs that a source hides: base64 in atob(), percent codes, unicode escapes, quoted strings written backwards."""
    coded = F.regexp_extract_all(html, F.lit(r"atob\s*\(\s*['\"]([A-Za-z0-9+/=]{20,})['\"]"), F.lit(1))
    plain = F.transform(coded, lambda c: F.try_to_binary(c, F.lit("base64")).cast("string"))
    plain = F.transform(plain, lambda p: F.when(p.startswith("http"), p).otherwise(F.nullif(F.regexp_extract(p, r"(https?://[^\s'\"<>]{10,})", 1), F.lit(""))))
    percent = F.transform(F.regexp_extract_all(html, F.lit(r"(?:unescape|decodeURIComponent)\s*\(\s*['\"](%[0-9A-Fa-f]{2}(?:%[0-9A-Fa-f]{2})+)['\"]"), F.lit(1)), F.try_url_decode)
    units = lambda m: F.transform(F.regexp_extract_all(m, F.lit(r"\\u([0-9a-fA-F]{4})"), F.lit(1)), lambda h: F.decode(F.unhex(h), "UTF-16BE"))
    escaped = F.transform(F.regexp_extract_all(html, F.lit(r"((?:\\u[0-9a-fA-F]{4}){5,})"), F.lit(1)), lambda m: F.array_join(units(m), ""))
    backwards = F.filter(F.transform(F.regexp_extract_all(html, F.lit(r"['\"]([a-zA-Z0-9+/=]{30,})['\"]"), F.lit(1)), F.reverse), lambda r: r.contains(".mp4") | r.contains(".m3u8"))
    return F.filter(F.concat(plain, percent, escaped, backwards), lambda u: F.coalesce(u.startswith("http"), F.lit(False)))
