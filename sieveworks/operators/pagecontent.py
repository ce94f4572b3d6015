"""Everything a page says of items, by all methods together: state of frameworks, linked data, arrays in scripts, data attributes,
item elements, feeds; the first of each address and title counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveworks.sources import dom, selectors, sitemarks, state

# Selectors of item elements, in order; the first that matches two counts.
ITEMS = (
    ".video-item, .movie-item, .video-card, .movie-card", ".result-item, .search-result, .item", "article.video, article.movie, article.item", ".post, .entry, .card",
    ".grid-item, .list-item, .col-item", "table.results tr, table.torrents tr", "tbody tr[data-id], tbody tr.result",
)
#: Formats whose pages carry state, and the confidence of each method.
STATEFUL = {"NEXTJS": "NextJS", "NUXTJS": "NuxtJS", "SPA_REACT": "SPA", "SPA_VUE": "SPA", "SPA_ANGULAR": "SPA"}
STATE, LINKED, EMBEDDED, DATA, ELEMENT, FEED = 0.85, 0.9, 0.85, 0.75, 0.65, 0.8
MOST_TITLE = 50


def item_elements(found: DataFrame, base: Column) -> DataFrame:
    """page_id, place and the fields of the item elements of a page: those of the first selector that matches two and of which any can be read."""
    table = found.sparkSession.createDataFrame(list(enumerate(ITEMS)), "selector_id long, selector string")
    marked = selectors.match(found, dom.write_table(selectors.compile_selectors(table), "steps"))
    twice = F.count("*").over(Window.partitionBy("page_id", "selector_id")) > 1
    marked = dom.write_table(marked.withColumn("twice", twice).where("twice").select("page_id", "place", "selector_id"), "item-marks")
    flagged = found.join(marked.select("page_id", "place", F.lit(True).alias("is_item")).distinct(), ["page_id", "place"], "left")
    rows = dom.items(flagged, F.coalesce("is_item", F.lit(False)), base).withColumnRenamed("item", "place").join(marked, ["page_id", "place"])
    rows = dom.write_table(rows, "item-elements")
    return rows.join(rows.groupBy("page_id").agg(F.min("selector_id").alias("selector_id")), ["page_id", "selector_id"]).drop("selector_id")


def page_content(pages: DataFrame, base: Column) -> DataFrame:
    """pages: page_id, url, html. page_id, rank, source, title, url, description, thumbnail and confidence of what each page holds,
    surest first, then in the order of methods and places. Of items with one address and one title, by its first 50 letters
    without case, the first method's stays. Null and empty pages hold nothing."""
    found = dom.stored(pages.select("page_id", "html"))
    # The format of a page takes many patterns over its source: told once, and only feeds keep their source.
    kinds = pages.select("page_id", "html", sitemarks.data_format(F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))).alias("format"))
    kinds = dom.write_table(kinds.select("page_id", "format", F.when(F.col("format").isin("RSS", "XML"), F.col("html")).alias("xml")), "page-formats")
    nothing = F.lit(None).cast("string")

    def rows(frame: DataFrame, method: int, source: Column, confidence: float, place: Column, description: Column = nothing, thumbnail: Column = nothing) -> DataFrame:
        return frame.select("page_id", F.lit(method).alias("method"), place.alias("place"), source.alias("source"), "title", "url", description.alias("description"), thumbnail.alias("thumbnail"), F.lit(confidence).alias("confidence"))

    c = F.col
    wanted = F.coalesce(*[F.when(c("format") == f, s) for f, s in STATEFUL.items()])
    states = state.state_items(found).join(kinds.select("page_id", "format"), "page_id").where(c("source") == wanted)
    order = lambda *of: F.struct(*of)
    place = lambda place, n=F.lit(0), path=F.lit(""): order(place.cast("int").alias("place"), n.cast("int").alias("n"), path.alias("path"))
    embedded = dom.embedded_items(found).withColumn("url", F.when(c("url").startswith("http"), c("url")).otherwise(F.concat(F.lit("/"), "url")))
    feeds = dom.feed_items(kinds.where("xml IS NOT NULL").select("page_id", "xml"))
    parts = [
        rows(states, 0, c("source"), STATE, place(c("place"), path=c("path")), c("description"), c("thumbnail")),
        rows(dom.linked_data(found), 1, F.concat(F.lit("JSON-LD:"), c("type")), LINKED, place(c("place"), c("n")), c("description"), c("image")),
        rows(embedded, 2, F.lit("EmbeddedJSON"), EMBEDDED, place(c("place"), c("n")), thumbnail=c("thumbnail")),
        rows(dom.data_items(found), 3, F.lit("DataAttributes"), DATA, place(c("place")), thumbnail=c("thumbnail")),
        rows(item_elements(found, base), 4, F.lit("HTML"), ELEMENT, place(c("place")), c("description"), c("thumbnail")),
        rows(feeds, 5, F.lit("RSS/XML"), FEED, place(c("place")), c("description")),
    ]
    listed = reduce(DataFrame.unionByName, parts).withColumn("key", F.concat_ws("|", "url", F.substring(F.lower("title"), 1, MOST_TITLE)))
    values = F.struct("method", "place", "source", "title", "url", "description", "thumbnail", "confidence")
    first = listed.groupBy("page_id", "key").agg(F.min_by(values, F.struct("method", "place")).alias("r")).select("page_id", "r.*")
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("confidence"), "method", "place"))
    return first.select("page_id", rank.alias("rank"), "source", "title", "url", "description", "thumbnail", "confidence")


def content_confidence(content: DataFrame) -> DataFrame:
    """page_id, n_items, confidence (the mean) and methods (in order of first rank) of each page's content."""
    methods = F.array_distinct(F.transform(F.array_sort(F.collect_set(F.struct("rank", "source"))), lambda r: r["source"]))
    return content.groupBy("page_id").agg(F.count("*").alias("n_items"), F.avg("confidence").alias("confidence"), methods.alias("methods"))
