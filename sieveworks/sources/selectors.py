"""Selectors as rows of a table, compiled to steps that are matched against the element table by joins, many at once.

A selector is a list of alternatives, an alternative a chain of steps: a compound of tag, #id, .class, [attribute] tests,
:contains(text) and :nth-child, and how it stands to the step before (within, child, next sibling, later sibling). Each step has an anchor, its rarest
part; elements meet steps on anchors. Chains then run in rounds, a step each: in one window over a page, in document
order, a row looks at what matched the step before it. Within is told by the furthest end of the matches before a place, as
elements are nested; the others by the place of the parent or sibling. Rounds are as many as the longest chain has steps."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveworks.functions.scores import resolve_url
from sieveworks.sources import dom

#: Steps (about 200 bytes each) that are sent to all executors; more are met by a shuffle join.
BROADCAST_STEPS = 50_000
STEPS = "selector_id long, alternative int, step int, steps int, combinator string, following string, anchor string, tag string, id string, classes array<string>, tests array<struct<name:string,op:string,value:string>>, nth int"
_NAME = r"(?:[\w-]|[^\x00-\x7f]|\\.)+"
_PART = re.compile(
    rf"(?P<tag>\*|{_NAME})|#(?P<id>{_NAME})|\.(?P<class>{_NAME})|:nth-child\(\s*(?P<nth>\d+)\s*\)|(?P<first>:first-child)|:contains\((?P<contains>[^)]*)\)"
    rf"|\[\s*(?P<prefix>\^)?(?P<name>{_NAME})\s*(?:(?P<op>[*^$!~]?=)\s*(?:'(?P<single>[^']*)'|\"(?P<double>[^\"]*)\"|(?P<bare>[^\]\s]*))\s*(?:i\s*)?)?\]"
)
_COMMA = re.compile(r"\s*,\s*")
_COMBINATOR = re.compile(r"\s*([>+~])\s*|\s+")


def parse(selector: str) -> list[list[dict]]:
    """The alternatives of a selector as lists of steps; a ValueError where it is not understood."""
    out, chain, at, joint, text = [], [], 0, " ", selector.strip()
    while at < len(text):
        step, begun = {"combinator": joint if chain else " ", "tag": None, "id": None, "classes": [], "tests": [], "nth": None}, at
        while (m := _PART.match(text, at)) and not (m["tag"] and at > begun):
            if m["tag"]:
                step["tag"] = None if m["tag"] == "*" else m["tag"].lower()
            elif m["id"]:
                step["id"] = m["id"]
            elif m["class"]:
                step["classes"].append(m["class"].lower())
            elif m["contains"] is not None:
                step["tests"].append(("", "contains", m["contains"].strip().lower()))
            elif m["nth"] or m["first"]:
                step["nth"] = int(m["nth"] or 1)
            else:
                value = next((m[k] for k in ("single", "double", "bare") if m[k] is not None), "")
                op = "prefix" if m["prefix"] else m["op"] or "has"
                step["tests"].append((m["name"].lower(), op, value if op == "~=" else value.strip().lower()))
            at = m.end()
        if at == begun:
            raise ValueError(f"not a selector: {selector!r}")
        chain.append(step)
        if at == len(text):
            break
        if comma := _COMMA.match(text, at):
            out.append(chain)
            chain, joint, at = [], " ", comma.end()
        elif m := _COMBINATOR.match(text, at):
            joint, at = m[1] or " ", m.end()
        else:
            raise ValueError(f"not a selector: {selector!r}")
        if at == len(text):
            raise ValueError(f"not a selector: {selector!r}")
    return [*out, chain] if chain else out


def compile_selectors(selectors: DataFrame) -> DataFrame:
    """selectors: selector_id, selector. A row for each step; null, empty and misspelt selectors have none and so match nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in STEPS.split(", ")]
        test = pa.struct([("name", pa.string()), ("op", pa.string()), ("value", pa.string())])
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), *[pa.string()] * 5, pa.list_(pa.string()), pa.list_(test), pa.int32())
        for batch in batches:
            rows = []
            for i, selector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    chains = parse(selector or "")
                except ValueError:
                    continue
                for a, chain in enumerate(chains):
                    for n, s in enumerate(chain):
                        anchor = f"#{s['id']}" if s["id"] else f".{s['classes'][0]}" if s["classes"] else s["tag"] or "*"
                        following = chain[n + 1]["combinator"] if n + 1 < len(chain) else None
                        rows.append((i, a, n, len(chain), s["combinator"], following, anchor, s["tag"], s["id"], s["classes"], [dict(zip(("name", "op", "value"), t)) for t in s["tests"]], s["nth"]))
            yield pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    return selectors.select(F.col("selector_id").cast("long"), "selector").mapInArrow(run, STEPS)


def _test(t: Column) -> Column:
    """Whether the element's attributes pass one test; values compare without case."""
    own, value = F.lower(F.trim(F.col("attrs")[t["name"]])), t["value"]
    passed = (
        F.when(t["op"] == "contains", F.lower("text").contains(value))
        .when(t["op"] == "has", own.isNotNull())
        .when(t["op"] == "prefix", F.exists(F.map_keys("attrs"), lambda k: F.startswith(k, t["name"])))
        .when(t["op"] == "!=", ~own.eqNullSafe(value))
        .when(own.isNull(), False)
        .when(t["op"] == "=", own == value)
        .when(t["op"] == "^=", (value != "") & F.startswith(own, value))
        .when(t["op"] == "$=", (value != "") & F.endswith(own, value))
        .when(t["op"] == "*=", (value != "") & F.contains(own, value))
        .when(t["op"] == "~=", F.rlike(F.col("attrs")[t["name"]], value))
    )
    return F.coalesce(passed, F.lit(False))


def _candidates(found: DataFrame, steps: DataFrame, on: list[str]) -> DataFrame:
    """The narrow rows of elements that fit a step by themselves."""
    lower = F.transform("classes", lambda c: F.lower(c))
    anchors = F.array_distinct(F.concat(F.array(F.lit("*"), F.col("tag")), F.transform(lower, lambda c: F.concat(F.lit("."), c)), F.when(F.col("id") != "", F.array(F.concat(F.lit("#"), F.col("id")))).otherwise(F.array().cast("array<string>"))))
    rows = found.select(*on, "page_id", "place", "last", "parent", "sibling", "tag", "id", lower.alias("classes"), "attrs", "text", F.explode(anchors).alias("anchor"))
    wanted = steps.select(*on, "selector_id", "alternative", "step", "steps", "combinator", "following", "anchor", *[F.col(c).alias(f"step_{c}") for c in ("tag", "id", "classes", "tests", "nth")])
    joined = rows.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_STEPS else wanted, [*on, "anchor"])
    c = F.col
    fits = (
        (c("step_tag").isNull() | (c("step_tag") == c("tag"))) & (c("step_id").isNull() | (c("step_id") == c("id"))) & (c("step_nth").isNull() | (c("step_nth") == c("sibling") + 1))
        & (F.size(F.array_except("step_classes", "classes")) == 0) & F.forall("step_tests", _test)
    )
    return joined.where(F.coalesce(fits, F.lit(False))).select("page_id", "selector_id", "alternative", "step", "steps", "combinator", "following", "place", "last", "parent", "sibling")


def match(found: DataFrame, steps: DataFrame, on: list[str] | None = None) -> DataFrame:
    """The elements that selectors match: page_id, selector_id, place, each once. steps is a written table of
    compile_selectors; `on` names columns of both that must be equal, such as the provider of a page and of a selector."""
    rows = dom.write_table(_candidates(found, steps, on or []).repartition("page_id"), "selector-steps")
    longest = steps.agg(F.coalesce(F.max("steps"), F.lit(0))).first()[0]
    keys = ["page_id", "selector_id", "place"]
    alive = rows.where("step = 0")
    out = alive.where("steps = 1").select(*keys)
    c = F.col
    for n in range(1, longest):
        both = alive.where(F.col("steps") > n).withColumn("given", F.lit(True)).unionByName(rows.where(F.col("step") == n).withColumn("given", F.lit(False)))
        # Rows of one step before and of this step meet where this partition's columns are equal.
        both = both.withColumn("joint", F.when(c("given"), c("following")).otherwise(c("combinator")))
        parent = F.when(c("joint") == ">", F.when(c("given"), c("place")).otherwise(c("parent"))).when(c("joint").isin("+", "~"), c("parent"))
        sibling = F.when(c("joint") == "+", F.when(c("given"), c("sibling") + 1).otherwise(c("sibling")))
        both = both.withColumns({"key_parent": parent, "key_sibling": sibling})
        before = Window.partitionBy("page_id", "selector_id", "alternative", "key_parent", "key_sibling").orderBy("place").rangeBetween(Window.unboundedPreceding, -1)
        reach = F.max(F.when(c("given"), c("last"))).over(before)
        met = both.withColumn("reach", reach).where(~c("given") & c("reach").isNotNull() & ((c("joint") != " ") | (c("reach") >= c("place"))))
        alive = met.drop("given", "joint", "key_parent", "key_sibling", "reach")
        out = out.unionByName(alive.where(F.col("steps") == n + 1).select(*keys))
    return out.distinct()


def first_matching(found: DataFrame, kinds: dict[str, tuple[str, ...]]) -> DataFrame:
    """page_id, kind, selector, n_matches of the first selector of each kind that matches anything in a page."""
    spark, rows = found.sparkSession, [(k, n, s) for k, listed in kinds.items() for n, s in enumerate(listed)]
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "selector_id long, kind string, rank int, selector string")
    counts = match(found, dom.write_table(compile_selectors(table), "steps")).groupBy("page_id", "selector_id").agg(F.count("*").alias("n_matches"))
    named = counts.join(F.broadcast(table), "selector_id")
    best = named.groupBy("page_id", "kind").agg(F.min_by(F.struct("selector", "n_matches"), "rank").alias("b"))
    return best.select("page_id", "kind", "b.selector", "b.n_matches")


def items_of_configs(pages: DataFrame, configs: DataFrame, bases: DataFrame) -> DataFrame:
    """Result rows that stored selectors draw from pages.

    pages: page_id, provider_id, html. configs: provider_id (one row each), result, title, url, description and thumbnail
    selectors. bases: provider_id, base. Returns page_id, provider_id, item (the place of the result's element), title, url,
    description, thumbnail. The title is the text of all that its selector matches in an item, the item itself included, in
    document order; the URL is that of the first match with a link, the thumbnail that of the first match. Results
    without a title or a URL are left out. A description or thumbnail whose selector is null or matches nothing
    is null; what lies in nested items counts for each of them."""
    fields = ("result", "title", "url", "description", "thumbnail")
    unpivoted = configs.select("provider_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("selector")) for f in fields])).alias("x")).select("provider_id", "x.field", "x.selector")
    numbered = dom.write_table(unpivoted.where("selector IS NOT NULL").withColumn("selector_id", F.monotonically_increasing_id()), "config-selectors")
    steps = dom.write_table(compile_selectors(numbered).join(numbered.select("selector_id", "provider_id", "field"), "selector_id"), "config-steps")
    owners = pages.select("page_id", "provider_id")
    found = dom.stored(pages.select("page_id", "html"))
    marks = match(found.join(owners, "page_id"), steps, ["provider_id"]).join(numbered.select("selector_id", "field"), "selector_id")
    whole = found.select("page_id", "place", "path", "text", F.nullif(dom.attr("href"), F.lit("")).alias("href"), dom.image_of(F.lit("")).alias("image"))
    marks = dom.write_table(marks.select("page_id", "place", "field").join(whole, ["page_id", "place"]), "config-marks")
    items = marks.where("field = 'result'").select("page_id", F.col("place").alias("item"))
    inner = marks.where("field <> 'result'").withColumn("item", F.explode(F.concat("path", F.array("place"))))
    inner = inner.join(items, ["page_id", "item"]).groupBy("page_id", "item")
    joined = lambda f: F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("field") == f, F.struct("place", "text")))), lambda e: e["text"]), " "))
    given = lambda f: F.max(F.col("field") == f)
    first = lambda f, c: F.min_by(c, F.when((F.col("field") == f) & F.col(c).isNotNull(), F.col("place")))
    drawn = inner.agg(joined("title").alias("title"), first("url", "href").alias("href"), F.when(given("description"), joined("description")).alias("description"), F.min_by("image", F.when(F.col("field") == "thumbnail", F.col("place"))).alias("image"))
    rows = drawn.join(owners, "page_id").join(bases.select("provider_id", "base"), "provider_id")
    made = rows.select("page_id", "provider_id", "item", "title", resolve_url(F.col("href"), F.col("base")).alias("url"), "description", resolve_url(F.col("image"), F.col("base")).alias("thumbnail"))
    return made.where("title <> '' AND url <> ''")
