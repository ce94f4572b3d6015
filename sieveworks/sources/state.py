"""Items in the state that pages carry in scripts: assignments cut at balanced braces, parsed as variants, walked in rounds.

A round looks at all objects of one depth at once: their arrays of known names give items, other objects go to the next
round. All of it is column expressions over the variant type; rounds are as many as the depth allows. Variants hold the
members of an object by name, so items of one object come in the order of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveworks.sources import dom

# Fixed values.
ARRAYS = ("videos", "movies", "items", "results", "data", "content", "episodes", "series", "shows", "posts", "entries")
ITEM_KEYS = ("title", "name", "url", "link", "id", "video", "movie")
FIELDS = {
    "title": ("title", "name", "headline", "videoTitle", "movieTitle"), "url": ("url", "link", "href", "slug", "id"), "description": ("description", "desc", "synopsis", "overview"),
    "thumbnail": ("thumbnail", "thumb", "poster", "image", "img", "cover"), "duration": ("duration", "length", "runtime"), "year": ("year", "release", "date", "releaseDate"),
    "rating": ("rating", "score", "imdb", "imdbRating"), "quality": ("quality", "resolution"),
}
STATES = (r"window\.__INITIAL_STATE__\s*=\s*", r"window\.__PRELOADED_STATE__\s*=\s*", r"window\.\w+State\s*=\s*")
MOST_DEPTH = 5


def balanced(text: Column) -> Column:
    """The object that a text begins with, up to the brace that closes it, strings left aside; null where none closes it.

    Strings are masked letter for letter: escaped characters first, then every other piece between quotes."""
    plain = F.replace(F.replace(text, F.lit("\\\\"), F.lit("__")), F.lit('\\"'), F.lit("__"))
    pieces = F.transform(F.split(plain, '"'), lambda p, i: F.when(i % 2 == 1, F.repeat(F.lit("_"), F.length(p))).otherwise(p))
    runs = F.regexp_extract_all(F.array_join(pieces, '"'), F.lit(r"[^{}]*[{}]"), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("taken"), F.lit(False).alias("done"))

    def step(a: Column, run: Column) -> Column:
        depth = a["depth"] + F.when(F.endswith(run, F.lit("{")), 1).otherwise(-1)
        pick = lambda new, old: F.when(a["done"], a[old]).otherwise(new).alias(old)
        return F.struct(pick(depth, "depth"), pick(a["taken"] + F.length(run), "taken"), (a["done"] | (depth <= 0)).alias("done"))

    found = F.aggregate(runs, start, step)
    return F.when(F.startswith(text, F.lit("{")) & found["done"], F.substring(text, F.lit(1), found["taken"]))


def _object(v: Column) -> Column:
    """The members of a variant that is an object, else null."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def _array(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _objects(values: Column) -> Column:
    return F.filter(values, lambda v: _object(v).isNotNull())


def _is_item(v: Column) -> Column:
    """Whether an object has two of the keys of an item, without case."""
    keys = F.array_distinct(F.transform(F.map_keys(_object(v)), lambda k: F.lower(k)))
    return F.size(F.array_intersect(keys, F.array(*map(F.lit, ITEM_KEYS)))) >= 2


def _members(path: Column, v: Column) -> Column:
    """The items and the objects one level down: array of struct(is_item, path, v)."""

    def row(is_item: Column, at: Column, value: Column) -> Column:
        return F.struct(is_item.alias("is_item"), at.alias("path"), value.alias("v"))

    def member(e: Column) -> Column:
        at, listed = F.concat(path, F.lit("."), e["key"]), F.lower(e["key"]).isin(*ARRAYS)
        each = F.transform(_objects(_array(e["value"])), lambda v, i: row(listed | _is_item(v), F.concat(at, F.lit("["), i.cast("string"), F.lit("]")), v))
        none = F.filter(F.array(row(F.lit(False), at, e["value"])), lambda x: F.lit(False))
        return F.when(_array(e["value"]).isNotNull(), each).when(_object(e["value"]).isNotNull(), F.array(row(F.lit(False), at, e["value"]))).otherwise(none)

    return F.flatten(F.transform(F.map_entries(_object(v)), member))


def _first(members: Column, names: tuple[str, ...]) -> Column:
    """The value of the first of the names that an object has, in a struct; null if it has none."""
    name = F.get(F.filter(F.array(*map(F.lit, names)), lambda n: F.map_contains_key(members, n)), F.lit(0))
    return F.when(name.isNotNull(), F.struct(F.element_at(members, name).alias("v")))


def _text(first: Column) -> Column:
    """A found value as text: an object as JSON, an array as null; a null value reads null."""
    v = first["v"]
    read = F.when(v.isNull() | F.is_variant_null(v), "null").when(_array(v).isNotNull(), None).when(_object(v).isNotNull(), F.to_json(v)).otherwise(F.try_variant_get(v, "$", "string"))
    return F.when(first.isNotNull(), read)


def walk(roots: DataFrame, most_depth: int = MOST_DEPTH) -> DataFrame:
    """roots: any columns, and v (variant). A row for each item of the objects among them, with its path and fields: those
    that have a title and a URL. Roots that are no objects give none."""
    keep = [c for c in roots.columns if c != "v"]
    rows = roots.select(*keep, F.lit(False).alias("is_item"), F.lit("$").alias("path"), "v").where(_object(F.col("v")).isNotNull())
    for _ in range(most_depth + 1):
        same = F.array(F.struct("is_item", "path", "v"))
        rows = rows.select(*keep, F.explode(F.when(F.col("is_item"), same).otherwise(_members(F.col("path"), F.col("v")))).alias("m")).select(*keep, "m.*")
    members = rows.where("is_item").select(*keep, "path", _object(F.col("v")).alias("m"))
    read = members.select(*keep, "path", F.array(*[_first(F.col("m"), names) for names in FIELDS.values()]).alias("values"))
    read = read.select(*keep, "path", F.transform("values", _text).alias("texts")).select(*keep, "path", *[F.get("texts", F.lit(i)).alias(f) for i, f in enumerate(FIELDS)])
    read = read.where("title IS NOT NULL AND url IS NOT NULL")
    return read.withColumns({"url": F.when(F.col("url").startswith("http"), F.col("url")).otherwise(F.concat(F.lit("/"), "url")), "year": F.substring("year", 1, 4)})


def page_states(found: DataFrame) -> DataFrame:
    """The state objects of each page: page_id, place (of the script), source (NextJS, NuxtJS, SPA), v.

    Next has a script of its own, whose page properties count; of Nuxt the first script that assigns its object, of the
    others the first assignment of each name in each script. What is no JSON gives nothing."""
    scripts = found.where("tag = 'script'").select("page_id", "place", "id", "text")
    next_first = scripts.where("id = '__NEXT_DATA__'").groupBy("page_id").agg(F.min_by(F.struct("place", "text"), "place").alias("s"))
    parts = [next_first.select("page_id", "s.place", F.lit("NextJS").alias("source"), F.try_variant_get(F.try_parse_json("s.text"), "$.props.pageProps", "variant").alias("v"))]
    after = lambda pattern: F.regexp_extract("text", rf"(?s){pattern}(\{{.*)", 1)
    nuxt = scripts.select("page_id", "place", balanced(after(r"__NUXT__\s*=\s*")).alias("body")).where("body IS NOT NULL")
    nuxt = nuxt.groupBy("page_id").agg(F.min_by(F.struct("place", "body"), "place").alias("s"))
    parts.append(nuxt.select("page_id", "s.place", F.lit("NuxtJS").alias("source"), F.try_parse_json("s.body").alias("v")))
    each = scripts.select("page_id", "place", F.explode(F.array(*[balanced(after(p)) for p in STATES])).alias("body"))
    parts.append(each.where("body IS NOT NULL").select("page_id", "place", F.lit("SPA").alias("source"), F.try_parse_json("body").alias("v")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).where("v IS NOT NULL")


def state_items(found: DataFrame, most_depth: int = MOST_DEPTH) -> DataFrame:
    """The items in the state of pages: page_id, place, source, path and fields."""
    return walk(page_states(found), most_depth)
