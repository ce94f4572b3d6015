"""Ordered folds of keyed events. A step is a map x -> min(hi, max(lo, a x + b)) with a >= 0; such maps compose to one of
their kind, so the events of a key are folded in slices of an hour and of SLICE_EVENTS events first; then the maps of an hour's
slices, of a day's hours and of a key's days come together, so no list grows with the events of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE_SECONDS, SLICE_EVENTS, DAY = 3600, 4096, 24
_INFINITE = float("inf")


def step(a, b, lo=None, hi=None) -> Column:
    """A map of one event; a, b and the bounds are columns or numbers."""
    col = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("double")
    return F.struct(col(a).alias("a"), col(b).alias("b"), col(-_INFINITE if lo is None else lo).alias("lo"), col(_INFINITE if hi is None else hi).alias("hi"))


def _bounded(x: Column, m: Column) -> Column:
    return F.least(F.greatest(x, m["lo"]), m["hi"])


def _after(first: Column, then: Column) -> Column:
    """The map that does first, then the other. An infinite bound stays infinite where its factor is 0."""

    def moved(bound: Column) -> Column:
        return _bounded(F.when(then["a"] == 0, then["b"]).otherwise(then["a"] * bound + then["b"]), then)

    return F.struct((then["a"] * first["a"]).alias("a"), (then["a"] * first["b"] + then["b"]).alias("b"), moved(first["lo"]).alias("lo"), moved(first["hi"]).alias("hi"))


def _composed(maps: Column) -> Column:
    return F.aggregate(maps, step(1.0, 0.0), _after)


def _applied(m: Column, start: Column) -> Column:
    return _bounded(m["a"] * start + m["b"], m)


def slice_of(ts: str = "ts") -> Column:
    return F.floor(F.unix_timestamp(ts) / SLICE_SECONDS)


def fold(events: DataFrame, keys: list[str], steps: dict[str, Column], starts: dict[str, float]) -> DataFrame:
    """keys, n, last_ts and a column for each of steps: its start moved by each event's map in the order of (ts, event_id).
    Null keys are a key like others; a key without events gives no row."""
    order = Window.partitionBy(*keys, "hour").orderBy("ts", "event_id")
    rows = events.select(*keys, "ts", "event_id", slice_of().alias("hour"), F.struct("ts", "event_id", *[s.alias(n) for n, s in steps.items()]).alias("e"))
    rows = rows.withColumn("part", F.floor((F.row_number().over(order) - 1) / SLICE_EVENTS))
    parts = rows.groupBy(*keys, "hour", "part").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"), F.array_sort(F.collect_list("e")).alias("es"))
    maps = parts.select(*keys, "hour", "part", "n", "last_ts", *[_composed(F.transform("es", _field(n))).alias(n) for n in steps])
    for group, at in ((["hour"], "part"), (["day"], "hour"), ([], "day")):
        maps = maps.withColumn("day", F.floor(F.col("hour") / DAY)) if group == ["day"] else maps
        joined = maps.groupBy(*keys, *group).agg(F.sum("n").alias("n"), F.max("last_ts").alias("last_ts"), F.array_sort(F.collect_list(F.struct(at, *steps))).alias("ss"))
        maps = joined.select(*keys, *group, "n", "last_ts", *[_composed(F.transform("ss", _field(n))).alias(n) for n in steps])
    return maps.select(*keys, "n", "last_ts", *[_applied(F.col(n), F.lit(starts[n])).alias(n) for n in steps])


def _field(name: str):
    return lambda x: x[name]


#: Weight of the past, and what a provider without events is taken for.
DECAY, START_SUCCESS, START_COUNT, START_MS, START_CONSISTENCY = 0.95, 0.5, 0.0, 3000.0, 0.5


def provider_state(events: DataFrame, key: str) -> DataFrame:
    """key, n, success, mean_count, mean_ms, consistency, last_failed after all events (ok, ms, n_results).

    The averages are linear folds. Consistency moves by what an event says against the averages before it, so the averages at
    each slice's start come first, then a map for each slice."""
    keep = 1 - DECAY
    rows = events.select(key, "ts", slice_of().alias("slice"), F.struct("ts", "event_id", F.col("ok").cast("double").alias("ok"), F.col("n_results").cast("double").alias("c"), F.col("ms").cast("double").alias("ms")).alias("e"))
    slices = rows.groupBy(key, "slice").agg(F.array_sort(F.collect_list("e")).alias("es"), F.count("*").alias("n"))
    moved = lambda f: F.aggregate("es", F.lit(0.0), lambda x, e: x * DECAY + e[f] * keep)
    slices = slices.withColumns({"m_ok": moved("ok"), "m_c": moved("c"), "m_ms": moved("ms")})
    # Averages at the start of each slice: a sum over the earlier slices of a key, weighted by the events since.
    before = Window.partitionBy(key).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    known = slices.withColumn("earlier", F.collect_list(F.struct("n", "m_ok", "m_c")).over(before))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(START_SUCCESS).alias("ok"), F.lit(START_COUNT).alias("c"))
    known = known.withColumn("was", F.aggregate("earlier", zero, lambda s, x: F.struct((s["n"] + x["n"]).alias("n"), (s["ok"] * F.pow(F.lit(DECAY), x["n"]) + x["m_ok"]).alias("ok"), (s["c"] * F.pow(F.lit(DECAY), x["n"]) + x["m_c"]).alias("c"))))
    begin = F.struct(F.col("was.n").alias("n"), F.col("was.ok").alias("ok"), F.col("was.c").alias("c"), step(1.0, 0.0).alias("m"))

    def seen(s: Column, e: Column) -> Column:
        said = F.when((s["ok"] > 0.5) == (e["ok"] > 0.5), 0.1).otherwise(-0.1) + F.when(F.abs(e["c"] - s["c"]) < 10, 0.1).otherwise(-0.05)
        own = F.when(s["n"] < 3, step(0.0, 0.5)).otherwise(step(1.0, said, 0.0, 1.0))
        return F.struct((s["n"] + 1).alias("n"), (s["ok"] * DECAY + e["ok"] * keep).alias("ok"), (s["c"] * DECAY + e["c"] * keep).alias("c"), _after(s["m"], own).alias("m"))

    mapped = known.select(key, "slice", "n", "m_ok", "m_c", "m_ms", F.aggregate("es", begin, seen)["m"].alias("m"), F.element_at("es", -1)["ok"].alias("last_ok"))
    whole = mapped.groupBy(key).agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("slice", "n", "m_ok", "m_c", "m_ms", "m", "last_ok"))).alias("ss"))
    linear = lambda f, start: F.aggregate("ss", F.lit(start), lambda x, s: x * F.pow(F.lit(DECAY), s["n"]) + s[f])
    return whole.select(
        key, "n", linear("m_ok", START_SUCCESS).alias("success"), linear("m_c", START_COUNT).alias("mean_count"), linear("m_ms", START_MS).alias("mean_ms"),
        _applied(_composed(F.transform("ss", _field("m"))), F.lit(START_CONSISTENCY)).alias("consistency"), (F.element_at("ss", -1)["last_ok"] < 0.5).alias("last_failed"),
    )


#: Events that are looked back on, and events of one exact step; values below 2 ** (62 - LOOK) stay within a long.
LOOK_BACK, LOOK = 160, 40


def halving_average(events: DataFrame, key: str, value: str) -> DataFrame:
    """key and avg: 0, moved by each event to the whole part of (avg + value) / 2, exactly.

    k steps are x -> floor((x + sum of value * 2^i) / 2^k). The last LOOK_BACK events decide the result if it is the same
    for the least and the largest average before them; a key where it is not is folded whole."""
    order = Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("event_id"))
    totals = events.groupBy(key).agg(F.count("*").alias("total"), F.max(value).cast("long").alias("most"))
    recent = events.select(key, F.col(value).cast("long").alias("v"), "ts", "event_id").withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < LOOK_BACK)
    steps = recent.groupBy(key, F.floor(F.col("place") / LOOK).alias("part")).agg(
        F.count("*").cast("int").alias("__steps"), F.struct(F.max("place").alias("last"), F.collect_list(F.struct("place", "v")).alias("vs")).alias("p"))
    weight = lambda p, e: F.call_function("shiftleft", e["v"], (p["last"] - e["place"]).cast("int"))
    steps = steps.select(key, "part", "__steps", F.aggregate("p.vs", F.lit(0).cast("long"), lambda x, e: x + weight(F.col("p"), e)).alias("sum"))
    listed = steps.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("part", "__steps", "sum")), asc=False).alias("ss")).join(totals, key)
    through = lambda start: F.aggregate("ss", start, lambda x, s: F.call_function("shiftright", x + s["sum"], s["__steps"]))
    # Averages never leave 0 to the largest value.
    known = listed.select(key, through(F.lit(0).cast("long")).alias("low"), through(F.when(F.col("total") > LOOK_BACK, F.col("most")).otherwise(0).cast("long")).alias("high"))
    sure = known.where("low = high").select(key, F.col("low").alias("avg"))
    rest = events.join(F.broadcast(known.where("low <> high").select(key)), key, "left_semi")
    whole = rest.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", F.col(value).cast("long").alias("v")))).alias("es"))
    return sure.unionByName(whole.select(key, F.aggregate("es", F.lit(0).cast("long"), lambda x, e: F.call_function("shiftright", x + e["v"], F.lit(1))).alias("avg")))
