"""Provider health from event logs. Ordered folds are written as aggregates: an exponential average is a chain of maps
x -> a x + b, which compose, so events are folded in time slices first and no key's events are gathered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DECAY = 0.95


def moving_average(events: DataFrame, key: str, value: Column, start: float, decay: float = DECAY, slice_seconds: int = 3600) -> DataFrame:
    """key, n and ema: start, moved by each event in the order of (ts, event_id) to decay x + (1 - decay) value."""
    sliced = events.select(key, "ts", "event_id", value.cast("double").alias("x"), F.floor(F.unix_timestamp("ts") / slice_seconds).alias("slice"))
    later = F.row_number().over(Window.partitionBy(key, "slice").orderBy(F.desc("ts"), F.desc("event_id"))) - 1
    parts = sliced.withColumn("part", (1 - decay) * F.col("x") * F.pow(F.lit(decay), later))
    parts = parts.groupBy(key, "slice").agg(F.count("*").alias("n"), F.sum("part").alias("b"))
    after = F.coalesce(F.sum("n").over(Window.partitionBy(key).orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = parts.withColumn("b", F.col("b") * F.pow(F.lit(decay), after)).groupBy(key).agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    return whole.select(key, "n", (F.col("b") + start * F.pow(F.lit(decay), F.col("n"))).alias("ema"))


def running_totals(events: DataFrame, key: str, value: Column, slice_seconds: int = 3600) -> DataFrame:
    """events with total and place: sum and number of a key's events up to each, in the order of (ts, event_id). Only a slice of
    time of a key is sorted in one place; what went before is a sum over slices."""
    sliced = events.withColumn("slice", F.floor(F.unix_timestamp("ts") / slice_seconds))
    within = Window.partitionBy(key, "slice").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    sums = sliced.groupBy(key, "slice").agg(F.sum(value).alias("own_total"), F.count("*").alias("own_place"))
    earlier = Window.partitionBy(key).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(key, "slice", *[F.coalesce(F.sum(f"own_{c}").over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("total", "place")])
    rows = sliced.withColumns({"own_total": F.sum(value).over(within), "own_place": F.count("*").over(within)}).join(before, [key, "slice"])
    return rows.withColumns({c: F.col(f"own_{c}") + F.col(f"{c}_before") for c in ("total", "place")}).drop("slice", "own_total", "own_place", "total_before", "place_before")


def streaks(events: DataFrame, key: str) -> DataFrame:
    """key, successes, failures, success_ms (sum), last_ok, streak: failures since the last success."""
    at = F.struct("ts", "event_id")
    counts = events.groupBy(key).agg(
        F.count_if("ok").alias("successes"), F.count_if(~F.col("ok")).alias("failures"),
        F.sum(F.when(F.col("ok"), F.col("ms"))).alias("success_ms"), F.max(F.when(F.col("ok"), at)).alias("last"),
    )
    since = events.where("NOT ok").join(counts.select(key, "last"), key).where(F.col("last").isNull() | (at > F.col("last")))
    since = since.groupBy(key).agg(F.count("*").alias("streak"))
    joined = counts.join(since, key, "left").withColumn("streak", F.coalesce("streak", F.lit(0)))
    return joined.select(key, "successes", "failures", F.coalesce("success_ms", F.lit(0)).alias("success_ms"), F.col("last.ts").alias("last_ok"), "streak")


def health_score(known: DataFrame, as_of: Column) -> DataFrame:
    """streaks() with score, mean_ms, aggressive and delay_ms."""
    total = F.col("successes") + F.col("failures")
    penalty = F.when(F.col("streak") > 0, 1.0 - F.least(F.col("streak") * 0.1, F.lit(0.5))).otherwise(1.0)
    recent = F.when(F.coalesce(F.unix_timestamp(as_of) - F.unix_timestamp("last_ok") < 60, F.lit(False)), 0.1).otherwise(0.0)
    score = F.when(total == 0, 1.0).otherwise(F.least(F.greatest(F.col("successes") / total * penalty + recent, F.lit(0.0)), F.lit(1.0)))
    delay = F.when(F.col("streak") >= 5, 3000).when(F.col("streak") >= 3, 1000).when(F.col("streak") >= 1, 500).otherwise(0)
    mean = F.when(F.col("successes") > 0, F.floor(F.col("success_ms") / F.col("successes"))).otherwise(0).cast("long")
    return known.withColumns({"score": score, "mean_ms": mean, "aggressive": F.col("streak") >= 3, "delay_ms": delay})


def retry_decision(rate: Column, attempt: Column, error: Column) -> Column:
    """struct(retry, delay_ms) by success rate, attempts so far and the last error."""
    most = F.when(rate > 0.8, 3).when(rate > 0.5, 2).otherwise(1)
    final = F.coalesce(F.lower(error).rlike("403|404|blocked|cloudflare|captcha"), F.lit(False))
    retry = (attempt < most) & ~final
    return F.struct(retry.alias("retry"), F.when(retry, F.least(1000 * F.pow(F.lit(2), attempt), F.lit(10_000)).cast("long")).otherwise(0).alias("delay_ms"))


def speed_score(ms: Column) -> Column:
    return F.when(ms < 1000, 1.0).when(ms < 3000, 0.8).when(ms < 5000, 0.6).when(ms < 10_000, 0.4).otherwise(0.2)
