"""Mixing sources to target weights: whole epochs first, then Efraimidis-Spirakis sampling up to each source's budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveworks.llm.store import write_table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_TIMES = 2.0
SEED = "mix-1"
#: Rows of one source that share a slice of its key range; only the slice the budget ends in is sorted.
ROWS_A_SLICE = 5000
#: One row of some 60 bytes for each source is sent to the executors up to this many sources.
BROADCAST_SOURCES = 100_000


def uniform(row: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) that depends on a row's identity and the seed only, from 52 bits of MD5."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(row.cast("string"), F.lit("")))), 1, 13), 16, 10)
    return (bits.cast("long") + F.lit(0.5)) / F.lit(float(2**52))


def text_tie(text: Column) -> Column:
    """A long that tells texts apart: 60 bits of MD5; null is like empty."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_TIMES) -> DataFrame:
    """sizes: source, n_rows, source_size, a row for each source. Adds target and budget of its last, partial epoch.

    Weights go round the sources by code point, null last. The level at which a source's weight times the level
    would pass its cap is found on the sources sorted by cap over weight: capped ones keep their cap, the others
    share the rest by weight. This is the fixed point of resharing excess until no source is above its cap. The
    windows here have one row for each source, not for each document."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    by_cap = Window.orderBy("ratio", "place")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    first_free = F.when(F.col("level_here") <= F.col("ratio"), F.struct("ratio", "place", "level_here"))
    return (
        sizes.withColumn("place", F.row_number().over(order) - 1)
        .withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * F.lit(most))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("level_here", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
        .withColumn("level", F.min(first_free).over(everything)["level_here"])
        .withColumn("target", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
        .select("source", "n_rows", "source_size", "target", "epochs", "budget")
    )


def take_counts(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_TIMES, seed: str = SEED) -> DataFrame:
    """rows: doc_id, source, size, quality (above 0), tie (any long that tells rows of one id apart). One row for each row.

    Adds source_size, target, times (how often the mix takes the row) and taken (times x size). Every row is taken
    once for each whole epoch of its source; the rest of the target goes to rows in the order of
    -ln(u) / quality, as long as the middle of a row's words lies within the budget, so a source ends within half
    of one document of its target. Null sources are one source; null ids and repeated rows are rows like others;
    rows without words are free, and taken 0 words. An empty table gives an empty result."""
    row = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("tie").cast("string"))
    rows = write_table(rows.withColumn("rank_key", -F.log(uniform(row, seed)) / F.col("quality")), "mix-rows")
    sources = write_table(
        source_targets(rows.groupBy("source").agg(F.count("*").alias("n_rows"), F.sum("size").alias("source_size")), weights, share, most),
        "mix-sources",
    )
    small = sources.count() <= BROADCAST_SOURCES

    def with_source(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
        return left.join(F.broadcast(right) if small else right, on, "inner")

    # Slices of a source's key range, at equal steps of exp(-key), hold about ROWS_A_SLICE rows each.
    n_slices = F.ceil(F.col("n_rows") / ROWS_A_SLICE)
    known = sources.withColumnRenamed("source", "own")
    sliced = with_source(rows, known, F.col("source").eqNullSafe(F.col("own"))).drop("own")
    sliced = sliced.withColumn("slice", F.floor((1 - F.exp(-F.col("rank_key"))) * n_slices))
    slices = sliced.groupBy("source", "slice", "budget").agg(F.sum("size").alias("words"))
    up_to = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("before", F.coalesce(F.sum("words").over(up_to), F.lit(0)))
    last = slices.where((F.col("before") <= F.col("budget")) & (F.col("before") + F.col("words") > F.col("budget")))
    last = write_table(last.groupBy(F.col("source").alias("own")).agg(F.min("slice").alias("last_slice"), F.min("before").alias("before")), "mix-last")
    marked = sliced.join(F.broadcast(last) if small else last, F.col("source").eqNullSafe(F.col("own")), "left").drop("own")
    # A source without a last slice spends its whole budget: it is 0, or all its rows fit.
    whole = marked.where(F.col("last_slice").isNull() | (F.col("slice") != F.col("last_slice")))
    whole = whole.withColumn("more", F.when(F.col("last_slice").isNull(), F.col("budget") > 0).otherwise(F.col("slice") < F.col("last_slice")))
    within = Window.partitionBy("source", "slice").orderBy("rank_key", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, 0)
    split = marked.where(F.col("slice") == F.col("last_slice"))
    split = split.withColumn("more", F.col("before") + F.sum("size").over(within) - F.col("size") / 2 <= F.col("budget"))
    times = F.col("epochs") + F.col("more").cast("long")
    return (
        whole.unionByName(split)
        .withColumn("times", F.least(times, F.lit(int(most))))
        .withColumn("taken", F.col("times") * F.col("size"))
        .drop("rank_key", "slice", "last_slice", "before", "more", "epochs", "budget", "n_rows")
    )
