"""Order-aware list operations as windows: keep-first, top of each group, merges and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(rows: DataFrame, keys: list[str | Column], order: list[Column | str]) -> DataFrame:
    """The first row of each key in the given order, as keep-first deduplication of an ordered list does. The order
    must decide ties itself."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def top_of_group(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= k).drop("__n")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new put in by key; new keys are appended."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def merge_by_confidence(parts: list[DataFrame], key: Column, confidence: str, place: str) -> DataFrame:
    """Union of the parts; for each key the most confident row, the earliest among equals, at the place of the key's
    first row."""
    rows = None
    for i, part in enumerate(parts):
        part = part.withColumn("__part", F.lit(i))
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.withColumn("__key", key)
    first = F.min(F.struct("__part", place)).over(Window.partitionBy("__key"))
    best = Window.partitionBy("__key").orderBy(F.desc(confidence), "__part", place)
    return rows.withColumn("first_place", first).withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n", "__key", "__part")
