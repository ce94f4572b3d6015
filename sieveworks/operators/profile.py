"""Learned preferences: weights by group counts over the largest count, and their text form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def weights(rows: DataFrame, key: str) -> DataFrame:
    """key, n and weight = n over the largest n; null and blank keys are left out."""
    counts = rows.where(F.trim(F.col(key).cast("string")) != "").groupBy(key).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.max("n").alias("most")))).select(key, "n", (F.col("n") / F.col("most")).alias("weight"))


def keyword_weights(likes: DataFrame) -> DataFrame:
    return weights(likes.select(F.explode(F.split("title_keywords", ",")).alias("keyword")), "keyword")


def parse_weights(text: Column) -> Column:
    """k:w;k:w as a map; entries without a colon are dropped, weights that are no number are 0, the last of a key holds."""
    entries = F.filter(F.split(text, ";"), lambda e: e.contains(":"))
    pairs = F.transform(entries, lambda e: F.struct(F.split(e, ":")[0].alias("k"), F.coalesce(F.split(e, ":")[1].try_cast("double"), F.lit(0.0)).alias("w")))
    kept = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(kept)


def preference_boost(rows: DataFrame, likes: DataFrame) -> DataFrame:
    """rows with boost: 15 for a liked URL, up to 10 for title words by weight, up to 5 for the provider, up to 3 for the quality."""
    words = F.filter(F.split(F.lower("title"), r"\W+"), lambda w: F.length(w) > 2)
    keyed = rows.select("pos", F.explode(words).alias("keyword")).join(keyword_weights(likes), "keyword")
    by_words = keyed.groupBy("pos").agg(F.least(F.sum("weight") * 10.0, F.lit(10.0)).alias("by_words"))
    by_provider = weights(likes, "provider_id").select("provider_id", (F.col("weight") * 5).alias("by_provider"))
    by_quality = weights(likes.withColumn("tag", F.lower("quality")), "tag").select("tag", (F.col("weight") * 3).alias("by_quality"))
    liked = likes.select("url").distinct().withColumn("by_url", F.lit(15.0))
    out = rows.withColumn("tag", F.lower("quality"))
    for other, key in ((by_words, "pos"), (by_provider, "provider_id"), (by_quality, "tag"), (liked, "url")):
        out = out.join(other, key, "left")
    total = sum((F.coalesce(c, F.lit(0.0)) for c in ("by_words", "by_provider", "by_quality")), F.coalesce("by_url", F.lit(0.0)))
    return out.withColumn("boost", total).drop("by_words", "by_provider", "by_quality", "by_url", "tag")


def encoded_weights(weighted: DataFrame, key: str) -> DataFrame:
    """One row, encoded: k:w;k:w of weights() by falling count; empty for no rows. The profile is one row by its nature, so
    its keys come together."""
    entry = F.struct((-F.col("n")).alias("n"), F.col(key).alias("k"), F.round("weight", 4).alias("w"))
    listed = F.array_sort(F.collect_list(entry))
    return weighted.agg(F.array_join(F.transform(listed, lambda e: F.concat(e["k"], F.lit(":"), e["w"].cast("string"))), ";").alias("encoded"))
