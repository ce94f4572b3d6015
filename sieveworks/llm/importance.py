"""Importance resampling toward a target's word n-grams: a table of word positions, hashed features, and their log ratios as gains.

The position table has a row for each word of a document; the words that follow it come by lead() within the document, so each
place gives one feature of every order. Features are counted by bucket over all documents and over the target; the gains, one
row a bucket, are sent to the tasks, and a document's weight is the mean gain of its features. Added noise of the Gumbel law
turns the highest scores into a draw without replacement in proportion to the weights' exponentials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveworks.llm.jaccard import ids_repeat, numbered
from sieveworks.llm.store import write_table
from sieveworks.llm.text import lower_ascii

#: What stands between words: ASCII other than digits and lower-case letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _positions(rows: DataFrame) -> DataFrame:
    """From key, doc_id, text: a row (key, doc_id, at, word) for each word, and one with a null word for a text without words."""
    found = F.filter(F.split(lower_ascii(F.coalesce("text", F.lit(""))), BETWEEN), lambda w: w != "")
    return rows.select("key", "doc_id", F.posexplode_outer(found).alias("at", "word"))


def _features(rows: DataFrame, orders: int, buckets: int) -> DataFrame:
    """key, doc_id, is_word (of order 1) and bucket of each feature; a row with a null bucket for a text without words."""
    placed = _positions(rows)
    bucket = lambda feature: F.crc32(feature) % buckets
    if orders == 1:
        return placed.select("key", "doc_id", F.col("word").isNotNull().alias("is_word"), bucket(F.col("word")).alias("bucket"))
    document = Window.partitionBy("key").orderBy("at")
    following = placed.select("key", "doc_id", "word", *[F.lead("word", k).over(document).alias(f"next_{k}") for k in range(1, orders)])
    runs = [F.col("word")]
    for k in range(1, orders):
        runs.append(F.concat(runs[-1], F.lit(" "), F.col(f"next_{k}")))
    each = following.select("key", "doc_id", F.posexplode(F.array(*runs)).alias("order", "feature"))
    return each.where("feature IS NOT NULL OR order = 0").select(
        "key", "doc_id", (F.col("feature").isNotNull() & (F.col("order") == 0)).alias("is_word"), bucket(F.col("feature")).alias("bucket")
    )


def bucket_gains(docs: DataFrame, target: DataFrame, orders: int, buckets: int) -> DataFrame:
    """bucket, gain of every bucket that a feature of docs falls in: the thousandfold log ratio of the target's smoothed share
    to that of docs, rounded down. Both tables (key, doc_id, text) are counted whole, combined where they are read."""

    def counted(rows: DataFrame, name: str) -> DataFrame:
        return _features(rows, orders, buckets).where("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias(name))

    s, t = write_table(counted(docs, "s"), "source-buckets"), write_table(counted(target, "t"), "target-buckets")
    totals = s.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("all_s")).crossJoin(t.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("all_t")))
    ratio = lambda a, b: (F.col(a).cast("double") + 1.0) * (F.col(b).cast("double") + float(buckets))
    joined = s.join(F.broadcast(t), "bucket", "left").fillna(0, ["t"]).crossJoin(F.broadcast(totals))
    return joined.select("bucket", F.floor(1000.0 * F.log(ratio("t", "all_s") / ratio("s", "all_t"))).alias("gain"))


def gumbel(doc_id: Column, seed: int) -> Column:
    """The thousandfold Gumbel noise of an id, rounded down; a null id counts as an empty string."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with place, 1 for the first: rows are dealt by ranges of the order and numbered within their range, so no task
    sees more than a range."""
    # The identifier holds the range's number above bit 33 and the row's place in it below.
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = write_table(sorted_rows, "ranked")
    ranges = placed.groupBy(F.shiftright("__at", 33).alias("__range")).agg(F.count("*").alias("__rows"))
    before = F.coalesce(F.sum("__rows").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # A row for each range, of which there are as many as shuffle partitions.
    offsets = F.broadcast(ranges.select("__range", before.alias("__before")))
    joined = placed.withColumn("__range", F.shiftright("__at", 33)).join(offsets, "__range")
    place = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return joined.withColumn("place", place).drop("__at", "__range", "__before")


def resample(docs: DataFrame, target: DataFrame, orders: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """docs: doc_id, text. target: text. For each row of docs: doc_id, n_features, weight, score, rank (null if not drawn), all long.

    Features are all runs of 1 to `orders` words. Drawn are, of the documents with least_words words, that percentage with the
    highest scores, ties going to the smaller id, null last. Null and empty texts have no features and weight 0. Repeated
    rows count and are ranked each for itself; equal rows have equal scores and following ranks. An empty target leaves all
    gains to the documents' own counts; an empty docs gives an empty result. Other columns are not read."""
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    rows = numbered(rows).withColumnRenamed("__row", "key") if ids_repeat(rows) else rows.withColumn("key", F.col("doc_id"))
    texts = target.select(F.monotonically_increasing_id().alias("key"), F.lit(0).alias("doc_id"), "text")
    # One row a bucket.
    gains = F.broadcast(write_table(bucket_gains(rows, write_table(texts, "target"), orders, buckets), "gains"))
    found = _features(rows, orders, buckets).join(gains, "bucket", "left").groupBy("key", "doc_id")
    found = found.agg(F.count_if("is_word").alias("n_words"), F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("total"))
    weight = F.when(F.col("n_features") > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(F.lit(0)).cast("long")
    scored = found.withColumn("weight", weight).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    scored = write_table(scored.select("key", "doc_id", "n_features", "weight", "score", (F.col("n_words") >= least_words).alias("long_enough")), "scored")
    eligible = scored.where("long_enough")
    drawn = eligible.count() * percent // 100
    placed = ranked(eligible, F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("key"))
    columns = ["doc_id", "n_features", "weight", "score"]
    return placed.select(*columns, F.when(F.col("place") <= drawn, F.col("place")).alias("rank")).unionByName(scored.where("NOT long_enough").select(*columns, F.lit(None).cast("long").alias("rank")))
