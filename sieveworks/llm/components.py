"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveworks.llm.store import write_table


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v (long). A row (node, root) for each node that is not the least of its component; root is the least.

    Each step keeps at most as many edges as there were; the neighbours of a node are reduced to their minimum by
    map-side combined aggregation, never gathered. Loops, repeats and both directions of an edge are fine."""
    edges = write_table(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while (now := _digest(edges)) != before:
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = write_table(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def roots_of_parents(parents: DataFrame) -> DataFrame:
    """parents: node, parent, one row for each node, parent < node. A row (node, root) for each node.

    Paths halve in each step: a node's parent is replaced by the parent's own. Rows never grow in number."""
    now = write_table(parents.select("node", F.col("parent").alias("root")), "parents")
    while True:
        up = now.select(F.col("node").alias("root"), F.col("root").alias("top"))
        moved = write_table(now.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")), "parents")
        now = moved.select("node", "root")
        if moved.where("moved").limit(1).count() == 0:
            return now
