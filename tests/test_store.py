from pyspark.sql import functions as F

from sieveworks.operators import containers, layout
from sieveworks.sources import dom, selectors
from sieveworks.sources.store import write_table


def test_small_files_are_no_reason_to_broadcast(spark):
    """Two million rows whose files take next to no space; both sides of each join are drawn from such tables."""
    numbers = spark.range(2_000_000).select((F.col("id") % 2000).alias("page_id"), F.floor(F.col("id") / 2000).cast("int").alias("place"), F.lit("p").alias("tag"))
    found = write_table(numbers.withColumn("last", F.col("place")), "narrow")
    roots = found.where("place < 2").select("page_id", "place", "last")
    sums = containers.subtree_sums(found, roots, {"n": F.col("tag") == "p"})
    plan = sums._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert sums.agg(F.count("*"), F.min("n"), F.max("n")).first() == (4000, 1, 1)


def test_tables_named_for_broadcast_are_sent(spark):
    found = write_table(spark.range(100).withColumnRenamed("id", "page_id"), "few")
    plan = found.join(F.broadcast(write_table(found, "fewer")), "page_id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_containers_and_layouts_send_only_selectors(spark, monkeypatch):
    """Whatever Spark thinks of sizes, no rows of pages are broadcast: only the tables of steps and names of selectors."""
    words = "episode season video movie watch play " * 4
    item = f"<article class='item'><a href='/watch/1'>{words}</a><img src='a.jpg'><h2>{words}</h2></article>"
    html = f"<body><div class='list'>{item * 5}</div><ul>{'<li><a>x</a></li>' * 6}</ul><table>{'<tr><td>1</td></tr>' * 4}</table></body>"
    pages = spark.createDataFrame([(i, html) for i in range(40)], "page_id long, html string")
    sent = []

    def written(df, name):
        out = write_table(df, name)
        sent.extend(broadcast_rows(df))
        return out

    def broadcast_rows(df):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        return [line for line in plan.splitlines() if "BroadcastExchange" in line and "Initial" not in line]

    monkeypatch.setattr(dom, "write_table", written)
    named = []
    monkeypatch.setattr(selectors.F, "broadcast", lambda df: named.append(df) or df.hint("merge"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        found = dom.stored(pages)
        classed = dom.write_table(containers.classify(found, containers.find_containers(found)), "containers")
        items = containers.result_items(found, classed)
        for df in (containers.page_types(pages.select("page_id", F.lit("u").alias("url")), found, classed), items, layout.layout_patterns(found, pages)):
            sent.extend(broadcast_rows(df))
        assert classed.count() >= 40 and items.count() == 200
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert named and not sent
