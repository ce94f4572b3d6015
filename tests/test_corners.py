"""Queries on rows that the small tables do not hold."""

from datetime import datetime, timedelta

import duckdb
from pyspark.sql import functions as F

from sieveworks.plans import queries as plans


def run(spark, folder, name):
    return plans.queries()[name](spark, str(folder))


def test_cache_and_limit_of_repeated_and_missing_ids(spark, tmp_path):
    start = datetime(2024, 1, 1)
    at = lambda ms: start + timedelta(milliseconds=ms)
    rows = [(4, at(0), 1), (4, at(0), 1), (4, at(0), 2), (5, at(98), 1), (7, at(102), 1), (None, at(140), 1), (8, at(500), None), (8, None, 1)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long")
    events.selectExpr("*", "'view' AS event_type", "1.0D AS value", "'{}' AS props").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(((r["event_id"] or 0, r["limited"]) for r in run(spark, tmp_path, "cache_and_limit").collect()))
    assert got == [(0, True), (4, False), (4, False), (4, True), (5, False), (7, True), (8, False), (8, False)]


def test_cache_and_limit_rounds_to_milliseconds_as_its_sql(spark, tmp_path):
    starts = (datetime(2024, 1, 1), datetime(1969, 12, 31, 23, 59, 59))
    gaps = [(s, f, g) for s in starts for f in (0, 1, 499, 500, 501, 999) for g in (49_000, 49_499, 49_500, 49_501, 49_999, 50_000, 50_499, 50_500, 50_999)]
    # Pairs of events, each pair alone in its second; its gap crosses a slot's edge or not.
    at = [(s + timedelta(seconds=5 * i if s.year > 2000 else -5 * i, microseconds=f + 60_000 * (i % 2)), g) for i, (s, f, g) in enumerate(gaps)]
    rows = [(2 * i + n, t + timedelta(microseconds=n * g), 1) for i, (t, g) in enumerate(at) for n in (0, 1)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long")
    events.selectExpr("*", "'view' AS event_type", "1.0D AS value", "'{}' AS props").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(tuple(r) for r in run(spark, tmp_path, "cache_and_limit").collect())
    sql = plans.oracle_sql()["cache_and_limit"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    assert got == sorted(con.execute(sql).fetchall())
    assert 0 < sum(limited for _, _, limited in got) < len(gaps)


def test_config_items_keep_open_references(spark, tmp_path):
    spark.createDataFrame([(1, "https://e.net/", '<body><nav><ul><li><a href="/a">x</a></li></ul></nav><article><h1>ver&amp</h1></article></body>'), (21, "https://e.net/", '<body><nav><ul><li><a href="/a">x</a></li></ul></nav><article><h1>a &amp; b &#39; &lt &#3</h1></article></body>')], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(1, "S", 0)], "s_suppkey long, s_name string, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    events = "event_id long, ts timestamp, user_id long, event_type string, value double"
    spark.createDataFrame([], events).write.parquet(f"{tmp_path}/events.parquet")
    got = {r["page_id"]: r["title"] for r in run(spark, tmp_path, "config_items").collect()}
    assert got == {1: "ver&amp", 21: "a & b ' &lt &#3"}


def test_url_media_labels_of_numbers_with_1440(spark, tmp_path):
    docs = spark.range(14400, 14412).selectExpr("id AS doc_id", "'a\nb' AS text", "'en' AS lang", "'src1' AS source", "3L AS n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["pos"]: r["resolved_quality"] for r in run(spark, tmp_path, "url_media_labels").collect()}
    assert (got[14401], got[14402], got[14403], got[14407], got[14410]) == ("1080p", "Unknown", "Unknown", "4K", "720p")


def test_dom_data_of_each_page(spark, tmp_path):
    own = '<div data-title="D" data-url="/d"></div>'
    pages = [(1, "https://a.net/x", "<title> T &amp; U </title>"), (2, "/no-host", own), (3, None, own), (4, "https://b.net", None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(tuple(r) for r in run(spark, tmp_path, "dom_data").collect())
    title = "T &amp; U"
    assert got == [(1, "data", "a.net", "/of/a.net"), (1, "embedded", title, "https://a.net/x"), (1, "linked", title, "https://a.net/x"), (2, "data", "D", "/d"), (3, "data", "D", "/d")]


def test_recovery_of_each_kind_of_error(spark):
    from sieveworks.operators.decisions import recovery_action

    rows = spark.createDataFrame([(e,) for e in ("Error 403", "bad format", "Timeout", "proxy down", "other")], "error string")
    got = [r[0] for r in rows.select(recovery_action(F.col("error"))).collect()]
    assert got == ["USE_PROXY", "TRY_ALTERNATE_QUALITY", "RETRY_WITH_DELAY", "ROTATE_PROXY", "RETRY_WITH_DELAY"]
