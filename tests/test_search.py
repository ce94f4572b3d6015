"""The search queries against DuckDB on the same tables, and edge cases of the operators."""

import duckdb
import pytest
from pyspark.sql import functions as F

from sieveworks.functions import scores as S
from sieveworks.operators import folds, health, lists, profile, ranking
from sieveworks.plans import queries as Q
from sieveworks.sources import pages as P
from sieveworks.streaming import health as stream

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(value):
    if isinstance(value, float):
        return round(value, 5)
    if isinstance(value, int) and not isinstance(value, bool):
        return float(value)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_agrees_with_sql(spark, duck, name):
    found = Q.queries()[name](spark, SF)
    asked = duck.execute(Q.oracle_sql()[name])
    names = [d[0] for d in asked.description]
    assert sorted(found.columns) == sorted(names)
    assert rows_of(found.columns, found.collect()) == rows_of(names, asked.fetchall())


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_freshness_bands(spark):
    for text, score in ((None, 0.3), ("", 0.3), ("2 HOURS ago", 1.0), ("yesterday", 0.9), ("8 days", 0.2), ("a week", 0.2), ("2 weeks", 0.7), ("3 months", 0.5), ("99999999999 days", 0.2)):
        assert one(spark, S.freshness(F.lit(text).cast("string"))) == score


def test_engagement_without_signals_is_zero(spark):
    assert one(spark, S.engagement(F.lit(None).cast("long"), F.lit(None).cast("long"), F.lit(None).cast("double"))) == 0.0
    assert one(spark, S.engagement(F.lit(0), F.lit(None).cast("long"), F.lit(20.0))) == pytest.approx(0.55)


def test_quality_words_are_substrings(spark):
    assert one(spark, S.quality(F.lit("Sports events"), F.lit(None).cast("string"), F.lit(""), F.lit(None).cast("string"))) == 0.25


def test_urls(spark):
    for url, full in (("http://x/a", "http://x/a"), ("//x/a", "https://x/a"), ("/a", "https://b.org/a"), ("", "https://b.org/"), ("a", "https://b.org/a")):
        assert one(spark, S.resolve_url(F.lit(url), F.lit("https://b.org/"))) == full
    assert one(spark, S.normal_url(F.lit("https://www.Example.com/A/?q=1#f"))) == "example.com/a"
    assert one(spark, S.normal_url(F.lit("NO url//"))) == "no url"
    assert one(spark, S.url_domain(F.lit("plain"))) == "plain"
    assert one(spark, S.site_name(F.lit("https://www.mysite.org/x"))) == "Mysite"


def test_keep_first_ignores_partitioning(spark):
    rows = spark.createDataFrame([("a", 3), ("a", 1), ("b", 2), ("a", 2)], "k string, pos int")
    for n in (1, 3, 7):
        assert sorted(map(tuple, lists.keep_first(rows.repartition(n), ["k"], ["pos"]).collect())) == [("a", 1), ("b", 2)]


def test_merge_keeps_first_place_and_best_confidence(spark):
    a = spark.createDataFrame([("u", 1, 0.5), ("v", 2, 0.9)], "url string, pos int, confidence double")
    b = spark.createDataFrame([("u", 1, 0.8), ("v", 2, 0.9)], "url string, pos int, confidence double")
    got = {r["url"]: (r["confidence"], r["first_place"]["__part"]) for r in lists.merge_by_confidence([a, b], F.col("url"), "confidence", "pos").collect()}
    assert got == {"u": (0.8, 0), "v": (0.9, 0)}


def result_rows(spark, rows):
    schema = "pos int, title string, url string, description string, thumbnail string, score double"
    return spark.createDataFrame(rows, schema)


def test_display_filter_falls_back_to_all_valid_rows(spark):
    rows = result_rows(spark, [(1, "Latest release", "https://example.com/video/1", "A popular title", None, 2.0), (2, "Another item", "https://example.com/movie/2", "Another release", None, 1.5), (3, "Drama", "https://example.com/d", None, None, 9.0), (4, "Xyz", "https://example.com/genre/x", None, None, 9.0)])
    got = [r["title"] for r in ranking.display_filter(rows, "batman returns", 10).collect()]
    assert got == ["Latest release", "Another item"]


def test_top_keeps_the_first_seen_and_related_the_best(spark):
    rows = result_rows(spark, [(1, "Same", "u1", None, None, 20.0), (2, "same!", "u2", None, None, 30.0), (3, "Other", "u3", None, None, 6.0), (4, "other", "u4", None, None, 7.0), *((10 + i, f"Full {i}", f"f{i}", None, None, 50.0) for i in range(8))])
    got = {(r["segment"], r["pos"]) for r in ranking.top_and_related(rows, "of the").collect()}
    assert got == {("top", 1), ("related", 4), *(("top", 10 + i) for i in range(8))}


def test_moving_average_equals_the_fold(spark):
    values = [1, 0, 0, 1, 1, 0, 1, 1, 1, 0] * 7
    rows = spark.createDataFrame([("p", i, v) for i, v in enumerate(values)], "k string, event_id int, v int").withColumn("ts", F.timestamp_seconds(F.col("event_id") * 977))
    x = 1.0
    for v in values:
        x = x * 0.95 + 0.05 * v
    assert health.moving_average(rows, "k", F.col("v"), 1.0).first()["ema"] == pytest.approx(x)


def test_halving_average_equals_the_fold(spark):
    values = [(i * 7919) % 5000 for i in range(200)]
    rows = spark.createDataFrame([("p", i, v) for i, v in enumerate(values)], "k string, event_id int, v int").withColumn("ts", F.timestamp_seconds("event_id"))
    x = 0
    for v in values:
        x = (x + v) // 2
    assert folds.halving_average(rows, "k", "v").first()["avg"] == x


@pytest.mark.parametrize("values", [[100] * 50, [100] * 700, [1] * 3, [0], [99, *[100] * 400], [5] * 161])
def test_halving_average_is_exact(spark, values):
    rows = spark.createDataFrame([("p", i, v) for i, v in enumerate(values)], "k string, event_id int, v int").withColumn("ts", F.timestamp_seconds("event_id"))
    x = 0
    for v in values:
        x = (x + v) // 2
    assert folds.halving_average(rows, "k", "v").first()["avg"] == x


def test_short_top_lists_are_filled(spark):
    """The passes by literal cases: related words first (7 points more), then the best related rows, then rows with a word of the query."""
    rows = [(1, "old film night", "u1", 20.0), (2, "cinema of old", "u2", 6.0), (3, "garden walk", "u3", 5.5), (4, "movie night", "u4", 1.0), (5, "nothing here", "u5", 0.5), (6, "film twice", "u1", 19.0)]
    frame = spark.createDataFrame([(p, t, None, f"https://e.net/{u}", s) for p, t, u, s in rows], "pos int, title string, description string, url string, score double")
    got = ranking.top_and_related(frame, "movie night").orderBy("segment", "rank").collect()
    top = [(r["pos"], r["score"]) for r in got if r["segment"] == "top"]
    assert top == [(1, 20.0), (2, 6.0), (3, 5.5), (4, 5.0)]
    assert [r["pos"] for r in got if r["segment"] == "related"] == []


@pytest.mark.parametrize("events", [4096, 2])
def test_folds_with_bounds(spark, monkeypatch, events):
    monkeypatch.setattr(folds, "SLICE_EVENTS", events)
    ups = [True] * 30 + [False] * 3 + [True]
    rows = spark.createDataFrame([("p", i, i, u) for i, u in enumerate(ups)], "k string, event_id int, t int, ok boolean").withColumn("ts", F.timestamp_seconds(F.col("t") * 1500))
    step = folds.step(F.when(F.col("ok"), 1.0).otherwise(0.5), F.when(F.col("ok"), 5.0).otherwise(0.0), None, F.when(F.col("ok"), 100.0).otherwise(float("inf")))
    x = 50.0
    for u in ups:
        x = min(x + 5, 100) if u else x * 0.5
    assert folds.fold(rows, ["k"], {"x": step}, {"x": 50.0}).first()["x"] == pytest.approx(x)
    assert folds.fold(rows.limit(0), ["k"], {"x": step}, {"x": 50.0}).count() == 0


def test_weight_text(spark):
    assert one(spark, profile.parse_weights(F.lit("a:1.5;b;c:x;a:2"))) == {"a": 2.0, "c": 0.0}


def test_playlist(spark):
    text = "#EXTM3U\n#EXT-X-STREAM-INF:BANDWIDTH=100\nlow.m3u8\n#EXT-X-STREAM-INF:BANDWIDTH=900\n# note\nhigh.m3u8\n#EXT-X-STREAM-INF:X=1"
    assert one(spark, P.best_variant(F.lit(text))) == "high.m3u8"
    assert one(spark, P.robots_paths(F.lit("Disallow: /a\nAllow: /b \nDisallow: /a"))) == ["/a", "/b"]


def test_json_records_are_whole_beyond_the_bounds_of_a_body(spark, tmp_path):
    rows = [(7 * i, f"Title {i}\nrest", f"l{i % 8}", "src3" if i % 9 else None, 20) for i in range(1, 700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = [(r["body_id"], r["title"], r["url"]) for r in Q.queries()["json_records"](spark, str(tmp_path)).collect()]
    first = {}
    for i, _, lang, source, _ in rows:
        first.setdefault((3 if source == "src3" else None, f"https://www.{lang}.example.com/doc-{i % 97}"), f"Title {i // 7}")
    assert len(first) > 150 and sorted(got, key=str) == sorted(((p, t, u) for (p, u), t in first.items()), key=str)


def test_stream_keeps_one_event_of_an_id_however_far_apart(spark, tmp_path):
    for i, (event, ts) in enumerate([(1, "2024-01-01 10:00:00"), (2, "2024-01-01 12:00:00"), (3, "2024-01-01 13:00:00"), (1, "2024-01-01 14:00:00"), (1, "2024-01-01 09:00:00")]):
        spark.createDataFrame([(event, ts, f"type{i}")], "event_id long, ts string, event_type string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
    events = spark.readStream.schema("event_id long, ts timestamp, event_type string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/events")
    found = stream.drain(stream.first_seen(events), "far_apart", "complete")
    assert sorted((r["event_id"], r["event_type"]) for r in found.collect()) == [(1, "type4"), (2, "type1"), (3, "type2")]
    assert found.inputFiles() and all("/sieveworks/" in f and "/far_apart-" in f for f in found.inputFiles())
    counted = stream.drain(events.select("event_id"), "appended", "append")
    assert counted.count() == 5
