"""Importance resampling against brute force."""

import hashlib
import re
import zlib
from collections import Counter
from math import floor, log

import pytest
from pyspark.sql import functions as F

from sieveworks.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ROWS = "doc_id long, text string, key string, place int, at int"


def features(text, orders):
    words = WORD.findall((text or "").translate(UPPER))
    return len(words), [" ".join(words[i : i + k]) for k in range(1, orders + 1) for i in range(len(words) - k + 1)]


def brute(docs, target, orders, buckets, percent, least_words):
    of = lambda f: zlib.crc32(f.encode()) % buckets
    own = [(i, *features(t, orders)) for i, t in docs]
    s, t = Counter(of(f) for _, _, fs in own for f in fs), Counter(of(f) for x in target for f in features(x, orders)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: floor(1000 * log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in s}
    rows = []
    for i, n, fs in own:
        weight = sum(gain[of(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(fs), weight, weight + floor(-1000 * log(-log((h + 0.5) / 4294967296))), n >= least_words))
    order = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = order[: len(order) * percent // 100]
    return sorted([(*r[:4], k + 1) for k, r in enumerate(drawn)] + [(*r[:4], None) for r in order[len(drawn) :]] + [(*r[:4], None) for r in rows if not r[4]], key=str)


def documents(spark):
    texts = [f"The quick {'brown fox ' * (i % 7)} jumps-over {i * 37 % 11} Ünïcode ß {'lazy dogs ' * (i % 3)}" for i in range(40)]
    rows = list(enumerate(texts)) + [(100, None), (101, ""), (102, " \n--"), (103, "word " * 20_000), (None, "no id but words and words"), (5, texts[5]), (5, texts[5]), (6, "other text of the same id")]
    return rows, spark.createDataFrame([(*r, "k", 1, 2) for r in rows], ROWS)


@pytest.mark.parametrize(("orders", "buckets", "percent", "least"), [(1, 10_000, 10, 5), (1, 13, 50, 0), (2, 1000, 30, 8), (3, 1 << 20, 100, 1)])
def test_resample_equals_brute_force(spark, orders, buckets, percent, least):
    rows, docs = documents(spark)
    target = ["the lazy dogs are quick", "a fox jumps over", None, ""]
    got = importance.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), orders, buckets, percent, least)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, target, orders, buckets, percent, least)


def test_resample_of_empty_tables(spark):
    _, docs = documents(spark)
    none = spark.createDataFrame([], "text string")
    assert importance.resample(docs.limit(0), none).collect() == []
    rows = importance.resample(docs.where("doc_id < 40"), none, least_words=1).collect()
    assert sum(r["rank"] is not None for r in rows) == len(rows) * 10 // 100


def test_ranked_numbers_rows_over_all_ranges(spark):
    rows = spark.range(5000).select(F.pmod(F.xxhash64("id"), F.lit(50)).alias("score"), "id").repartition(7)
    got = [(r["score"], r["id"]) for r in importance.ranked(rows, F.desc("score"), F.asc("id")).orderBy("place").collect()]
    assert got == sorted(got, key=lambda r: (-r[0], r[1])) and len(got) == 5000
