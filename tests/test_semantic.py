"""Terms found by the automaton and relevance to concepts, against plain containment."""

import random

import pytest
from pyspark.sql import functions as F

from sieveworks.functions import language as L
from sieveworks.functions import querytext as N
from sieveworks.operators import semantic


@pytest.mark.parametrize("window", [2048, 5])
def test_terms_are_found_wherever_they_stand(monkeypatch, window):
    monkeypatch.setattr(semantic, "WINDOW", window)
    rng = random.Random(1)
    terms = sorted({"".join(rng.choices("abcé😀 ", k=rng.randint(1, 6))) for _ in range(80)} | {"a", "aa", "aab", "ba"})
    texts = ["", None, "aab", "😀" * 40] + ["".join(rng.choices("abcéx😀 ", k=rng.randint(0, 90))) for _ in range(200)]
    row, term = semantic.TermFinder(terms)(texts)
    assert sorted(zip(row.tolist(), term.tolist())) == [(i, j) for i, t in enumerate(texts) for j, w in enumerate(terms) if w in (t or "")]


def test_no_terms_and_no_texts():
    assert [len(x) for x in semantic.TermFinder([])(["a"])] == [0, 0] and [len(x) for x in semantic.TermFinder(["", "b"])([])] == [0, 0]


def brute(title, description, concepts):
    t, d = (title or "").lower(), (description or "").lower()
    score = 0
    for kind, term in concepts:
        if kind in ("emotion", "context"):
            score += semantic.POINTS[kind][2] * (term in f"{t} {d}")
        else:
            score += semantic.POINTS[kind][0] if term in t else semantic.POINTS[kind][1] if term in d else 0
    return float(min(100, score))


RESULTS = [(1, "Funny CAT film", "a dog looks"), (2, None, "old house and a cat"), (3, "happy", "home"), (4, "joyful", None), (5, "nothing", ""), (6, "cat cat movie short film funny locate house glad kitchen", "x" * 5000 + "dog")]


@pytest.mark.parametrize("block", [20_000, 2])
def test_relevance_equals_containment(spark, monkeypatch, block):
    monkeypatch.setattr(semantic, "BLOCK_TERMS", block)
    asked = {7: [("subject", "cat"), ("subject", "movie"), ("subject", "cat"), ("action", "look"), ("descriptor", "funny"), ("emotion", "joyful"), ("context", "y h"), ("compound", "short film")], 8: [("compound", "a dog"), ("emotion", "happy home")]}
    concepts = spark.createDataFrame([(q, *c, "x") for q, listed in asked.items() for c in listed] + [(9, "subject", None, "x"), (9, "other", "cat", "x"), (9, "subject", "", "x")], "query_id long, kind string, term string, score string")
    results = spark.createDataFrame([(*r, "extra") for r in RESULTS], "pos long, title string, description string, term string")
    got = {(r["query_id"], r["pos"]): r["score"] for r in semantic.semantic_relevance(results, concepts).collect()}
    expected = {(q, p): s for q, listed in asked.items() for p, t, d in RESULTS if (s := brute(t, d, listed))}
    assert got == expected and got[7, 6] == 100


def test_relevance_to_a_processed_query(spark):
    lexicon = L.Lexicon(verbs=("find",), nouns=("cat", "film"), thesaurus={"film": ("movie", "picture")})
    query = spark.createDataFrame([("find a funny film",)], "q string").select(L.concepts(N.query_tokens(F.col("q")), F.col("q"), lexicon).alias("c"))
    words = {k: query.select(F.explode(f"c.{c}").alias("w")) for k, c in (("subject", "subjects"), ("action", "actions"), ("descriptor", "descriptors"))}
    rows = None
    for kind, found in words.items():
        part = found.select(F.lit(1).alias("query_id"), F.lit(kind).alias("kind"), F.explode(F.concat(F.array("w"), L.related(F.col("w"), lexicon))).alias("term"))
        rows = part if rows is None else rows.unionByName(part)
    listed = [(r["kind"], r["term"]) for r in rows.collect()]
    assert ("subject", "movie") in listed and ("descriptor", "funny") in listed
    got = {r["pos"]: r["score"] for r in semantic.semantic_relevance(spark.createDataFrame(RESULTS, "pos long, title string, description string"), rows).collect()}
    assert got == {p: s for p, t, d in RESULTS if (s := brute(t, d, listed))}


def test_relevance_of_empty_tables(spark):
    none, concepts = spark.createDataFrame([], "pos long, title string, description string"), spark.createDataFrame([(1, "subject", "a")], "query_id long, kind string, term string")
    assert semantic.semantic_relevance(none, concepts).count() == 0
    assert semantic.semantic_relevance(spark.createDataFrame(RESULTS, none.schema), concepts.limit(0)).count() == 0
