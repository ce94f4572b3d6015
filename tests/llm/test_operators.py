"""The llm operators on small tables: odd rows, and brute force."""

import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sieveworks.llm import components, decontam, jaccard, langid, lm, mixing, quality, sstable, store, subwords, tokencount, toxicity, urlfilter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EN = "the cat and the dog were in the house with a ball of yarn and then some more words came along "
FR = "le chat et le chien sont dans la maison avec une pelote de laine et puis encore quelques mots "


def odd_documents(spark):
    rows = [(i, f"{EN if i % 2 else FR}{i} {i * 7}", "en" if i % 2 else "fr", f"s{i % 3}") for i in range(24)]
    rows += [(100, None, "en", "s0"), (101, "", None, None), (102, "   \n\t ", "fr", "s1"), (103, "123 --- !!", None, "s1"), (104, "word " * 30_000, "en", "s2")]
    rows += [(None, EN, None, None), (5, EN + "5 35", "en", "s2"), (5, EN + "5 35", "en", "s2"), (7, "another text under the same id", "en", None)]
    return spark.createDataFrame([(*r, None) for r in rows], DOCS)


def empty_documents(spark):
    return spark.createDataFrame([], DOCS)


def test_write_table_reads_back_the_same(spark):
    rows = spark.range(10).withColumn("x", F.array(F.col("id")))
    assert sorted(store.write_table(rows, "t").collect()) == sorted(rows.collect())


# 1: mixing


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(2 * sizes[s] for s in capped)
        target = {s: 2.0 * sizes[s] if s in capped else left * weight[s] / sum(weight[f] for f in free) for s in names}
        over = {s for s in free if target[s] > 2 * sizes[s]}
        if not over:
            return target
        capped |= over


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1, "c": 500, None: 30}, {"a": 0, "b": 5}, {"x": 7}, {f"s{i:02}": 100 + i for i in range(20)}])
def test_targets_reshare_excess(spark, sizes):
    rows = spark.createDataFrame([(s, 1, n) for s, n in sizes.items()], "source string, n_rows long, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(rows).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def test_mix_comes_near_targets_and_repeats_itself(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_A_SLICE", 20)
    rows = [(i, f"s{i % 4}" if i % 9 else None, (i * 37) % 90, 2.0 if i % 3 else 0.5, i) for i in range(600)] + [(3, "s3", 21, 1.0, 3)] * 2
    frame = spark.createDataFrame(rows, "doc_id long, source string, size long, quality double, tie long")
    first, again = (sorted(map(tuple, mixing.take_counts(frame.repartition(n)).collect()), key=repr) for n in (2, 5))
    assert first == again and len(first) == len(rows)
    taken, targets = Counter(), {}
    for r in mixing.take_counts(frame).collect():
        taken[r["source"]] += r["taken"]
        targets[r["source"]] = r["target"]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    assert all(abs(taken[s] - t) <= 45 for s, t in targets.items())


def test_mix_of_nothing(spark):
    assert mixing.take_counts(spark.createDataFrame([], "doc_id long, source string, size long, quality double, tie long")).count() == 0


# 2: toxicity


def test_toxicity_of_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1), (9999, 0)], "doc_id long, toxic int")
    chain = toxicity.train_chain(odd_documents(spark), labels, ["toxic"])
    got = toxicity.score_documents(odd_documents(spark), chain).collect()
    assert len(got) == odd_documents(spark).count() and all(0 <= r["p_toxic"] <= 1 for r in got)
    assert toxicity.score_documents(empty_documents(spark), chain).count() == 0


# 3: language identification


def test_languages_of_odd_rows(spark):
    docs = odd_documents(spark).withColumn("score", F.lit("clash"))
    got = {r["doc_id"]: r for r in langid.identify(docs, langid.train(docs)).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0.0 for i in (100, 101, 102, 103))
    assert all(got[i]["lang_pred"] == ("en" if i % 2 else "fr") for i in range(8, 24))
    assert langid.predict_languages(empty_documents(spark)).count() == 0


def test_mixed_texts_have_spans(spark):
    model = langid.train(odd_documents(spark))
    text = EN * 3 + FR * 3
    spans = langid.identify(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()["spans"]
    assert [s["lang"] for s in spans] == ["en", "fr"] and spans[0]["end"] == spans[1]["start"] and abs(spans[0]["end"] - 3 * len(EN)) < 12


# 4: token shards


def test_shards_hold_every_row_in_order(spark):
    path, tokenizer = store.fresh_path(spark, "test-shards"), public_tokenizers.path("word_bpe_49k.json")
    docs = odd_documents(spark)
    sstable.write_shards(docs, path, tokenizer, shards=3)
    got = sorted(sstable.read_digests(spark, path).collect(), key=lambda r: r["start"])
    library = subwords.load(tokenizer)
    start, wanted = 0, []
    for r in sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "")):
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        wanted.append((r["doc_id"], start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    assert [tuple(r) for r in got] == wanted
    found = sstable.lookup(spark, path, [5, 101, None, 424242]).collect()
    assert Counter(r["doc_id"] for r in found) == {5: 3, 101: 1, None: 1} and [r["ids"] for r in found if r["doc_id"] == 101] == [[2]]


@pytest.mark.parametrize("shards", [3, 4])
def test_starts_where_ids_fill_several_shards(spark, shards):
    rows = [(None, f"null {i} " + "word " * (i % 40)) for i in range(2000)] + [(i, "one two") for i in range(1500)] + [(7, "the same row")] * 1500 + [(9, f"repeated id {i}") for i in range(700)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, hash string, number int").repartition(5)
    path, tokenizer = store.fresh_path(spark, "test-shards"), public_tokenizers.path("word_bpe_49k.json")
    sstable.write_shards(docs, path, tokenizer, shards=shards)
    got = sorted(sstable.read_digests(spark, path).collect(), key=lambda r: r["start"])
    assert len(got) == len(rows)
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in got]
    assert ids == sorted(ids)
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    index = sstable.index_shards(spark, path)
    assert index.count() == shards  # no key fills one shard alone
    asked = [7, 9, 1499, None, 424242, -5]
    found = [sorted(map(repr, sstable.lookup(spark, path, asked, i).collect())) for i in (None, index)]
    assert found[0] == found[1] and len(found[0]) == 1501 + 701 + 1 + 2000
    assert sstable.lookup(spark, path, [424242], index).count() == 0


def test_shards_of_nothing(spark):
    path = store.fresh_path(spark, "test-shards")
    sstable.write_shards(empty_documents(spark), path, public_tokenizers.path("word_bpe_49k.json"), shards=2)
    assert sstable.read_digests(spark, path).count() == 0


# 5: language model


def test_scores_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(lm, "STEPS", 5)
    monkeypatch.setattr(lm, "SENT_WORDS", 8)
    docs = odd_documents(spark)
    got = lm.score_texts(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    rows = [(r["doc_id"], [*WORD.findall((r["text"] or "").lower()), None]) for r in docs.collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    counts = Counter(t for i, ts in rows if not held(i) for t in ts)
    n, v = sum(counts.values()), len(counts)
    wanted = Counter((i, held(i), len(ts), sum(t in counts for t in ts), n, round(sum(log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts), 4)) for i, ts in rows)
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == wanted
    assert all(r["score"] < 0 for r in got)
    assert lm.score_texts(empty_documents(spark), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_weights_learn_from_all_training_documents(spark, monkeypatch):
    monkeypatch.setattr(lm, "STEPS", 5)
    monkeypatch.setattr(lm, "FIRST_WINDOWS", 2)
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.createDataFrame([(i, f"word{i * 7919} river stone") for i in range(200)], "doc_id long, text string")
    scorer = lm.train_model(docs, lm.word_counts(docs), tokenizer)
    symbols, _, first, _ = lm.symbols_of(subwords.memory(tokenizer, "<i4"), pa.array([r["text"] for r in docs.collect()]))
    used = np.unique(scorer.inputs(symbols, first))
    fresh = lm.AttentionModel(scorer.vocabulary.row_class, lm.SINGLE + lm.TAILS)
    assert (scorer.model.p["embed"][used] != fresh.p["embed"][used]).any(1).all()


# 6: URL filters


def test_urls(spark):
    urls = ["http://A.example.com/en/7?x", "https://example.com/en/8", "http://b.net/de/1", "http://example.net/de/8/", "no url", None, "", "http://spam-farm.example.org/xx/1?utm_source=f#t", "https://spam-farm.example.org/xx/1/", "http://notcom/en/1"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    listed = spark.createDataFrame([("spam-farm.example.org/xx/1",), (None,), ("spam-farm.example.org/xx/1",)], "canonical string")
    got = {r["page_id"]: (r["host"], r["rule"], r["verdict"]) for r in urlfilter.judge_urls(pages, listed).collect()}
    assert got[0] == ("a.example.com", "example.com/en/7", "allow") and got[1] == ("example.com", "com/en/", "block")
    assert got[2] == ("b.net", "net/de/", "allow") and got[3] == ("example.net", "example.net/de/8", "block")
    assert all(got[i] == ("", None, "allow") for i in (4, 5, 6))
    assert got[7][2] == got[8][2] == "block" and got[9] == ("notcom", None, "allow")
    named = pages.select("*", *[F.lit(c).alias(c) for c in ("__canon", "canon", "hit", "found", "page", "__block")])
    odd = urlfilter.judge_urls(named.unionByName(named), listed)
    assert odd.columns == ["page_id", "url", "__canon", "canon", "hit", "found", "page", "__block", "host", "path", "rule", "verdict"]
    assert all((r["canon"], r["page"], r["hit"]) == ("canon", "page", "hit") and (r["host"], r["rule"], r["verdict"]) == got[r["page_id"]] for r in odd.collect()) and odd.count() == 2 * len(urls)
    assert len(got) == len(urls) and urlfilter.judge_urls(pages.limit(0), listed).count() == 0
    assert urlfilter.judge_urls(pages, listed.limit(0)).where("rule IS NULL AND verdict = 'block'").count() == 0


def test_false_positives_of_the_filter_are_removed(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "BITS_A_KEY", 1)
    rows = spark.range(4000).select(F.col("id"), F.concat(F.lit("k"), "id").alias("k"))
    got = urlfilter.listed_rows(rows, "k", rows.where("id % 40 = 0").select("k"), "hit")
    assert got.count() == 4000 and got.where("hit <> (id % 40 = 0)").count() == 0


# 7: quality rules


def brute_statistics(text):
    w = WORD.findall(text or "")
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    counts, covered, seen, dup = Counter(tri), set(), set(), 0
    for i, t in enumerate(tri):
        if counts[t] > 1:
            covered |= {i, i + 1, i + 2}
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


@pytest.mark.parametrize("few", [0, 64])
def test_statistics_equal_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(quality, "FEW", few)
    texts = [None, "", "a", "a b", "a b c a b c", "x y z\nx y z\n\nx y z q", "a a a a a", "# é| <b>\n \n \n", EN * 3 + "tail", " ".join(str(i % 7) for i in range(50))]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for r in quality.statistics(docs).collect()}
    assert got == {i: brute_statistics(t) for i, t in enumerate(texts)}


def test_outliers_go_and_others_stay(spark):
    good = [(i, " ".join(f"w{(i * 31 + k * 7) % 997}x{k}" for k in range(60 + i % 40)), "en", None, None) for i in range(80)]
    bad = [(1000 + i, " ".join(f"w{k}%%%&&&$$$" for k in range(80)), "en", None, None) for i in range(5)]
    got = {r["doc_id"]: r["kept"] for r in quality.judge_quality(spark.createDataFrame(good + bad, DOCS)).collect()}
    assert all(got[i] for i in range(80)) and not any(got[1000 + i] for i in range(5))
    assert quality.judge_quality(odd_documents(spark)).count() == odd_documents(spark).count()
    assert quality.judge_quality(empty_documents(spark)).count() == 0


@pytest.mark.parametrize("langs", [("en", "en"), ("en", None)])
def test_small_sources_are_judged_by_wider_estimates(spark, langs):
    good = [(i, " ".join(f"w{(i * 31 + k * 7) % 997}x{k}" for k in range(60 + i % 40)), langs[i % 8 == 0], f"s{i % 12}", None) for i in range(120)]
    bad = [(1000 + i, " ".join(f"w{k}%%%&&&$$$" for k in range(80)), langs[i % 2], f"s{i}" if i else "alone", None) for i in range(6)]
    got = {r["doc_id"]: (r["kept"], r["outlier"]) for r in quality.judge_quality(spark.createDataFrame(good + bad, DOCS)).collect()}
    assert len(got) == 126 and all(o is not None for _, o in got.values())
    assert all(got[i][0] for i in range(120)) and not any(got[1000 + i][0] for i in range(6))


# 8: Jaccard join


def brute_classes(docs, n, percent):
    sets = {}
    for i, t in docs:
        w = WORD.findall((t or "").lower())
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    root = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if a < b and sets[a] and 100 * both >= percent * len(sets[a] | sets[b]) and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    return {i: (len(sets[i]), root[i]) for i in sets}


@pytest.mark.parametrize(("n", "percent", "tile"), [(3, 90, 2048), (5, 80, 4), (1, 50, 3)])
def test_classes_equal_brute_force(spark, monkeypatch, n, percent, tile):
    monkeypatch.setattr(jaccard, "TILE", tile)
    base = [f"w{k}" for k in range(120)]
    docs = [(i, " ".join(w if (k * 13 + i * 7) % (11 + 9 * (i % 9)) else f"e{i}{k}" for k, w in enumerate(base[: 120 - i % 5]))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "A b"), (103, "a B"), (104, "a"), (105, docs[3][1].upper()), (106, "x " * 5000)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_rows(spark.createDataFrame(docs, "doc_id long, text string"), n, percent).collect()}
    assert got == brute_classes(docs, n, percent)


def test_jaccard_of_odd_rows(spark):
    got = jaccard.jaccard_rows(odd_documents(spark)).collect()
    assert len(got) == odd_documents(spark).count()
    assert len({r["component_id"] for r in got if r["doc_id"] == 5}) == 1
    assert jaccard.jaccard_rows(empty_documents(spark)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (2, 1)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {i: 100 for i in range(101, 140)}


# 9: token counts


def test_counts_of_odd_rows(spark):
    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    docs = odd_documents(spark)
    wanted = Counter((r["doc_id"], len((r["text"] or "").encode()), len(library.encode(r["text"] or ""))) for r in docs.collect())
    got = tokencount.count_tokens(docs, model).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == wanted
    assert all(r["over_limit"] == (r["n_tokens"] > 4096) for r in got)
    assert tokencount.count_tokens(empty_documents(spark), model).count() == 0


# 10: decontamination


def test_leaks_with_substitutions(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    w = item.split()
    changed = " ".join(["pre", "fix", *w[:6], "CHANGED", *w[7:13], "ALSO", *w[14:], "post"])
    items = spark.createDataFrame([(1, item), (2, "one two three four five six"), (3, "too short"), (4, None), (1, item)], "item_id long, text string")
    docs = [(1, f"Intro. {item.upper()}! outro"), (2, changed), (3, " ".join(w[:8])), (4, None), (5, ""), (6, "x one, two three four five six y"), (7, EN * 20), (8, " ".join(reversed(w))), (9, "too short"), (None, item), (1, f"Intro. {item.upper()}! outro")]
    got = decontam.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(1, 1), (2, 1), (6, 2), (None, 1)}
    two = next(r for r in got if r["doc_id"] == 2)
    assert (two["n_matches"], two["n_substituted"], two["doc_start"], two["item_start"]) == (18, 2, 2, 0)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.find_leaks(odd_documents(spark), none).count() == 0
    assert decontam.find_leaks(empty_documents(spark), items).count() == 0


# The pipeline


@pytest.mark.parametrize("make", [odd_documents, empty_documents])
def test_stages_take_odd_tables(spark, make):
    docs = make(spark).withColumn("__own_x", F.lit(1)).withColumn("times", F.lit(7)).withColumn("__row", F.col("doc_id")).withColumn("ROW_NUMBER", F.lit("n"))
    for name in ("__times", "__key", "__copy", "key", "doc"):
        docs = docs.withColumn(name, F.lit(f"own {name}"))
    for name, stage in corpus_pipeline.STAGES:
        out = store.write_table(stage(spark, docs, "/root/testdata/sf0.001"), f"test-{name}")
        if name != "token_shards":
            assert out.columns == docs.columns
            docs = out
    rows = docs.collect()
    assert all(r["times"] == 7 and r["__row"] == r["doc_id"] and r["ROW_NUMBER"] == "n" for r in rows)
    assert all(r[n] == f"own {n}" for r in rows for n in ("__times", "__key", "__copy", "key", "doc"))
    kept = [r["doc_id"] for r in rows]
    assert 103 not in kept and 100 not in kept
    assert out.count() == len(kept)
