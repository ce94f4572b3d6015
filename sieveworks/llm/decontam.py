"""Benchmark decontamination: spaced seeds find passages that share most words; an alignment around each hit confirms them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveworks.llm.store import write_table

#: Fixed masks over consecutive tokens: 1 is hashed, 0 may differ. Together they find every stretch with 12 equal tokens
#: in which at most one token of five differs, wherever the differences are.
MASKS = ("1101100111", "1011011011", "1110010111", "111101111", "11110011", "111111", "1111101", "1011111")
#: Shorter benchmark texts are looked for as a whole, if they have this many tokens.
LEAST_TOKENS = 5
#: An alignment earns 1 for an equal token and loses 2 for a different one; a passage is the best stretch of that.
MISMATCH, LEAST_MATCHES = 2, 12
#: Seeds of the benchmark (about 50 bytes each) that are sent to the executors at once; more go in blocks.
BROADCAST_SEEDS = 400_000


def tokens(text: Column) -> Column:
    """64-bit hashes of the lower-cased runs of letters and digits."""
    runs = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    return F.transform(runs, lambda t: F.xxhash64(t))


def _seed(h: Column, at: Column, number: int, mask: str) -> Column:
    """The hash of the masked tokens from a place on; null if the mask passes the end."""
    picked = [F.get(h, at + i) for i, m in enumerate(mask) if m == "1"]
    return F.when(at + len(mask) <= F.size(h), F.xxhash64(F.lit(number), *picked))


def _seeds(rows: DataFrame, masks: list[str]) -> DataFrame:
    """rows (with h) for each place and mask that fits: at, seed."""
    shortest = min(map(len, masks))
    placed = rows.where(F.size("h") >= shortest).withColumn("at", F.explode(F.sequence(F.lit(0), F.size("h") - shortest)))
    hashes = [_seed(F.col("h"), F.col("at"), len(m) * 1000 + i if "0" in m else len(m), m) for i, m in enumerate(masks)]
    seeded = placed.withColumn("seed", F.explode(F.array(*hashes)) if len(hashes) > 1 else hashes[0])
    return seeded.where(F.col("seed").isNotNull())


def _best_stretch(doc: Column, item: Column) -> Column:
    """The best-scored stretch of two arrays laid side by side: struct(score, matches, start, end)."""
    zero = F.lit(0)
    first = F.struct(*[zero.alias(c) for c in ("at", "run", "hits", "since", "score", "matches", "start", "end")])

    def step(a: Column, same: Column) -> Column:
        fresh = a["run"] <= 0
        run = F.when(same, 1).otherwise(-MISMATCH) + F.when(fresh, 0).otherwise(a["run"])
        hits = F.when(same, 1).otherwise(0) + F.when(fresh, 0).otherwise(a["hits"])
        since = F.when(fresh, a["at"]).otherwise(a["since"])
        better = run > a["score"]
        pick = lambda new, old: F.when(better, new).otherwise(a[old]).alias(old)
        return F.struct((a["at"] + 1).alias("at"), run.alias("run"), hits.alias("hits"), since.alias("since"), pick(run, "score"), pick(hits, "matches"), pick(since, "start"), pick(a["at"] + 1, "end"))

    return F.aggregate(F.zip_with(doc, item, lambda x, y: F.coalesce(x == y, F.lit(False))), first, step)


def find_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs: doc_id, text. items: item_id, text. A row for each pair that shares a passage: doc_id, row_hash (of the text),
    item_id, n_matches, n_substituted, doc_start and item_start (in tokens).

    A passage is a stretch without insertions, found by at least one seed, with 12 equal tokens (all of an item that
    has fewer, if 5 at least) and a score above 0, that is, about two tokens equal for each that is not. The best one
    of a pair is returned. Null and empty texts share nothing; shorter items are left out; rows of one id and text are
    one document. The benchmark is sent to the tasks in blocks of a fixed size, and documents are hashed where they
    are read; only the hits of one document and alignment meet in a shuffle, after map-side combination."""
    bench = items.select("item_id", tokens(F.col("text")).alias("h")).where(F.size("h") >= LEAST_TOKENS)
    bench = write_table(bench.dropDuplicates(["item_id", "h"]), "bench-items")
    longest = max(map(len, MASKS))
    short = [r[0] for r in bench.where(F.size("h") < longest).select(F.size("h").alias("n")).distinct().collect()]
    masks = [*MASKS, *("1" * n for n in sorted(short))]
    seeds = _seeds(bench, list(MASKS)) if not short else _seeds(bench.where(F.size("h") >= longest), list(MASKS))
    seeds = seeds.select("seed", "item_id", F.col("at").alias("item_at"), F.size("h").alias("item_size"), F.xxhash64("h").alias("item_hash"))
    for n in short:
        whole = bench.where(F.size("h") == n).select(_seed(F.col("h"), F.lit(0), n, "1" * n).alias("seed"), "item_id", F.lit(0).alias("item_at"), F.lit(n).alias("item_size"), F.xxhash64("h").alias("item_hash"))
        seeds = seeds.unionByName(whole)
    seeds = write_table(seeds, "bench-seeds")
    blocks = max(1, -(-seeds.count() // BROADCAST_SEEDS))
    rows = docs.select(F.col("doc_id"), F.xxhash64("text").alias("row_hash"), tokens(F.col("text")).alias("h"))
    placed = _seeds(rows, masks)
    hits = None
    for b in range(blocks):
        part = seeds if blocks == 1 else seeds.where(F.pmod(F.xxhash64("seed", F.lit(b"block")), F.lit(blocks)) == b)
        found = placed.join(F.broadcast(part), "seed")
        shift = F.col("at") - F.col("item_at")
        # The stretch of the document beside the whole item; what lies before the document's start is left out of both.
        beside = F.slice("h", F.greatest(shift, F.lit(0)) + 1, F.col("item_size") + F.least(shift, F.lit(0)))
        found = found.select("doc_id", "row_hash", "item_id", "item_hash", shift.alias("shift"), beside.alias("beside"))
        hits = found if hits is None else hits.unionByName(found)
    aligned = hits.groupBy("doc_id", "row_hash", "item_id", "item_hash", "shift").agg(F.first("beside").alias("beside"))
    texts = bench.select(F.col("item_id").alias("own_id"), F.xxhash64("h").alias("own_hash"), "h")
    joined = aligned.join(texts, F.col("item_id").eqNullSafe(F.col("own_id")) & (F.col("item_hash") == F.col("own_hash")))
    skipped = F.greatest(-F.col("shift"), F.lit(0))
    item = F.slice("h", skipped + 1, F.size("beside"))
    best = joined.withColumn("best", _best_stretch(F.col("beside"), item)).withColumn("skipped", skipped)
    enough = (F.col("best.matches") >= F.least(F.lit(LEAST_MATCHES), F.size("h"))) & (F.col("best.score") > 0)
    passages = best.where(enough).select(
        "doc_id", "row_hash", "item_id",
        F.struct(
            F.col("best.score").alias("score"),
            F.col("best.matches").alias("n_matches"),
            (F.col("best.end") - F.col("best.start") - F.col("best.matches")).alias("n_substituted"),
            (F.greatest(F.col("shift"), F.lit(0)) + F.col("best.start")).alias("doc_start"),
            (F.col("skipped") + F.col("best.start")).alias("item_start"),
        ).alias("passage"),
    )
    return passages.groupBy("doc_id", "row_hash", "item_id").agg(F.max("passage").alias("p")).select("doc_id", "row_hash", "item_id", "p.n_matches", "p.n_substituted", "p.doc_start", "p.item_start")
