"""A corpus pipeline of five stages; each reads what the one before it kept, as written to Parquet."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveworks.llm import decontam, jaccard, langid, mixing, sstable
from sieveworks.llm.store import fresh_path, write_table
from sieveworks.llm.text import word_count

#: A document stays if so much of it is in one language.
LEAST_SHARE = 0.5
#: Near duplicates share 80% of their five-word shingles.
SHINGLE, PERCENT = 5, 80
#: Rows of two longs that are sent to all executors; beyond it the join shuffles.
BROADCAST_ROWS = 500_000


def _keyed(docs: DataFrame) -> DataFrame:
    """key and doc: doc holds all columns of a row of docs, whatever their names; key tells rows apart: doc_id where no id is
    null or repeated, else a number of the row."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    if not jaccard.ids_repeat(docs):
        return packed.select(F.col("doc.doc_id").cast("long").alias("key"), "doc")
    return write_table(packed.select(F.monotonically_increasing_id().alias("key"), "doc"), "numbered")


def _joined(keyed: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """keyed joined with rows (key, and columns not named doc)."""
    return keyed.join(F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows, "key", how)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (null and empty ones too) and those of which no language has LEAST_SHARE of the
    words. A null lang does not matter; the model learns from the labelled documents of this input. Repeated rows are
    judged alike, ties between languages fall alike, very long texts are judged whole; other columns are kept, whatever their names."""
    model = langid.train(docs)
    labelled = langid.identify(docs.withColumnsRenamed({c: f"__own_{c}" for c in docs.columns if c != "text"}), model)
    kept = labelled.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE))
    return kept.select(*[F.col("text" if c == "text" else f"__own_{c}").alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates one row stays: that of the least doc_id, or the first row as stored where ids are null or repeat.
    Rows without words link with nothing and stay. Equal rows are near duplicates like others; very long texts are compared
    whole; other columns are kept, whatever their names."""
    keyed = _keyed(docs)
    found = jaccard.jaccard_classes(keyed.select(F.col("key").alias("id"), F.col("doc.text").alias("text")), SHINGLE, PERCENT)
    gone = write_table(found.where("id <> component").select(F.col("id").alias("key")), "gone")
    return _joined(keyed, gone, "left_anti").select("doc.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that share a passage with a benchmark text. Null and empty texts share nothing and stay;
    repeated rows go or stay together; very long texts are searched whole; an empty benchmark drops nothing; other columns
    are kept, whatever their names."""
    keyed = _keyed(docs)
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    leaks = decontam.find_leaks(keyed.select(F.col("key").alias("doc_id"), F.col("doc.text").alias("text")), bench)
    gone = write_table(leaks.select(F.col("doc_id").alias("key")).distinct(), "gone")
    return _joined(keyed, gone, "left_anti").select("doc.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each row as often as the mix takes it; those that it takes 0 times go. Null sources are one source; rows
    without words are free; equal rows are taken each for itself, ties fall by id and text; very long texts count whole;
    other columns are kept, whatever their names."""
    keyed = _keyed(docs)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality").where("doc_id IS NOT NULL AND quality IS NOT NULL")
    weights = labels.groupBy(F.col("doc_id").alias("label_id")).agg(F.when(F.max("quality") >= 1, 2.0).otherwise(0.5).alias("quality"))
    text = F.col("doc.text")
    rows = keyed.select(F.col("doc.doc_id").alias("doc_id"), F.col("doc.source").alias("source"), word_count(text).alias("size"), mixing.text_tie(text).alias("tie"), "key")
    rows = rows.join(weights, F.col("doc_id") == F.col("label_id"), "left")
    rows = rows.select("doc_id", "source", "size", "tie", F.coalesce("quality", F.lit(1.0)).alias("quality"), "key")
    taken = write_table(mixing.take_counts(rows).where("times > 0").select("key", "times"), "taken")
    mixed = _joined(keyed, taken, "inner").select("doc", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return mixed.select("doc.*")


def write_token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes all rows as token shards and returns what a reader finds in them, a row for each. Null and empty texts have the
    end id alone; repeated rows are repeated entries, and so may go on in the next shard; a very long text is one entry; other
    columns are not written."""
    path = fresh_path(spark, "pipeline-shards")
    sstable.write_shards(docs.select("doc_id", "text"), path, public_tokenizers.path("word_bpe_49k.json"))
    return sstable.read_digests(spark, path)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("token_shards", write_token_shards),
]

#: Language identification and the Jaccard join have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = write_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
