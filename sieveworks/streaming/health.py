"""Structured Streaming twins of the batch health aggregates and of session deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveworks.sources.store import fresh_path
from sieveworks.sources.tables import table


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    # A pattern, as a stream's path must not be a single file.
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def drain(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """Runs a stream over all that is available, and returns the table it wrote; its state and rows are in the shared folder."""
    spark = stream.sparkSession
    top = fresh_path(spark, name)
    out = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{top}/state").trigger(availableNow=True)
    if mode == "append":
        query = out.format("parquet").start(f"{top}/rows")
    else:  # each batch has the whole result
        query = out.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(f"{top}/rows")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{top}/rows")


def provider_counts(events: DataFrame) -> DataFrame:
    """Running counters of each provider."""
    return events.groupBy((F.col("user_id") % 10).alias("provider_id")).agg(
        F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("failed"), F.sum(F.floor(F.col("value") * 10).cast("long")).alias("ms"))


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by event type and tumbling window, final when the watermark passes a window's end."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), "event_type", "n")


def first_seen(events: DataFrame) -> DataFrame:
    """The earliest event of each id over all events, however late or often it is delivered; null times are last."""
    first = F.min(F.struct(F.col("ts").isNull().alias("untimed"), "ts", "event_type"))
    return events.groupBy("event_id").agg(first.alias("e")).select("event_id", "e.ts", "e.event_type")
