"""Tables that cut lineage: written to the shared folder the session names, read back as Parquet."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where it is unset, a local default on a local master only."""
    folder, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if folder:
        return folder.rstrip("/")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{os.path.join(tempfile.gettempdir(), 'sieveworks-checkpoints')}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/sieveworks/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Writes df once and returns it as a scan, so later steps neither recompute it nor depend on executors.

    Sorted numbers take next to no space in its files, so their size says little of its rows: joins on what is drawn from it
    shuffle, unless the other side is broadcast by name, and no table is gathered by the driver because its files are small."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return shuffled(df.sparkSession.read.schema(df.schema).parquet(path))


def shuffled(df: DataFrame) -> DataFrame:
    """df, whose joins shuffle unless the other side is broadcast by name. What a join gives has lost this mark of its sides: without
    it, Spark would send rows that are narrow where they are shuffled, and large on the driver, to all through the driver."""
    return df.hint("merge")
