"""Tables that cut lineage: written to the shared folder the session names, read back as Parquet."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where it is unset, a local default on a local master only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{os.path.join(tempfile.gettempdir(), 'sieveworks-checkpoints')}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/sieveworks/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Writes df once and returns it as a scan, so later steps neither recompute it nor depend on executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
