"""Cutting lineage and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Rows of narrow key tables that may be broadcast: some 20 MB of URLs, 400 MB of the longest ones.
BROADCAST_ROWS = 200_000


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: the one of the cluster, a fresh local one where unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = tempfile.mkdtemp(prefix="orgcard-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a derived table to the shared folder and read it back.

    The written files survive lost executors, cut the lineage and carry sizes for the planner.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

