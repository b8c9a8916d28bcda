"""Results table: one partition per batch, newest row per company on read.

Writing a batch replaces its own partition only, so a repeated batch changes nothing and earlier
batches are never rewritten; ``compact`` folds them into one when there are many.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orgcard import schemas
from orgcard.operators.results import COLUMNS, latest_batch

_SCHEMA = schemas.CONTACTS + ", batch_id bigint"


def write_batch(results: DataFrame, path: str, batch_id: int) -> None:
    (
        results.select(*COLUMNS).write.mode("overwrite")
        .parquet(f"{path}/batch_id={batch_id}")
    )


def write_batches(results: DataFrame, path: str) -> None:
    """Write rows that carry ``batch_id``, replacing exactly the batches they belong to."""
    (
        results.select(*COLUMNS, "batch_id").write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)
    )


def read_all(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_SCHEMA).parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """One row per company, from its newest batch."""
    return latest_batch(read_all(spark, path)).select(*COLUMNS)


def compact(spark: SparkSession, path: str, target: str) -> None:
    """Write the current rows as a new table, keeping their batch numbers."""
    latest_batch(read_all(spark, path)).withColumn(
        "batch_id", F.col("batch_id").cast("bigint")
    ).write.partitionBy("batch_id").parquet(target)
