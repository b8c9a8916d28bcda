"""Ordered results in versions: a version shows once it is whole, and its files in name order hold the rows in input order.

``path/data/<version>-<run>`` holds the rows of a version, range-partitioned by their order and sorted inside; the manifest
``path/manifest/version=<version>`` names that folder and is written last. Readers follow the manifest only, so rows of a run that
broke off or is under way are never seen, and a version that is there is never changed: writing it again raises an error.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orgcard.operators.positions import BUCKET_ROWS

_MANIFEST = "folder string, n_rows bigint, n_files int, version bigint"


def write_rows(df: DataFrame, folder: str, order: str, file_rows: int = BUCKET_ROWS) -> None:
    """Rows sorted by ``order`` over files of about ``file_rows``; rows without one come first.

    The ranges follow a sample of the order, whose rows need not be unique; equal ones share a file."""
    files = max(1, -(-df.count() // file_rows))
    df.repartitionByRange(files, order).sortWithinPartitions(order).write.mode("errorifexists").parquet(folder)


def write_version(df: DataFrame, path: str, version: int, order: str, file_rows: int = BUCKET_ROWS) -> None:
    """Writes ``df``, best read from a written table as it is read three times, as a version."""
    spark, folder = df.sparkSession, f"data/{version}-{uuid.uuid4().hex}"
    write_rows(df, f"{path}/{folder}", order, file_rows)
    written = spark.read.schema(df.schema).parquet(f"{path}/{folder}")
    size = written.agg(F.count("*").alias("n_rows"), F.count_distinct("_metadata.file_path").cast("int").alias("n_files"))
    manifest = size.select(F.lit(folder).alias("folder"), "n_rows", "n_files")
    manifest.write.mode("errorifexists").parquet(f"{path}/manifest/version={version}")


def versions(spark: SparkSession, path: str) -> DataFrame:
    """(version, folder, n_rows, n_files) of the whole versions."""
    return spark.read.schema(_MANIFEST).parquet(f"{path}/manifest").select("version", "folder", "n_rows", "n_files")


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a version, the newest where none is named."""
    listed = versions(spark, path)
    if version is not None:
        listed = listed.where(F.col("version") == version)
    newest = listed.agg(F.max_by("folder", "version").alias("folder")).first()["folder"]
    if newest is None:
        raise ValueError(f"no version {'' if version is None else version} below {path}")
    return spark.read.parquet(f"{path}/{newest}")


def in_written_order(rows: DataFrame, position: str = "written_pos") -> DataFrame:
    """Rows of a version with their 0-based place in the files, one after the other in name order.

    Only one row for each file meets in one task, to sum the rows before it."""
    placed = rows.withColumns({"_file": F.col("_metadata.file_name"), "_row": F.col("_metadata.row_index")})
    sizes = placed.groupBy("_file").agg(F.count("*").alias("_n"))
    before = sizes.select("_file", F.expr("sum(_n) OVER (ORDER BY _file) - _n").alias("_before"))
    return placed.join(before, "_file").withColumn(position, (F.col("_before") + F.col("_row")).cast("bigint")).drop("_file", "_row", "_before")
