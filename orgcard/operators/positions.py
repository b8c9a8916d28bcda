"""Input order at scale: positions, slices and batch numbers without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orgcard.functions.text import strip

# Rows of a bucket, and the most buckets whose bounds the driver holds.
BUCKET_ROWS, BUCKETS = 1_000_000, 10_000


def clean_companies(df: DataFrame, name: str) -> DataFrame:
    """Drop missing names and trim the rest; blank names stay."""
    return df.filter(F.col(name).isNotNull()).withColumn(name, strip(F.col(name).cast("string")))


def _bucket(key: Column, bounds: list[int]) -> Column:
    """How many bounds lie below the key, found in two steps of as many comparisons as their root."""
    step = int(len(bounds) ** 0.5) + 1
    values, coarse = (F.lit(b).cast("array<bigint>") for b in (bounds, bounds[step - 1::step]))
    block = F.size(F.filter(coarse, lambda b: b < key)) * step
    rest = F.filter(F.slice(values, block + 1, F.lit(step)), lambda b: b < key)
    return block + F.size(rest)


def with_position(df: DataFrame, key: str, position: str = "pos") -> DataFrame:
    """Add the 0-based rank of a unique numeric key.

    Quantiles of the key cut it into equal buckets of about ``BUCKET_ROWS`` (their bounds come to the driver); exact
    bucket counts give offsets, and rows are numbered inside buckets.
    """
    buckets = min(BUCKETS, max(16, -(-df.count() // BUCKET_ROWS)))
    cuts = [i / buckets for i in range(1, buckets)]
    row = df.agg(F.percentile_approx(key, cuts, 2 * BUCKETS).alias("cuts")).first()
    bounds = sorted(set(row["cuts"] or [0]))
    bucketed = df.withColumn("_bucket", _bucket(F.col(key), bounds))
    offsets = (
        bucketed.groupBy("_bucket").agg(F.count("*").alias("_n"))
        # At most BUCKETS rows are left here.
        .select("_bucket", (F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")).alias("_offset"))
    )
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(key)) - 1
    return (
        bucketed.join(F.broadcast(offsets), "_bucket")
        .withColumn(position, (F.col("_offset") + inside).cast("bigint"))
        .drop("_bucket", "_offset")
    )


def slice_and_batch(
    positioned: DataFrame, start_index: int = 0, batch_size: int = 100, total_limit: int | None = None
) -> DataFrame:
    """Rows from ``start_index`` up to the end index ``total_limit`` with their batch number."""
    pos = F.col("pos")
    chosen = positioned.filter(pos >= start_index)
    if total_limit:
        chosen = chosen.filter(pos < total_limit)
    return chosen.withColumn("batch_id", batch_number(pos, start_index, batch_size))


def batch_number(pos: Column, start_index: int, batch_size: int) -> Column:
    return F.floor((pos - start_index) / batch_size).cast("int")
