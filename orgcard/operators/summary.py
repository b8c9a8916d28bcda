"""Coverage statistics of results, per batch and in total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _filled(name: str) -> Column:
    return F.count_if(F.coalesce(F.col(name) != "", F.lit(False)))


def percent(part: str, total: Column) -> Column:
    """Share in percent with one decimal, NULL of nothing."""
    return F.round(F.try_divide(100.0 * F.col(part), total), 1)


def coverage(results: DataFrame, by: str) -> DataFrame:
    """Counts and shares per value of ``by`` and for all rows (``by`` NULL)."""
    parts = ["success", "with_website", "with_email", "with_phone"]
    counts = results.groupBy(by).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "success").alias("success"),
        _filled("website").alias("with_website"),
        _filled("email").alias("with_email"),
        _filled("phone").alias("with_phone"),
    )
    # The total comes from the counts, so that no rows at all still give a row of zeros.
    names = ["total", *parts]
    total = counts.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
    total = total.select(F.lit(None).cast(results.schema[by].dataType).alias(by), *names)
    return counts.unionByName(total).select(
        by, *names, *[percent(p, F.col("total")).alias(f"{p}_pct") for p in parts]
    )


def status_breakdown(results: DataFrame, by: str) -> DataFrame:
    """Count and share of each status per value of ``by`` and for all rows (``by`` NULL)."""
    counts = results.groupingSets([[by, "status"], ["status"]], by, "status").agg(
        F.count("*").alias("n")
    )
    # A window over the aggregate: as many rows per group as there are statuses.
    total = F.sum("n").over(Window.partitionBy(by))
    return counts.select(by, "status", "n", percent("n", total).alias("pct"))
