"""Result rows: status, gaps, merges, upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = ["website", "email", "phone"]
COLUMNS = ["company_id", "company_name", *FIELDS, "status"]


def with_status(contacts: DataFrame) -> DataFrame:
    """``success`` for every company with a website, found values or not."""
    status = F.when(F.col("website").isNull(), "no_website_found").otherwise("success")
    return contacts.withColumn("status", status)


def decode_names(df: DataFrame, raw: str = "company_name") -> DataFrame:
    """Names that arrive as bytes: UTF-8 text, or their hex form with status ``encoding_error``."""
    text = F.try_validate_utf8(F.col(raw).cast("string"))
    return df.withColumn("status", F.when(text.isNull(), "encoding_error")).withColumn(
        raw, F.coalesce(text, F.hex(raw))
    )


def _missing(name: str):
    return F.coalesce(F.col(name) == "", F.lit(True))


def incomplete(results: DataFrame) -> DataFrame:
    """Rows that lack website, e-mail or phone."""
    return results.filter(_missing("website") | _missing("email") | _missing("phone"))


def merge_results(old: DataFrame, new: DataFrame) -> DataFrame:
    """New values close the gaps of old rows; nothing that was there is lost."""
    fresh = new.select(
        "company_id", *[F.nullif(F.col(f), F.lit("")).alias(f"new_{f}") for f in FIELDS],
        F.col("status").alias("new_status"),
    )
    joined = old.join(fresh, "company_id", "left")
    filled = [
        F.coalesce(F.nullif(F.col(f), F.lit("")), F.col(f"new_{f}")).alias(f) for f in FIELDS
    ]
    website = F.coalesce(F.nullif(F.col("website"), F.lit("")), F.col("new_website"))
    status = F.when(website.isNotNull(), "success").otherwise(F.coalesce("new_status", "status"))
    return joined.select("company_id", "company_name", *filled, status.alias("status"))


def upsert(old: DataFrame, new: DataFrame, key: str = "company_id") -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same key."""
    return old.join(new, key, "left_anti").unionByName(new)


def latest_batch(results: DataFrame, key: str = "company_id") -> DataFrame:
    """Newest row per key of appended batches (``batch_id``)."""
    columns = [c for c in results.columns if c != key]
    picked = F.max_by(F.struct(*columns), F.col("batch_id"))
    return results.groupBy(key).agg(picked.alias("row")).select(key, "row.*")
