"""Company lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orgcard.operators.positions import clean_companies


def read_companies(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """(company_id, company_name): the first column is the name, whatever its header.

    A ``company_id`` column is taken as the key where there is one. Else the key is a hash of the
    name and its number among equal names: rows are their names alone, so equal ones may swap their
    numbers, and any re-read, with any splits, gives the same keys.
    """
    reader = spark.read
    df = reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)
    name = F.col(df.columns[0]).alias("company_name")
    if "company_id" in df.columns[1:]:
        return clean_companies(df.select("company_id", name), "company_name")
    named = clean_companies(df.select(name), "company_name")
    number = F.row_number().over(Window.partitionBy("company_name").orderBy(F.lit(0)))
    return named.select(F.xxhash64("company_name", number).alias("company_id"), "company_name")
