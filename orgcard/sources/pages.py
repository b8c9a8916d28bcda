"""Page tables: keys, snapshots, and access to the markup of requested URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgcard.functions.urls import url_key
from orgcard.operators.storage import BROADCAST_ROWS, materialize
from orgcard.sources.dims import CACHE_DAYS


def with_url_key(pages: DataFrame) -> DataFrame:
    return pages.withColumn("url_key", url_key(F.col("url")))


def fresh(df: DataFrame, time: str, as_of: Column | None = None, days: int = CACHE_DAYS) -> DataFrame:
    """Rows no older than the cache allows at ``as_of`` (default: the newest row)."""
    if as_of is None:
        as_of = df.select(F.max(time)).scalar()
    return df.filter(F.col(time) >= as_of - F.expr(f"INTERVAL {days} DAYS"))


def latest_snapshot(df: DataFrame, key: str, time: str, tie: str, columns: list[str]) -> DataFrame:
    """Newest row per key. Partial aggregation leaves one row per key and task before the shuffle."""
    picked = F.max_by(F.struct(*columns), F.struct(time, tie))
    return df.groupBy(key).agg(picked.alias("row")).select(key, "row.*")


def page_ids(pages: DataFrame, wanted: DataFrame, small: bool) -> DataFrame:
    """One page per wanted ``url_key``: the newest snapshot, then the smallest id.

    A snapshot without markup is no page and hides no older one. The test for it reads the definition of the markup, but
    no markup is carried on. A small request table is
    broadcast before the aggregation; beyond that, pages are reduced to one row per key first, so
    that copies of one URL never meet in a join task.
    """
    has_time = "fetched_at" in pages.columns
    narrow = with_url_key(pages.filter(F.col("html").isNotNull()).select("page_id", "url", *(["fetched_at"] if has_time else [])))
    newest = F.max(F.struct(*(["fetched_at"] if has_time else []), (-F.col("page_id")).alias("neg_id")))
    if small:
        found = narrow.join(F.broadcast(wanted), "url_key")
        ids = found.groupBy(*wanted.columns).agg(newest.alias("newest"))
    else:
        ids = narrow.groupBy("url_key").agg(newest.alias("newest")).join(wanted, "url_key")
    return ids.withColumn("page_id", -F.col("newest.neg_id")).drop("newest")


def fetch(pages: DataFrame, requests: DataFrame, rows: int, **carried: Column) -> DataFrame:
    """(url_key, page_id, url, html, carried...) of the requested keys that have a page.

    ``rows`` bounds the number of requests (callers count written tables, which reads footers
    only) and so the number of ids: below the limit both sides are broadcast, above it the ids are
    written and joined by shuffle. The markup is joined on ``page_id``, which is unique: copies of
    one URL cannot pile up in a task, and a table stored with :func:`save_pages` moves no markup.
    ``carried`` are aggregates over the requests of a key.
    """
    wanted = (
        requests.groupBy("url_key").agg(*[c.alias(n) for n, c in carried.items()])
        if carried else requests.select("url_key").distinct()
    )
    small = rows <= BROADCAST_ROWS
    ids = page_ids(pages, wanted, small)
    ids = F.broadcast(ids) if small else materialize(ids, "page_ids")
    body = pages.select("page_id", "url", "html").filter(F.col("html").isNotNull())
    return body.join(ids, "page_id").select("url_key", "page_id", "url", "html", *carried)


def save_pages(pages: DataFrame, table: str, buckets: int) -> None:
    """Store pages bucketed by id, the layout that :func:`fetch` joins without moving markup."""
    (
        pages.write.mode("overwrite").format("parquet")
        .bucketBy(buckets, "page_id").sortBy("page_id").saveAsTable(table)
    )


def spread(df: DataFrame) -> DataFrame:
    """Deal rows over all cores when the input has far fewer splits than cores; else leave it alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 4 * df.rdd.getNumPartitions() <= cores else df


# Rows of a narrow table from which much is made that one task takes.
TASK_ROWS = 10_000


def spread_rows(df: DataFrame, rows: int = TASK_ROWS) -> DataFrame:
    """Deal rows evenly, so many to a task at most. How many splits a file has tells nothing of it: its rows may all lie in one
    row group and so in one split. Counting reads footers only."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows)))
