"""Larger tables: folders of files, joins and tasks that do not grow with the table."""

import pytest

from orgcard.plans.queries import registry

SF_DIR = "/root/testdata/sf0.001"


def test_documents_stream_from_a_folder_of_files(spark, tmp_path):
    spark.read.parquet(f"{SF_DIR}/documents.parquet").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    query = registry()["stream_results"]
    rows = lambda path: sorted(map(repr, query(spark, str(path)).collect()))
    assert rows(tmp_path) == rows(SF_DIR) != []


@pytest.mark.parametrize("name", ["common_path_probe", "sitemap_pages", "directory_website"])
def test_pages_and_links_to_them_are_not_broadcast(spark, plan, name):
    assert "BroadcastHashJoin [url" not in (text := plan(registry()[name](spark, SF_DIR))) and "SortMergeJoin" in text
    assert "BroadcastHashJoin [sitemap" not in text


def test_rows_of_one_row_group_are_dealt_over_tasks(spark, tmp_path):
    """A file of many splits may have all its rows in one."""
    from pyspark.sql import functions as F

    from orgcard.plans import derived
    from orgcard.sources import pages

    customer = spark.read.parquet(f"{SF_DIR}/customer.parquet")
    customer.crossJoin(spark.range(200)).drop("id").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    n = customer.count() * 200
    conf = {"spark.sql.files.openCostInBytes": "1k", "spark.sql.files.maxPartitionBytes": "4k"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        rows = derived.card_pages(spark, str(tmp_path), "section").groupBy(F.spark_partition_id()).count().collect()
    finally:
        for k in conf:
            spark.conf.unset(k)
    assert sum(r["count"] for r in rows) == n and max(r["count"] for r in rows) <= min(pages.TASK_ROWS, n // 4)


def test_trees_are_handed_back_a_few_pages_at_a_time():
    """A worker is given 10,000 pages at a time; their trees are many times as large."""
    import pyarrow as pa

    from orgcard.functions import tree as T

    html = ["<p>a<b>c</b></p>", None, "<![broken[ x ]]>", ""] * 300
    parts = list(T._shred.func(iter([pa.array(html[:1100]), pa.array(html[1100:]), pa.array([], pa.string())])))
    rows = pa.concat_arrays(parts).to_pylist()
    assert max(map(len, parts)) <= T.PAGES and len(rows) == len(html)
    assert [r["error"] is not None for r in rows[:4]] == [False, False, True, False] and rows[1]["nodes"] is None
    assert [n["tag"] for n in rows[-4]["nodes"]] == ["p", "#text", "b", "#text"]
