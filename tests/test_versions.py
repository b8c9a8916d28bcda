import pytest
from pyspark.sql import functions as F

from orgcard.sources import versions


def test_files_in_name_order_give_input_order(spark, tmp_path):
    path = str(tmp_path / "v")
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5000).alias("pos"), F.col("id").cast("string").alias("name"))
    df = df.unionByName(spark.createDataFrame([(None, "none"), (4999, "again")], "pos bigint, name string")).repartition(5)
    versions.write_version(df, path, 0, "pos", file_rows=700)
    told = versions.versions(spark, path).first()
    assert told.n_rows == 5002 and told.n_files > 4
    files = sorted((tmp_path / "v" / told.folder).glob("part-*.parquet"))
    read = [r.pos for f in files for r in spark.read.parquet(str(f)).select("pos").collect()]
    assert read == [None, *range(5000), 4999]
    placed = versions.in_written_order(versions.read_version(spark, path)).orderBy("written_pos").collect()
    assert [r.written_pos for r in placed] == list(range(5002)) and [r.pos for r in placed] == read


def test_only_whole_versions_show(spark, tmp_path):
    path = str(tmp_path / "v")
    df = spark.range(3).withColumnRenamed("id", "pos")
    versions.write_version(df, path, 0, "pos")
    versions.write_rows(df.limit(0), f"{path}/data/1-broken", "pos")  # broke off before its manifest
    assert versions.read_version(spark, path).count() == 3
    versions.write_version(df.where("pos > 0"), path, 1, "pos")
    assert versions.read_version(spark, path).count() == 2 and versions.read_version(spark, path, 0).count() == 3
    with pytest.raises(Exception, match="(?i)exist"):
        versions.write_version(df, path, 1, "pos")
    with pytest.raises(ValueError):
        versions.read_version(spark, path, 9)
    versions.write_version(df.limit(0), path, 2, "pos")
    assert versions.read_version(spark, path).columns == ["pos"] and versions.read_version(spark, path).count() == 0
