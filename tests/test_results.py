from pyspark.sql import functions as F

from orgcard import schemas
from orgcard.operators import positions, results, summary
from orgcard.plans import mining
from orgcard.sources import companies as company_source
from orgcard.sources import dims
from orgcard.sources import results as store
from orgcard.streaming import jobs


def rows(spark, *data):
    return spark.createDataFrame(list(data), schemas.CONTACTS)


def test_positions_slice_batches(spark):
    keys = [0, 5, 6, 1000, 10**12, 10**12 + 1, -7]
    df = spark.createDataFrame([(k,) for k in keys], "k bigint")
    numbered = positions.with_position(df, "k")
    assert {r["k"]: r["pos"] for r in numbered.collect()} == {k: i for i, k in enumerate(sorted(keys))}
    cut = positions.slice_and_batch(numbered, start_index=2, batch_size=2, total_limit=5)
    assert sorted((r["pos"], r["batch_id"]) for r in cut.collect()) == [(2, 0), (3, 0), (4, 1)]
    assert positions.slice_and_batch(numbered, start_index=99).count() == 0
    assert positions.with_position(df.filter("k > 1e15"), "k").count() == 0


def test_positions_of_many_rows(spark):
    df = spark.range(0, 60_000, 3).select((F.col("id") * F.col("id")).alias("k"))
    bad = positions.with_position(df, "k").filter(F.col("pos") * 3 * F.col("pos") * 3 != F.col("k"))
    assert bad.count() == 0


def test_company_lists(spark, tmp_path):
    data = [("  Acme ", 1), ("", 2), (None, 3), ("\tB\n", 4), ("Acme", 5), ("Acme", 6)]
    df = spark.createDataFrame(data, "`Company Name` string, x int").coalesce(1)
    df.write.parquet(str(tmp_path / "p"))
    got = company_source.read_companies(spark, str(tmp_path / "p"))
    assert sorted(r["company_name"] for r in got.collect()) == ["", "Acme", "Acme", "Acme", "B"]
    ids = [r["company_id"] for r in got.collect()]
    assert len(set(ids)) == 5 and ids == [r["company_id"] for r in got.collect()]
    df.write.option("header", True).csv(str(tmp_path / "c"))
    assert company_source.read_companies(spark, str(tmp_path / "c"), "csv").filter("company_name = 'Acme'").count() == 3


def test_summary_edges(spark):
    empty = rows(spark).withColumn("batch_id", F.lit(0))
    total = summary.coverage(empty, "batch_id").collect()
    assert [(r["total"], r["success_pct"]) for r in total] == [(0, None)]
    data = [(i, "n", "w" if i else "", None, "p", s) for i, s in enumerate(dims.STATUSES)]
    df = rows(spark, *data).withColumn("batch_id", F.col("company_id") % 2)
    report = {r["batch_id"]: r for r in summary.coverage(df, "batch_id").collect()}
    assert report[None]["total"] == 5 and report[None]["with_website"] == 4 and report[None]["with_phone_pct"] == 100.0
    shares = summary.status_breakdown(df, "batch_id").collect()
    assert sum(r["n"] for r in shares if r["batch_id"] is None) == 5
    assert all(r["pct"] == 20.0 for r in shares if r["batch_id"] is None)


def test_merge_loses_nothing(spark):
    old = rows(spark, (1, "a", "w", None, "p", "success"), (2, "b", "w", "e", "p", "success"), (3, "c", None, None, None, "no_website_found"))
    new = rows(spark, (1, "a", "w2", "e2", None, "success"), (2, "b", "x", "x", "x", "success"), (3, "c", None, "", None, "error"))
    assert {r["company_id"] for r in results.incomplete(old).collect()} == {1, 3}
    merged = {r["company_id"]: tuple(r)[2:] for r in results.merge_results(old, new).collect()}
    assert merged == {1: ("w", "e2", "p", "success"), 2: ("w", "e", "p", "success"), 3: (None, None, None, "error")}


def test_reprocess(spark):
    old = rows(spark, (1, "acme", None, None, None, "failed"), (2, "full", "w", "e", "p", "success"))
    serp = spark.createDataFrame([("acme", 0, 0, "https://acme.com/"), ("full", 0, 0, "https://full.com/")],
                                 "query string, engine_ord int, rank int, url string")
    pages = spark.createDataFrame([(1, "https://acme.com/", "m@acme.com")], "page_id bigint, url string, html string")
    got = {r["company_id"]: tuple(r)[2:] for r in mining.reprocess(old, serp, pages).collect()}
    assert got == {1: ("https://acme.com/", "m@acme.com", None, "success"), 2: ("w", "e", "p", "success")}


def test_results_table(spark, tmp_path):
    path = str(tmp_path / "r")
    first = rows(spark, (1, "a", None, None, None, "failed"), (2, "b", "w", "e", "p", "success"))
    second = rows(spark, (1, "a", "w", "e", None, "success"), (3, "c", None, None, None, "failed"))
    store.write_batch(first, path, 0)
    for _ in range(2):
        store.write_batch(second, path, 1)
    now = {r["company_id"]: r["status"] for r in store.read_results(spark, path).collect()}
    assert now == {1: "success", 2: "success", 3: "failed"}
    store.write_batches(second.withColumn("batch_id", F.lit(1)).filter("company_id = 3"), path)
    assert {r["company_id"]: r["status"] for r in store.read_results(spark, path).collect()}[1] == "failed"
    store.compact(spark, path, str(tmp_path / "c"))
    assert store.read_results(spark, str(tmp_path / "c")).count() == 3
    upserted = results.upsert(first, second)
    assert sorted(r["company_id"] for r in upserted.collect()) == [1, 2, 3]


def test_bytes_names(spark):
    df = spark.createDataFrame([(bytearray("Söhne".encode()),), (bytearray(b"\xff\xfe"),)], "company_name binary")
    got = results.decode_names(df).collect()
    assert [tuple(r) for r in got] == [("Söhne", None), ("FFFE", "encoding_error")]


def test_stream_equals_batch(spark, tmp_path):
    source, target, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    schema = "company_id bigint, company_name string"

    def to_results(batch):
        null = F.lit(None).cast("string")
        return results.with_status(batch.withColumns({"website": null, "email": F.col("company_name"), "phone": null}))

    def arrive(*data):
        spark.createDataFrame(list(data), schema).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(schema).parquet(source)
        jobs.upsert_stream(stream, to_results, target, check).awaitTermination()
        return {r["company_id"]: (r["email"], r["status"]) for r in store.read_results(spark, target).collect()}

    arrive((1, "a"), (2, "b"))
    assert run() == {1: ("a", "no_website_found"), 2: ("b", "no_website_found")}
    arrive((2, "bb"), (3, "c"))
    assert run() == {1: ("a", "no_website_found"), 2: ("bb", "no_website_found"), 3: ("c", "no_website_found")}
    assert len(run()) == 3  # resumes after the last batch


def test_stream_first_in_window(spark, tmp_path):
    source, day = str(tmp_path / "in"), 86_400
    batches = [[("u", 1), ("u", 2), ("v", 3)], [("u", 6 * day), ("v", 8 * day)], [("u", 7 * day + 1), ("w", 9 * day)], [("u", 30 * day), ("u", 36 * day), ("u", 37 * day)]]
    want = [("u", 1), ("v", 3), ("v", 8 * day), ("u", 7 * day + 1), ("w", 9 * day), ("u", 30 * day), ("u", 37 * day)]
    for rows in batches:
        df = spark.createDataFrame(rows, "url string, s int").select("url", F.timestamp_seconds("s").alias("at"))
        df.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    jobs.append_stream(jobs.first_in_window(stream, "url", "at"), str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "o")).select("url", F.unix_seconds(F.col("at").cast("timestamp")).alias("s"))
    assert sorted(map(tuple, got.collect())) == sorted(want)
