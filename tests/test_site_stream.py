"""Sites mined page by page: after each micro-batch the same as one run over all pages that have arrived."""

import pytest
from pyspark.sql import functions as F

from orgcard.plans import mining
from orgcard.streaming import sites as site_jobs
from tests.test_pagestore import SITES, WANT
from tests.test_sites import site_keys

PAGES = "page_id bigint, url string, html string, fetched_at timestamp_ntz, extra int"
COLUMNS = ["site_key", "email", "phone", "email_method", "phone_method", "broken"]
KEYS = [*WANT, "https://gone.com", "https://shared.com"]


def page_rows(rows, start=0, day=1):
    return [(start + i, u, h, f"2024-01-{day:02}", i) for i, (u, h) in enumerate(rows)]


class Site:
    """One stream over files that are added one by one."""

    def __init__(self, spark, folder):
        self.spark, self.folder = spark, folder
        self.sites = site_keys(spark, *KEYS, None, KEYS[0])

    def frame(self, rows):
        typed = self.spark.createDataFrame(rows, PAGES.replace("timestamp_ntz", "string"))
        return typed.withColumn("fetched_at", F.col("fetched_at").cast("timestamp_ntz"))

    def arrive(self, rows):
        self.frame(rows).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")

    def run(self):
        arriving = self.spark.readStream.schema(PAGES).option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/in")
        site_jobs.site_stream(arriving, self.sites, f"{self.folder}/tables", f"{self.folder}/check").awaitTermination()
        return sorted(map(tuple, site_jobs.read_sites(self.spark, f"{self.folder}/tables").select(*COLUMNS).collect()))

    def whole(self, rows):
        mined = mining.mine_sites(self.frame(rows), self.sites.dropna().distinct())
        return sorted(map(tuple, mined.select(*COLUMNS).collect()))

    def touched(self, batch_id):
        return {r.site_key for r in self.spark.read.parquet(f"{self.folder}/tables/sites/batch_id={batch_id}").collect()}


@pytest.fixture
def site(spark, tmp_path):
    return Site(spark, str(tmp_path))


def test_any_order_of_arrival(site):
    """Frames before pages, pages before homepages; extra columns; sites that are null or listed twice."""
    rows = page_rows(SITES)[::-1]
    site.arrive(rows[:6])
    site.arrive(rows[6:])
    assert {r[0]: r[1] for r in site.run()} == WANT


def test_each_part_equals_one_run(site, tmp_path):
    first = page_rows([
        *SITES, ("https://shared.com/", '<iframe src="https://f.com/1"></iframe><a href="https://a.com/contact">x</a>'),
        ("https://none.com/", "none@acme.com"), ("no address", "x"), (None, "x"), ("https://gone.com/", None)])
    # a newer frame, and a homepage that says nothing any more
    second = page_rows([("https://f.com/1", "<p>newer@acme.com</p>"), ("https://b.com/", "")], 100, 5)
    # an older page that comes late, a snapshot without markup, a page that breaks off
    third = page_rows([("https://f.com/1", "<p>older@acme.com</p>"), ("https://a.com/contact", None)], 200, 3)
    third += page_rows([("https://gone.com/", "<nav><p>last@acme.com</p><![x[")], 300, 6)
    seen = []
    for n, part in enumerate([first, second, third]):
        seen += part
        site.arrive(part)
        got = site.run()
        assert got == site.whole(seen), n
    assert site.touched(1) == {"https://a.com", "https://shared.com", "https://b.com"}
    assert site.touched(2) == {"https://a.com", "https://shared.com", "https://gone.com"}
    # the last part was not marked as done: it is replayed and ends as it did
    for mark in ("2", ".2.crc"):
        (tmp_path / "check" / "commits" / mark).unlink(missing_ok=True)
    assert site.run() == got


def test_nothing_arrives(site):
    site.arrive([])
    assert site.run() == []
