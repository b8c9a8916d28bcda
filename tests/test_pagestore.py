"""The page store: few scans of markup, none of it moved, the same results as page by page."""

import re

import pytest
from pyspark.sql import functions as F

from orgcard.operators import pagestore
from orgcard.plans import derived, mining
from orgcard.sources.pages import with_url_key
from tests.test_queries import SF_DIR
from tests.test_sites import pages_df, site_keys

SITES = [
    ("https://a.com/", '<nav><a href="/contact">Contact</a></nav><p><a href="/maps/sitemap.xml">map</a></p>'),
    ("https://a.com/contact", '<iframe src="https://f.com/1"></iframe><p>x</p>'), ("https://f.com/1", "<p>framed@acme.com</p>"),
    ("https://b.com/", '<a href="/maps/sitemap.xml">m</a>'), ("https://b.com/maps/sitemap.xml", "<loc>https://b.com/kontakt/x</loc>"),
    ("https://b.com/kontakt/x", "<p>listed@acme.com</p>"),
    # only the element tree reads this reference
    ("https://c.com/", '<nav><a/href="/support-line">Us</a></nav>'), ("https://c.com/support-line", '<iframe src="https://f.com/2"></iframe>'),
    ("https://f.com/2", "<p>odd@acme.com (212) 555-1234</p>"),
    # references of a map are resolved against the homepage; its anchor is never closed
    ("https://d.com/x/", '<a href="sitemap.html">m</a>'), ("https://d.com/x/sitemap.html", '<p><a href="contact.html">Contact</p>'),
    ("https://d.com/x/contact.html", "<p>map@acme.com</p>"),
]
WANT = {"https://a.com": "framed@acme.com", "https://b.com": "listed@acme.com", "https://c.com": "odd@acme.com", "https://d.com/x": "map@acme.com"}


def moved_markup(df) -> list[str]:
    """Exchanges of the formatted plan whose input has markup."""
    text = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return [block for block in re.findall(r"\(\d+\) \w*Exchange\n(?:Input|Output)[^\n]*", text) if re.search(r"\bhtml#", block)]


@pytest.fixture
def scans(monkeypatch):
    """Plans of all scans of markup, in order."""
    seen, links, markup = [], pagestore.link_rows, pagestore.markup

    def keep(df):
        seen.append(df)
        return df

    monkeypatch.setattr(pagestore, "link_rows", lambda *a, **k: keep(links(*a, **k)))
    monkeypatch.setattr(pagestore, "markup", lambda *a, **k: keep(markup(*a, **k)))
    return seen


def test_sites_by_links(spark, scans):
    got = mining.mine_sites(pages_df(spark, SITES), site_keys(spark, *WANT, "https://gone.com")).collect()
    assert {r.site_key: r.email for r in got} == WANT
    assert len(scans) == 4  # links, answers, and two more for the page that only the tree leads to and its frame
    assert not any(moved_markup(df) for df in scans)


def test_whole_job_scans_markup_twice(spark, scans):
    companies, serp, pages = derived.site_tables(spark, SF_DIR)
    assert mining.mine_companies(companies, serp, pages).count() == companies.count()
    assert len(scans) == 2 and not any(moved_markup(df) for df in scans)
    homes = pages.filter(F.col("url").endswith(".com/"))
    mining.mine_sites(pages, with_url_key(homes).select(F.col("url_key").alias("site_key"))).count()
    assert len(scans) == 4 and not any(moved_markup(df) for df in scans)


def test_stored_pages_do_not_move(spark, scans, monkeypatch):
    monkeypatch.setattr(pagestore, "BROADCAST_ROWS", 0)
    store = pagestore.save_store(pages_df(spark, SITES), "crawl", 4)
    assert store.pages.groupBy("url_key").count().filter("count > 1").count() == 0
    before = len(scans)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = mining.mine_sites(pagestore.open_store(spark, "crawl"), site_keys(spark, *WANT)).collect()
        assert not any(moved_markup(df) for df in scans[before:])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert {r.site_key: r.email for r in got} == WANT
    assert len(scans) - before == 3  # the links are stored


def test_requests_are_merged(spark):
    home = '<nav><a href="/contact">Contact</a></nav><a href="/contact?sitemap">m</a><a href="/contact">Contact</a>'
    pages = pages_df(spark, [("https://a.com/", home), ("https://a.com/contact", "x"), ("https://A.com/contact#y", "z"), ("https://a.com/jobs", "x")])
    rows = pagestore.requests_of(pagestore.page_store(pages), site_keys(spark, "https://a.com")).collect()
    both = pagestore.PROBE | pagestore.VISIT
    assert {r.url_key: (r.page_id, r.bits) for r in rows} == {"https://a.com": (0, pagestore.HOME), "https://a.com/contact": (1, both)}
    assert len(rows) == 2


def test_the_cache_period(spark):
    rows = [(1, "https://a.com/", "<p>old@acme.com</p>", 1), (2, "https://a.com/", "<p>new@acme.com</p>", 8), (3, "https://a.com/", "<p>late@acme.com</p>", 30),
            (4, "https://b.com/", "<p>stale@acme.com</p>", 1), (5, "https://c.com/", None, 9)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, day int").select(
        "page_id", "url", "html", F.timestamp_seconds(F.col("day") * 86400).alias("fetched_at"))
    companies = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "company_id bigint, company_name string")
    serp = spark.createDataFrame([(n, 0, 0, f"https://{n}.com/") for n in "abc"], "query string, engine_ord int, rank int, url string")
    mine = lambda day: {r.company_id: r.email for r in mining.mine_companies(companies, serp, pages, as_of=day).collect()}
    day = lambda n: F.timestamp_seconds(F.lit(n * 86400))
    assert mine(None) == {1: "late@acme.com", 2: "stale@acme.com", 3: None}
    assert mine(day(10)) == {1: "new@acme.com", 2: None, 3: None}


def test_no_pages(spark):
    assert mining.mine_sites(pages_df(spark, []), site_keys(spark, "https://a.com")).collect() == []
    odd = spark.createDataFrame([(1, None, "<p>x</p>"), (2, "", "y"), (3, "https://a.com/", None)], "page_id bigint, url string, html string")
    assert mining.mine_sites(odd, site_keys(spark, "https://a.com")).collect() == []
