from pyspark.sql import functions as F

from orgcard.operators import discovery, resolution
from orgcard.plans import mining
from orgcard.sources import dims
from orgcard.sources.pages import fetch, save_pages, with_url_key

PAGES = "page_id bigint, url string, html string"


def pages_df(spark, rows):
    return spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], PAGES)


def site_keys(spark, *keys):
    return spark.createDataFrame([(k,) for k in keys], "site_key string")


def test_top_three_with_ties_and_duplicates(spark, plan):
    rows = [("s", 1, u) for u in ("https://a.com/contact/b", "https://a.com/contact/a", "https://a.com/x",
                                  "https://a.com/about", "https://a.com/about/", "https://a.com/help")]
    found = spark.createDataFrame(rows + [("s", 0, "https://a.com/x")], "site_key string, source_ord int, url string")
    ranked = discovery.rank_contact_pages(found)
    best = ranked.orderBy("rn").collect()
    assert [r["url"] for r in best] == ["https://a.com/contact/a", "https://a.com/contact/b", "https://a.com/help"]
    # Rows are cut per key before the shuffle, so a hot site does not gather in one task.
    assert plan(ranked).count("WindowGroupLimit") == 2


def test_homepage_sources(spark):
    html = (
        '<nav><a href="/Kontakt">x</a><a href="/jobs">Jobs</a></nav><div class="primary-nav"><a href="help.html">?</a></div>'
        '<a href="/contact">outside</a><footer><a href="https://facebook.com/contact">c</a><a href="/f">Contact <b>us</b></a></footer>'
        '<meta name="contact" content="/meta"><a href="Sitemap.xml">m</a>'
        '<script type="application/ld+json">{"contactPoint":{"url":"/ld"}}</script>'
    )
    homes = pages_df(spark, [("https://a.com/d/", html)]).withColumn("site_key", F.lit("s"))
    row = discovery.homepage_links(homes).first()
    assert {(s["source_ord"], s["url"]) for s in row["sources"]} == {
        (1, "https://a.com/Kontakt"), (2, "https://a.com/f"), (3, "https://a.com/d/help.html"),
        (4, "https://a.com/ld"), (5, "https://a.com/meta"),
    }
    assert row["sitemaps"] == ["https://a.com/d/Sitemap.xml"]
    narrow = discovery.homepage_links(homes, terms=dims.category_names()).first()
    assert {s["source_ord"] for s in narrow["sources"]} == {4, 5}


def test_terms_cover_longer_forms(spark):
    longer = ["contact-us", "about/contact", "kontaktformular", "support-de", "contactez-nous", "nous-contacter",
              "service-clientele", "contact/index.html", "/api/v1/contact", "dealer-contact", "iletisim-formu",
              "svyazatsya-s-nami", "obratnaya-svyaz", "contact-korea", "helpdesk", "bizimle-iletisime-gecin", "munuihagi"]
    df = spark.createDataFrame([(t,) for t in longer + ["jobs", "news"]], "t string")
    hit = discovery.is_contact_reference(F.col("t"), F.lit(""), dims.literal_terms())
    assert {r["t"] for r in df.filter(hit).collect()} == set(longer)


def test_pattern_terms(spark):
    refs = ["/x/reach-out", "https://info.a.com/x", "/#reach-us", "/y/support", "/plain"]
    df = spark.createDataFrame([(t,) for t in refs], "t string")
    hit = discovery.is_contact_reference(F.col("t"), F.lit(""), ["zzz"], patterns=True)
    assert {r["t"] for r in df.filter(hit).collect()} == set(refs) - {"/plain"}


def test_visited_prefix(spark):
    both = '<p>h@acme.com (212) 555-1111</p><nav><a href="/contact">c</a></nav>'
    lacks = '<p>h@acme.com</p><nav><a href="/contact">c</a></nav>'
    contact = '<p>(212) 555-2222</p><script>x = {"email":"js@acme.com"};</script>'
    pages = pages_df(spark, [
        ("https://a.com/", both), ("https://a.com/contact", contact),
        ("https://b.com/", lacks), ("https://b.com/contact", contact),
        ("https://c.com/", '<iframe src="https://f.com/1"></iframe><iframe src="/rel"></iframe>'),
        ("https://f.com/1#x", "<p>framed@acme.com</p>"), ("https://c.com/rel", "<p>rel@acme.com</p>"),
        ("https://d.com/", "nothing"),
    ])
    keys = site_keys(spark, "https://a.com", "https://b.com", "https://c.com", "https://d.com", "https://gone.com")
    got = {r["site_key"]: (r["email"], r["phone"]) for r in mining.mine_sites(pages, keys).collect()}
    assert got == {
        "https://a.com": ("h@acme.com", "+12125551111"),
        "https://b.com": ("js@acme.com", "+12125552222"),
        "https://c.com": ("framed@acme.com", None),
    }


def test_probe_needs_relevance(spark):
    good = '<div class="contact"><form class="contact"></form></div><p>Our address</p>'
    pages = pages_df(spark, [("https://a.com/", "x"), ("https://a.com/reach", good), ("https://a.com/connect", "<p>x</p>")])
    homes = with_url_key(pages.filter("page_id = 0")).withColumnRenamed("url_key", "site_key")
    ranked = discovery.contact_pages(pages, homes).collect()
    assert [(r["url"], r["source"], r["score"]) for r in ranked] == [("https://a.com/reach", "common-path", 0.6)]


def test_fetch_takes_the_newest_snapshot(spark):
    rows = [(1, "https://a.com/#x", "old", 1), (2, "https://a.com", "new", 5), (3, "https://A.com/", "new too", 5), (4, "https://b.com/", None, 9)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, at int").select(
        "page_id", "url", "html", F.timestamp_seconds("at").alias("fetched_at"))
    wanted = spark.createDataFrame([("https://a.com",), ("https://b.com",)], "url_key string")
    for rows_bound in (2, 10_000_000):  # broadcast and shuffle forms
        assert [r["html"] for r in fetch(pages, wanted, rows_bound).collect()] == ["new"]


def test_bucketed_pages_are_not_shuffled(spark, plan):
    pages = pages_df(spark, [(f"https://a{i}.com/", "<p>x</p>") for i in range(50)])
    save_pages(pages, "bucketed_pages", 8)
    stored = spark.table("bucketed_pages")
    wanted = stored.limit(20).select(F.concat(F.lit("https://a"), F.col("page_id"), F.lit(".com")).alias("url_key"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = fetch(stored, wanted, 10_000_000)
        text = plan(got)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert got.count() == 20
    scan = [line for line in text.splitlines() if "html" in line and "Scan" in line]
    assert scan and text.count("Exchange") == 1  # only the ids move


def test_resolution(spark):
    companies = spark.createDataFrame(
        [(1, "Acme Widgets"), (2, "Acme Widgets"), (3, "Gooogle"), (4, "Nobody"), (5, "dirco"), (6, "Late Co")],
        "company_id bigint, company_name string")
    serp = spark.createDataFrame(
        [
            ("Acme Widgets", 0, 0, "https://facebook.com/acme"), ("Acme Widgets", 0, 6, "https://acme.com/late"),
            ("Acme Widgets", 1, 0, "https://acme.com/engine2"),
            ("Acme Widgets official website contact", 0, 3, "https://widgets.com/extended"),
            ("Gooogle", 0, 0, "https://google.com/"), ("Nobody", 0, 0, "https://x.com/"),
            ("Nobody official website contact", 0, 0, "https://officialcontact.com/"),
            ("dirco", 0, 9, "https://www.yelp.com/biz/dirco"), ("dirco", 1, 0, "https://yellowpages.com/dirco"),
            ("Late Co", 0, 5, "https://late.com/"),
        ],
        "query string, engine_ord int, rank int, url string")
    listing = '<a href="https://facebook.com/d">website</a><a href="https://dirco.io/v">Visit our site</a><a href="https://dirco.io/">Homepage</a>'
    pages = pages_df(spark, [("https://yellowpages.com/dirco", listing)])
    got = {r["company_id"]: r["website"] for r in resolution.resolve_websites(companies, serp, pages).collect()}
    assert got == {1: "https://widgets.com/extended", 2: "https://widgets.com/extended", 3: "https://google.com/",
                   4: None, 5: "https://dirco.io/", 6: None}


def test_pipeline_with_a_hot_site(spark):
    """A third of all companies share one site; each page is read once for all of them."""
    names = [(i, "Acme" if i % 3 == 0 else f"Firm{i}") for i in range(90)]
    raw = [(i, bytearray(n.encode())) for i, n in names] + [(90, bytearray(b"\xff"))]
    companies = spark.createDataFrame(raw, "company_id bigint, company_name binary")
    serp = spark.createDataFrame(
        [(n, 0, 0, f"https://{n.lower()}.com/") for n in {n for _, n in names}], "query string, engine_ord int, rank int, url string")
    pages = pages_df(spark, [(f"https://{n.lower()}.com/", f"<p>mail@{n.lower()}.com</p>") for n in sorted({n for _, n in names})])
    rows = mining.mine_companies(companies, serp, pages).collect()
    assert len(rows) == 91
    assert [tuple(r) for r in rows if r["company_id"] == 90] == [(90, "FF", None, None, None, "encoding_error")]
    rows = [r for r in rows if r["company_id"] < 90]
    assert all(r["email"] == f"mail@{r['company_name'].lower()}.com" and r["status"] == "success" for r in rows)
