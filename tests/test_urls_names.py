from difflib import SequenceMatcher
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from orgcard.functions import names as N
from orgcard.functions import urls as U


@pytest.mark.parametrize("base", ["https://a.com/en/x?y=1", "http://a.com", "https://a.com/d/", "https://a.com:8080/p#f"])
def test_resolve_like_urljoin(spark, base):
    refs = ["/c", "c", "../c", "//b.com/c", "?z=2", "#t", "./a/../b/.", "mailto:a@b.c", "../../../q", "/x/../y/./z",
            "http://c.org/p/../q", "c.html?a=/../b", "", "tel:+1", "a/b/"]
    df = spark.createDataFrame([(r,) for r in refs], "r string")
    got = {r["r"]: r["u"] for r in df.select("r", U.resolve(F.lit(base), F.col("r")).alias("u")).collect()}
    assert got == {r: urljoin(base, r) for r in refs}


def test_validity_and_score(spark):
    cases = [
        ("https://a.com/contact", True, 0.8), ("https://a.com/en/about/contact", True, 0.7),
        ("https://a.com/support", True, 0.5), ("https://a.com/about", True, 0.4), ("https://a.com/", True, 0.0),
        ("https://a.com/reach/1/2/3/4", True, 0.3), ("https://www.linkedin.com/company/x", False, 0.0),
        ("https://notfacebook.com.x/", False, 0.0), ("ftp://a.com/contact", False, 0.8), ("/contact", False, 0.8),
        ("mailto:a@b.co", False, 0.0), ("https://abc/", False, 0.0), ("http://a.b/", False, 0.0),
    ]
    df = spark.createDataFrame([(i, u) for i, (u, _, _) in enumerate(cases)], "i int, u string").orderBy("i")
    rows = df.select(U.is_valid_url(F.col("u")), U.contact_score(F.col("u"))).collect()
    assert [r[0] for r in rows] == [v for _, v, _ in cases]
    assert [r[1] for r in rows if r[0]] == [s for _, v, s in cases if v]
    listed = df.select(U.is_valid_url(F.col("u"), ["a.com/biz"])).collect()
    assert not listed[0][0]


def test_keys_and_labels(spark):
    cases = [
        ("HTTPS://User@WWW.Acme.co.uk:443/A/?q=1#f", "https://user@www.acme.co.uk:443/A?q=1", "acme"),
        ("http://acme.com", "http://acme.com", "acme"), ("http://10.0.0.1/x", "http://10.0.0.1/x", "10.0.0.1"),
        ("http://localhost/", "http://localhost", "localhost"), ("mailto:x", None, None),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, u string").orderBy("i")
    rows = df.select(U.url_key(F.col("u")), U.registrable_label(F.col("u"))).collect()
    assert [tuple(r) for r in rows] == [c[1:] for c in cases]


def test_name_rules(spark):
    cases = [
        ("Acme Widgets Inc", "acmewidgets", True), ("International Business Machines", "ibm", True),
        ("Procter & Gamble", "pg", True), ("Gooogle", "google", False), ("The Boeing Company", "thehill", True),
        ("Amazon", "amazon", False), ("Zeta Ltd", "example", False), ("Söhne & Co", "söhne", True),
    ]
    df = spark.createDataFrame([(i, n, l) for i, (n, l, _) in enumerate(cases)], "i int, n string, l string").orderBy("i")
    name, label = F.col("n"), F.col("l")
    rows = df.select(N.matches_label_exactly(name, label), N.similarity(name, label)).collect()
    assert [r[0] for r in rows] == [c[2] for c in cases]
    assert rows[3][1] == pytest.approx(12 / 13)
    stopped = df.select(N.matches_label_exactly(name, label, ["the", "company"])).collect()
    assert not stopped[4][0]


def test_similarity_bound_drops_no_match(spark):
    words = ["acme", "acmee", "amce", "acme corp", "zz", "a", "google", "gogle", "googlegoogle"]
    df = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
    for r in df.select("a", "b", N.similarity(F.col("a"), F.col("b")).alias("s")).collect():
        ratio = SequenceMatcher(None, r["a"], r["b"]).ratio()
        assert (r["s"] is not None and r["s"] > N.MIN_SIMILARITY) == (ratio > N.MIN_SIMILARITY)
