"""Shortcuts lose nothing, ids and snapshots are stable, unclosed markup stays linear."""

import time

import pytest
from pyspark.sql import functions as F

from orgcard.functions import contacts as C
from orgcard.functions import html as H
from orgcard.operators import extraction
from orgcard.sources import companies, dims, pages


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t"))).first()[0]


@pytest.mark.parametrize("text,want", [("phone: +1234   ", "+1234"), ("call 1+2+3 +4 5 x", "1+2+3+45"), ("tel: 12 34   ", None)])
def test_short_numbers_pass_the_digit_test(spark, text, want):
    assert one(spark, text, C.first_phone) == want


@pytest.mark.parametrize("body,email,phone", [
    ('<script>var cfg = {"email":"info\\u0040acme.com"};</script>', "info@acme.com", None),
    ("<p>jane&lowbar;doe@acme.com</p>", "jane_doe@acme.com", None),
    ("<p>+44&thinsp;2079460958</p>", None, "+442079460958"),
    ('<div class="contact"><p>+44&thinsp;2079460958</p></div>', None, "+442079460958"),
    ("<p>phone: &plus;1234   </p>", None, "+1234"),
    ("<p>jane&#64;acme.com</p>", "jane@acme.com", None),
])
def test_page_test_is_a_superset(spark, body, email, phone):
    page = spark.createDataFrame([(1, "https://a.com/", f"<html><body>{body}</body></html>")], "page_id long, url string, html string")
    row = extraction.first_contacts(page).first()
    assert (row.email, row.phone) == (email, phone)


def test_every_named_reference_is_decoded(spark):
    from html.entities import html5
    names = sorted(n for n in html5 if n.endswith(";") and n.lower() != "amp;")
    rows = spark.createDataFrame([(n, f"a&{n}b") for n in names], "n string, t string")
    got = {r.n: r.x for r in rows.select("n", H.decode_entities(F.col("t")).alias("x")).collect()}
    wide = set(H.WIDE_BLANK_CODES)
    for n in names:
        assert got[n] == "a" + "".join(" " if ord(c) in wide else c for c in html5[n]) + "b", n


def test_unclosed_markup_is_linear(spark):
    for page in ("<!-- x " * 150_000, "<script> y " * 100_000):
        start = time.time()
        one(spark, "<p>seen</p>" + page, H.visible_text)
        assert time.time() - start < 20


def test_ids_do_not_depend_on_splits(spark, tmp_path):
    names = [(f"Company {i % 700}" if i % 9 else None,) for i in range(5000)]
    frame = spark.createDataFrame(names, "name string")
    frame.coalesce(1).write.csv(str(tmp_path / "one"), header=True)
    frame.repartition(8).write.csv(str(tmp_path / "eight"), header=True)
    one_file, eight = (sorted(map(tuple, companies.read_companies(spark, str(tmp_path / p), "csv").collect())) for p in ("one", "eight"))
    assert one_file == eight and len({i for i, _ in one_file}) == len(one_file) == sum(n is not None for n, in names)


def test_a_snapshot_without_markup_hides_nothing(spark):
    table = spark.createDataFrame([(1, "https://a.com/", "<p>old</p>", 1), (2, "https://a.com/", None, 2)],
                                  "page_id long, url string, html string, fetched_at int").withColumn("fetched_at", F.timestamp_seconds("fetched_at"))
    wanted = pages.with_url_key(spark.createDataFrame([("https://a.com/",)], "url string")).select("url_key")
    assert [r.html for r in pages.fetch(table, wanted, 1).collect()] == ["<p>old</p>"]


def test_terms_of_one_language_find_what_all_its_terms_find():
    assert sum(map(len, dims.CONTACT_TERMS.values())) == 174
    for category, terms in dims.CONTACT_TERMS.items():
        short = dims.literal_terms(category)
        assert all(any(s in t for s in short) for t in terms) and set(short) <= set(terms)


def test_nested_containers_are_cheap(spark):
    body = '<div class="elementor-widget-container"><p>call (212) 555-1234 or a@b.co</p>' * 200 + "text " * 200 + "</div>" * 200
    page = spark.createDataFrame([(1, "https://a.com/", body)], "page_id long, url string, html string")
    start = time.time()
    row = extraction.first_contacts(page).first()
    assert (row.email, row.phone) == ("a@b.co", "+12125551234") and time.time() - start < 30
