"""Suffix rules and nested escapes."""

import pytest
from pyspark.sql import functions as F

from orgcard.functions import html as H
from orgcard.functions.urls import registrable_label
from orgcard.operators import extraction, suffixes

# The published examples of the rule format, as (host, suffix, label).
HOSTS = [("acme.com", "com", "acme"), ("a.b.acme.com", "com", "acme"), ("com", "com", None), ("x.acme.co.uk", "co.uk", "acme"),
         ("co.uk", "co.uk", None), ("acme.uk", "uk", "acme"), ("b.test.ck", "test.ck", "b"), ("test.ck", "test.ck", None), ("www.ck", "ck", "www"),
         ("a.www.ck", "ck", "www"), ("city.kawasaki.jp", "kawasaki.jp", "city"), ("x.y.kawasaki.jp", "y.kawasaki.jp", "x"), ("acme.zz", "zz", "acme"),
         ("10.0.0.1", None, "10.0.0.1"), ("localhost", "localhost", None)]


def test_rules(spark):
    rules = spark.createDataFrame([(r,) for r in ["com", "COM", " .co.uk", "uk", "*.ck", "!www.ck", "jp", "*.kawasaki.jp", "!city.kawasaki.jp", "", None]], "suffix string")
    rows = [(f"https://u@{h.upper()}:8/x", h, 1) for h, *_ in HOSTS] + [(None, None, 1), ("/x", None, 1)] + [("https://acme.com", "acme.com", 1)] * 3
    out = suffixes.with_registrable_label(spark.createDataFrame(rows, "url string, h string, kind int"), rules).collect()
    assert len(out) == len(rows)
    want = {h: (s, x) for h, s, x in HOSTS}
    want["acme.com"] = ("com", "acme")
    for r in out:
        assert (r.suffix, r.label) == want.get(r.h, (None, None)), r


@pytest.mark.parametrize("url,want", [("https://www.acme.com.pl/x", "acme"), ("https://acme.pl", "acme"), ("https://a.acme.co.ke", "acme"), ("https://com.pl", "com")])
def test_general_suffixes(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(registrable_label(F.col("u"))).first()[0] == want


@pytest.mark.parametrize("text,want", [
    ("a%40b.c", "a@b.c"), ("100% of a+b", "100% of a+b"), ("%zz %4", "%zz %4"), ("a%2540b", "a@b"), ("a%252540b", "a@b"), ("a%25252540b", "a%40b"),
    ("\\x40\\u0040\\u{40}%u0040&#64;", "@@@@@"), ("\\ud83d stays", "\\ud83d stays"), ("%C3%A9", "é"), ("\\x2540", "@"), ("", ""), (None, None)])
def test_escapes(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(H.decode_escapes(F.col("t"))).first()[0] == want


def test_broken_pages_are_told(spark):
    rows = [(1, "u", "<p>a@b.com</p><![x[ <p>c"), (2, "u", "<p>ok</p>"), (3, "u", None)]
    out = extraction.page_errors(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert [r.page_id for r in out] == [1] and "x" in out[0].error
