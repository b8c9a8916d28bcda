import re

import pytest
from pyspark.sql import functions as F

from orgcard.functions import contacts as C

EMAILS = [
    ("Email: info@acme.com", "info@acme.com"),
    ("INFO@Acme.com", "INFO@Acme.com"),
    ("x@example.com", None),
    ("x@mail5.example.com", "x@mail5.example.com"),
    ("x@test.com, sales@acme.co.uk", "sales@acme.co.uk"),
    (".info@acme.com", ".info@acme.com"),
    ("sales [at] acme [dot] com", None),
    ("%61%40%62", None),
    ("info@acme.com. Call us", "info@acme.com"),
    ("", None),
    (None, None),
]
PHONES = [
    ("(212) 555-1234", "+12125551234"),
    ("+1 (663) 555-6869", "+16635556869"),
    ("+1 (017) 555-7713", None),
    ("tel:+12125551234", "+12125551234"),
    ("+442079460958", "+442079460958"),
    ("+44 20 7946 0958", "+44207946"),
    ("212-555-1234 ext 55", "212555123455"),
    ("4785380592391139", "+10592391139"),
    ("phone: 12 - ( 3", None),
    ("152.143.123.131", None),
    ("no digits", None),
    (None, None),
]


def values(spark, cases, column):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("t"))).collect()]


def test_first_email(spark):
    assert values(spark, EMAILS, C.first_email) == [e for _, e in EMAILS]


def test_first_phone(spark):
    assert values(spark, PHONES, C.first_phone) == [p for _, p in PHONES]


def test_opt_ins(spark):
    def hidden(t):
        return C.first_email(C.canonical_text(t, deobfuscated=True))

    cases = [("sales [at] acme [dot] com",), ("sales at acme dot com",), ("look at that dot",), ("a@b.co",)]
    assert values(spark, cases, hidden) == ["sales@acme.com", "sales@acme.com", None, "a@b.co"]

    def decoded(t):
        return C.first_email(C.canonical_text(t, decoded=True))

    cases = [("%61%40%62.co",), ("%61%40%62",), ("100% a@b.co",), ("a+b@c.de%20",)]
    assert values(spark, cases, decoded) == ["a@b.co", None, "a@b.co", "a+b@c.de"]

    def bounded(t):
        return C.first_phone(t, boundary=True)

    cases = [("4785380592391139",), ("call (212) 555-1234 now",)]
    assert values(spark, cases, bounded) == [None, "+12125551234"]


def test_all_emails_equal_the_plain_pattern(spark):
    texts = ["a@b.com_c@d.com x@y.zz", "@@a@b..co", "%@x.yy a%b@c-d.ef,", "a@b@c.de", "é@x.org ü.a@b.cd"]
    got = values(spark, [(t,) for t in texts], C.all_emails)

    def brute(t):
        valid = re.compile(C.EMAIL_SHAPE)
        return [m for m in re.findall(C.EMAIL_PLAIN, t) if valid.match(m.lower())]

    assert got == [brute(t) for t in texts]


def test_long_runs_stay_linear(spark):
    text = F.concat(F.repeat(F.lit("a"), 400_000), F.lit(" "), F.repeat(F.lit("7"), 400_000), F.lit(" @ x@y.org"))
    row = spark.range(1).select(C.first_email(text).alias("e"), C.first_phone(text).alias("p")).first()
    assert row["e"] == "x@y.org" and row["p"]


def test_format_phone_is_idempotent_and_keeps_valid(spark):
    raws = [(p,) for p in ("(212) 555-1234", "+1-2", "12345", "++4412345", "1 (234) 567 89 01 ext 5")]
    once = values(spark, raws, C.format_phone)
    assert values(spark, [(p,) for p in once], C.format_phone) == once


def test_pattern_ord(spark):
    cases = [("(212) 555-1234",), ("tel:+12125551234",), ("phone: 12345678",), ("none",)]
    assert values(spark, cases, C.phone_pattern_ord) == [2, 9, 5, None]


@pytest.mark.parametrize(
    "html,email,phone",
    [
        ('{"email": "a@b.com", "telephone":"(212) 555-1234"}', "a@b.com", "(212) 555-1234"),
        ('{"email":"x@y.com","contactPoint":{"z":1,"email":"c@d.com"}}', "c@d.com", None),
        ('<meta name="email" content="m@d.com"><i data-email="q@d.com" data-phone="212 555 1234">', "q@d.com", "212 555 1234"),
        ('{"email":"x@example.com"}', None, None),
    ],
)
def test_markup_properties(spark, html, email, phone):
    row = spark.createDataFrame([(html,)], "h string").select(
        C.markup_email(F.col("h")), C.markup_phone_raw(F.col("h"))
    ).first()
    assert tuple(row) == (email, phone)
