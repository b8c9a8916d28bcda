"""Markup that is never closed is scanned in linear time, and the linear patterns match what the plain ones match."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from orgcard.functions import contacts as C
from orgcard.functions import html as H

MB = 1 << 20
CASES = {
    "anchors": ("<a href=x>y ", H.anchors),
    "anchors without an end of tag": ("<a href=x ", H.anchors),
    "json-ld": ('<script type="application/ld+json">{ ', H.json_ld),
    "scripts": ("<script> x ", H.scripts),
    "script tags": ("<script ", H.scripts),
    "object literals": ("a = {b ", H.object_literals),
    "closed object literals": ("a = {b; ", H.object_literals),
    "metas": ("<meta name=contact ", H.contact_metas),
    "frames": ("<iframe src=x ", H.frame_sources),
    "tel": ("<a tel: ", H.tel_link),
    "locations": ("<loc>x ", H.sitemap_locations),
    "text": ("<a b ", H.visible_text),
    "contact points": ('"contactPoint":{ "email":', C.markup_email),
    "contact point phones": ('"contactPoint":{ "telephone":"1', C.markup_phone_raw),
    "address signs": ('"email":"' + "@" * 200, C.markup_email),
}


def value(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("v")).first()[0]


@pytest.mark.parametrize("name", CASES)
def test_a_megabyte_that_is_never_closed(spark, name):
    unit, make = CASES[name]


    def seconds(size: int) -> float:
        text = F.expr(f"repeat(unit, cast(id as int) + {size // len(unit)})")
        page = spark.range(1).withColumn("unit", F.lit(unit)).select(text.alias("t"))
        start = time.time()
        page.select(F.xxhash64(make(F.col("t")))).collect()  # all of the result, without carrying it to the driver
        return time.time() - start

    fixed = min(seconds(64) for _ in range(3))
    assert min(seconds(MB) for _ in range(2)) - fixed < 2


def test_unclosed_anchors_end_at_the_next_one(spark):
    html = "<p><a href=/1>One <a href='/2'>Two <b>b</b></a> x <a href=/3>Three"
    assert [tuple(a) for a in value(spark, html + "</p>", H.anchors)] == [("/1", "One"), ("/2", "Two  b"), ("/3", "Three")]
    assert value(spark, "a < b <c> d <e f", H.visible_text).split() == ["a", "<", "b", "d", "<e", "f"]
    assert value(spark, "<p>x</p> <!-- y <z", H.visible_text).split() == ["x"]


def test_linear_patterns_match_the_plain_ones(spark):
    r = random.Random(7)
    parts = ['"contactPoint"', ":", " ", "{", "}", '"email"', '"telephone"', '"a@b.c"', '"x@@y.z}"', '"@.c"', '"212 555 1234"', ",", '"', "data-email=", ";", "a", "=", "b = {", "};", "\n"]
    rows = ["".join(r.choice(parts) for _ in range(r.randrange(60))) for _ in range(4000)]
    df = spark.createDataFrame(list(enumerate(rows)), "i long, t string")
    patterns = C.MARKUP_EMAILS + C.MARKUP_PHONES
    found = df.select("i", H.object_literals(F.col("t")).alias("objects"), *(C._property_values(F.col("t"), p).alias(f"p{k}") for k, p in enumerate(patterns)))
    hits = 0
    for row in found.collect():
        text = rows[row.i]
        assert row.objects == re.findall(r"[a-zA-Z0-9_$]\s*=\s*(\{[^;]+\});", text), text
        for k, p in enumerate(patterns):
            want = re.findall(p, text)
            hits += len(want)
            assert row[f"p{k}"] == want, (p, text)
    assert hits > 300
