"""Expressions over pages do their work once, and skip what cannot be there without losing what can."""

from pyspark.sql import functions as F

from orgcard.functions import html as H
from orgcard.functions import tree as T
from orgcard.functions import urls as U

PAGES = [
    ('<a<!-- x --> href="/contact">Us</a>', [("/contact", "Us")], 0.0),
    ('<A\nHREF="/c">C</A><a<script>1</script> href="/d">D</a>', [("/c", "C"), ("/d", "D")], 0.0),
    ("<abbr>no</abbr> <p>a &lt;a href</p>", [], 0.0),
    ('<DIV CLASS="Contact">x@y.org</DIV>', [], 2.5 / 7),
    ('<form class="contact"></form><!-- <div class="contact"> --><ul class=social>', [], 1.5 / 7),
    ("<div cl<!-- -->ass='contact'>+1 (212) 555-0100</div>", [], 1.5 / 7),
    ("", [], 0.0),
    (None, None, 0.0),
]


def test_anchors_and_relevance(spark):
    df = spark.createDataFrame([(i, p[0]) for i, p in enumerate(PAGES)], "i int, html string")
    html = F.col("html")
    rows = df.select("i", H.anchors(html).alias("a"), H.relevance(html, H.visible_text(html)).alias("r")).orderBy("i").collect()
    for row, (_, anchors, relevance) in zip(rows, PAGES):
        assert (row.a if row.a is None else [tuple(x) for x in row.a]) == anchors
        assert abs(row.r - relevance) < 1e-12


def test_markup_is_bared_once(spark, plan):
    df = spark.createDataFrame([("a", "b")], "html string, text string")
    assert plan(df.select(H.relevance(F.col("html"), F.col("text")))).count(H.INVISIBLE) <= 2  # named four times as often before


def test_an_address_is_split_once_for_each_part(spark, plan):
    df = spark.createDataFrame([("a",)], "url string")
    text = plan(df.select(U.is_valid_url(F.col("url"))))
    assert text.count("regexp_extract") <= 6  # an empty one is taken for none, so the plan names each twice or more


def test_classes_are_whole_words(spark):
    df = spark.createDataFrame([("a b",), ("ab",), ("b\ta",), (None,), ("",)], "class string")
    node = F.struct("class").alias("node")
    got = [r.has for r in df.select(node).select(F.coalesce(T.has_class(F.col("node"), "a"), F.lit(False)).alias("has")).collect()]
    assert got == [True, False, True, False, False]
