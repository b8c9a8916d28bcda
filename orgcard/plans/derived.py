"""Web tables that Spark derives from the given tables, so that every operator runs at their size.

Each customer is a company with a small web site; its market segment decides how the site shows
the contact data. Company lists, search hits and pages follow from the customer row alone.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orgcard.sources.pages import spread_rows

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filled(template: str, **values: Column) -> Column:
    """String with ``$name$`` markers replaced by columns."""
    parts = re.split(r"\$(\w+)\$", template)
    return F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts) if i % 2 or p])


def by_segment(values: dict[str, Column]) -> Column:
    segment = F.col("c_mktsegment")
    return F.coalesce(*[F.when(segment == s, v) for s, v in values.items()])


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer key, segment, domain label, and a written and a normal form of a phone number."""
    digits = F.substring("c_name", 10, 9)
    area = F.concat(F.lit("2"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0"))
    exchange = F.concat(F.lit("5"), F.substring(digits, 4, 2))
    number = F.substring(digits, 6, 4)
    return spread_rows(table(spark, sf_dir, "customer")).select(
        "c_custkey", "c_name", "c_acctbal", "c_mktsegment",
        F.concat(F.lit("customer"), digits).alias("label"),
        F.concat(F.lit("+1 ("), area, F.lit(") "), exchange, F.lit("-"), number).alias("phone"),
    )


# --- one card page per customer and extraction method --------------------------------------

CARDS = {
    "jsonld": {
        "AUTOMOBILE": '<script type="application/ld+json">{"@type":"Organization","contactPoint":'
        '{"email":"a@$label$.com","telephone":"$phone$"}}</script>',
        "BUILDING": '<script type="application/ld+json">{"contactPoint":[{"email":"b@$label$.com",'
        '"telephone":"$phone$"}],"email":"other@$label$.com"}</script>',
        "FURNITURE": '<script type="application/ld+json">{"email":"c@$label$.com","telephone":"$phone$"}</script>',
        "HOUSEHOLD": '<script type="application/ld+json">{"email":"d@$label$.com"</script>',
        "MACHINERY": '<script type="application/ld+json">{"contactPoint":{"email":"x@example.com",'
        '"telephone":"12"},"email":"e@$label$.com"}</script>',
    },
    "objects": {
        "AUTOMOBILE": '<script>var t="</p>"; var cfg = {"zmail":"z@$label$.com","amail":"a@$label$.com"};</script>',
        "BUILDING": '<script>window.cfg = {"a":{"email":"x@$label$.com"},"list":[{"contact_email":'
        '"b@$label$.com","tel":"$phone$"}]};</script>',
        "FURNITURE": '<script>cfg = {"hotel":"$phone$"};</script>',
        "HOUSEHOLD": "<script>cfg = {email: 'd@$label$.com'};</script>",
        "MACHINERY": '<script>p = {"email":"x@$label$.com"};</script><script>q = {"mail":"no",'
        '"email":"e@$label$.com"};</script>',
    },
    "microdata": {
        "AUTOMOBILE": '<div itemscope itemtype="http://schema.org/Organization"><meta itemprop="email" '
        'content="a@$label$.com"><meta itemprop="telephone" content="$phone$"></div>',
        "BUILDING": '<p itemscope itemtype="https://schema.org/Organization">Mail <b itemprop="email">'
        'b@$label$.com</b> or <i itemprop="telephone">$phone$</i></p>',
        "FURNITURE": '<div itemscope itemtype="http://schema.org/Person"><b itemprop="email">c@$label$.com</b></div>',
        "HOUSEHOLD": '<div itemtype="http://schema.org/Organization"><b itemprop="email">nobody</b>'
        '<b itemprop="email">d@$label$.com</b><b itemprop="telephone">$phone$</b></div>',
        "MACHINERY": '<b itemprop="email">x@$label$.com</b><div itemtype="http://schema.org/Organization">'
        '<ul><li>Us<li itemprop="email">e@$label$.com</ul></div>',
    },
    "builder": {
        "AUTOMOBILE": '<div class="uabb-info-list-item"><a href="mailto:a@$label$.com">Mail</a>'
        '<a href="tel:$phone$">Call</a></div>',
        "BUILDING": '<div class="col elementor-widget-container"><p>b@$label$.com<br>$phone$</p></div>',
        "FURNITURE": '<div class="vc_column_text"><a href="mailto:x@$label$.com?subject=Hi">Mail</a>'
        "<p>or c@$label$.com</p></div>",
        "HOUSEHOLD": '<div class="vc_column_text"><a href="mailto:x@$label$.com">1</a></div>'
        '<div class="vc_column_text"><a href="mailto:d@$label$.com">2</a><a href="tel:$phone$">3</a></div>'
        '<div class="vc_column_text"><a href="mailto:late@$label$.com">4</a></div>',
        "MACHINERY": '<div class="uabb-info-list-item"><a href="MAILTO:e@$label$.com">Mail</a></div>',
    },
    "properties": {
        "AUTOMOBILE": '<p data-x=\'{"email":"x@$label$.com"}\' data-email="a@$label$.com" data-phone="$phone$"></p>',
        "BUILDING": '<p data-x=\'{"email" : "x@$label$.com", "contactPoint":{"email":"b@$label$.com","telephone":"$phone$"}}\'></p>',
        "FURNITURE": '<meta property="og:email" content="c@$label$.com"><meta name="phone_number" content="$phone$">',
        "HOUSEHOLD": '<p data-x=\'{"email":"x@example.com","email":"d@$label$.com"}\'></p>',
        "MACHINERY": '<p data-x=\'{"telephone":"$phone$","email":"nobody"}\'></p>',
    },
    "section": {
        "AUTOMOBILE": '<div class="page-contact"><p data-email="a@$label$.com" data-phone="$phone$">Us</p></div>',
        "BUILDING": '<section class="Details"><!-- b@$label$.com --><p>Mail x@$label$.com</p></section>',
        "FURNITURE": '<p>x@$label$.com</p><div class="info-box"><ul><li><div class="contact">c@$label$.com'
        "</div><li>$phone$</ul></div>",
        "HOUSEHOLD": '<div class="main"><p>x@$label$.com</p></div>',
        "MACHINERY": '<div class="footer-top"><table><tr><td>e@$label$.com</td><td>Phone</td></tr></table></div>',
    },
}


def card_pages(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    """(page_id, url, html): one page per customer that shows contact data in one way."""
    c = customers(spark, sf_dir)
    values = {"label": F.col("label"), "phone": F.col("phone")}
    body = by_segment({s: filled(t, **values) for s, t in CARDS[method].items()})
    return c.select(
        F.col("c_custkey").alias("page_id"),
        filled("https://www.$label$.com/", **values).alias("url"),
        F.concat(F.lit("<html><body><h1>Card</h1>"), body, F.lit("</body></html>")).alias("html"),
    )


# --- whole sites ----------------------------------------------------------------------------

SITE = "https://www.$label$.com"
# (segment, url, html); NULL segment: pages of every customer.
SITE_PAGES = [
    ("AUTOMOBILE", SITE + "/", '<html><head><script type="application/ld+json">{"contactPoint":{"email":'
     '"a@$label$.com","telephone":"$phone$"}}</script></head><body><nav><a href="/contact">Contact</a></nav>'
     "<p>Write to late@$label$.com</p></body></html>"),
    ("AUTOMOBILE", SITE + "/contact", "<html><body><p>late@$label$.com</p></body></html>"),
    ("BUILDING", SITE + "/", '<html><body><nav><a href="/about">Company</a></nav><h1>Welcome</h1>'
     '<p><a href="/sitemap.xml">Map</a></p></body></html>'),
    ("BUILDING", SITE + "/sitemap.xml", "<urlset><url><loc>https://www.$label$.com/Company/Contact.html</loc>"
     "<lastmod>2024-01-01</lastmod></url><url><loc>https://www.$label$.com/jobs</loc></url></urlset>"),
    ("BUILDING", SITE + "/Company/Contact.html", '<html><body><div class="elementor-widget-container">'
     '<a href="mailto:b@$label$.com">Mail us</a><a href="tel:$phone$">Call</a></div></body></html>'),
    ("FURNITURE", SITE + "/", '<html><body><p>Chairs</p><footer><a href="pages/kontakt.html#top">Kontakt</a>'
     '<a href="https://www.facebook.com/contact">Contact</a></footer></body></html>'),
    ("FURNITURE", SITE + "/pages/kontakt.html", '<html><body><div class="contact-info">'
     '<span data-email="c@$label$.com">Mail</span><p>$phone$</p></div></body></html>'),
    ("HOUSEHOLD", SITE + "/", '<html><body><p>front@$label$.com</p><a href="tel:$phone$">Call</a>'
     '<script>var cfg = {"email":"d@$label$.com"};</script></body></html>'),
    ("HOUSEHOLD", SITE + "/contact", '<html><body><div class="contact"><form class="contact-form"></form>'
     '<p>Our address: late@$label$.com</p><script>var cfg = {"email":"late@$label$.com"};</script></div></body></html>'),
    ("MACHINERY", "https://www.yellowpages.com/biz/$label$", '<html><body><a href="/">Home</a>'
     '<a href="https://www.$label$.com/">Visit <b>official site</b></a></body></html>'),
    ("MACHINERY", SITE + "/", '<html><body><iframe src="https://frames.$label$.net/card"></iframe></body></html>'),
    ("MACHINERY", "https://frames.$label$.net/card", '<html><body><p itemtype="http://schema.org/Organization">'
     '<b itemprop="email" content="e@$label$.com">mail</b></p><p>$phone$</p></body></html>'),
]
# (segment, query, engine, rank, url)
SITE_HITS = [
    ("AUTOMOBILE", "$name$", 0, 0, "https://www.facebook.com/$label$"),
    ("AUTOMOBILE", "$name$", 0, 1, SITE + "/"),
    ("BUILDING", "$name$", 1, 4, SITE + "/"),
    ("BUILDING", "$name$", 0, 5, "https://shop.$label$.com/"),
    ("FURNITURE", "$name$ official website contact", 0, 2, SITE + "/"),
    ("FURNITURE", "$name$", 1, 0, "https://old.$label$.org/"),
    ("HOUSEHOLD", "$name$", 0, 0, "https://unrelated.org/"),
    ("HOUSEHOLD", "$name$", 0, 3, SITE + "/#home"),
    ("MACHINERY", "$name$", 0, 0, "https://www.yellowpages.com/biz/$label$"),
]


def site_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(companies, serp, pages). Customers in debt have no search hits."""
    c = customers(spark, sf_dir)
    values = {"label": F.col("label"), "phone": F.col("phone")}
    name = F.when(F.col("c_mktsegment") == "MACHINERY", F.col("label")).otherwise(F.col("c_name"))
    companies = c.select(F.col("c_custkey").alias("company_id"), name.alias("company_name"))

    def own(segment: str, row: Column) -> Column:
        return F.when(F.col("c_mktsegment") == segment, row)

    pages = F.array(
        *[
            own(s, F.struct((F.col("c_custkey") * 16 + i).alias("page_id"), filled(u, **values).alias("url"),
                            filled(h, **values).alias("html")))
            for i, (s, u, h) in enumerate(SITE_PAGES)
        ]
    )
    hits = F.array(
        *[
            own(s, F.struct(filled(q, name=name).alias("query"), F.lit(e).alias("engine_ord"),
                            F.lit(r).alias("rank"), filled(u, **values).alias("url")))
            for s, q, e, r, u in SITE_HITS
        ]
    )
    # Outer generators: the plain ones would build each array twice, once to test its size.
    page_rows = c.select(F.inline_outer(F.filter(pages, lambda p: p.isNotNull())))
    hit_rows = c.filter("c_acctbal >= 0").select(F.inline_outer(F.filter(hits, lambda h: h.isNotNull())))
    return companies, hit_rows, page_rows
