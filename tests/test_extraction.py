import pytest

from orgcard.operators import extraction as X

LD = '<script type="application/ld+json">{"email":"ld@acme.com","telephone":"(212) 555-1111"}</script>'
CASES = [
    ("builder link wins over text", '<div class="vc_column_text"><a href="mailto:a@b.co">m</a><p>t@b.co</p></div>', "a@b.co", None),
    ("link with subject is no address", '<div class="vc_column_text"><a href="mailto:a@b.co?subject=x">m</a><p>t@b.co</p></div>', "t@b.co", None),
    ("section attribute", '<div class="contact-info"><i><b data-email="d@b.co">x</b></i></div>', "d@b.co", None),
    ("comment in a section", '<div class="contact-info"><!-- c@b.co --></div>', "c@b.co", None),
    ("comment outside", "<div><!-- c@b.co --></div>", None, None),
    ("script object wins over text", '<p>t@b.co</p><script>cfg = {"zmail":"z@acme.com","amail":"a@acme.com"};</script>', "a@acme.com", None),
    ("tel link wins over text", '<p>(212) 555-1111</p><a href="tel:+12125552222">c</a>', None, "+12125552222"),
    ("tel link after both are known", LD + '<div class="info">x</div><a href="tel:+12125552222">c</a>', "ld@acme.com", "+12125551111"),
    ("tel link without sections", LD + '<a href="tel:+12125552222">c</a>', "ld@acme.com", "+12125552222"),
    ("first container always counts", LD + '<div class="vc_column_text"><a href="mailto:a@b.co">m</a></div>', "a@b.co", "+12125551111"),
    ("later containers do not", LD + '<div class="vc_column_text"></div><div class="vc_column_text"><a href="mailto:a@b.co">m</a></div>',
     "ld@acme.com", "+12125551111"),
    ("cells stay apart", "<table><td>info@acme.com</td><td>Phone</td></table>", "info@acme.com", None),
    ("microdata", '<b itemtype="http://schema.org/Organization"><i itemprop="telephone" content="212 555 1111"></i></b>', None, "+12125551111"),
    ("encoded address in text", "<p>info&#64;acme.com</p>", "info@acme.com", None),
    ("empty", "", None, None),
    ("missing", None, None, None),
]


def test_first_contacts(spark):
    df = spark.createDataFrame([(i, "u", c[1]) for i, c in enumerate(CASES)], "page_id bigint, url string, html string")
    got = {r["page_id"]: (r["email"], r["phone"]) for r in X.first_contacts(df).collect()}
    for i, (name, _, email, phone) in enumerate(CASES):
        assert got[i] == (email, phone), name


def test_filters_on_the_result_keep_one_extraction(spark, plan):
    df = spark.createDataFrame([(1, "u", "a@b.co")], "page_id bigint, url string, html string")
    text = plan(X.first_contacts(df).filter("email is not null"))
    assert text.count("ArrowEvalPython [_shred") == 1 and "Exchange" not in text


def test_results_do_not_depend_on_partitions(spark):
    rows = [(i, "u", c[1]) for i, c in enumerate(CASES)] * 3
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    a = sorted(map(str, X.page_candidates(df.repartition(7)).collect()))
    b = sorted(map(str, X.page_candidates(df.coalesce(1)).collect()))
    assert a == b and a


@pytest.mark.parametrize("options,email", [({}, None), ({"deobfuscated": True}, "a@b.co")])
def test_options(spark, options, email):
    df = spark.createDataFrame([(1, "u", "<p>a [at] b [dot] co</p>")], "page_id bigint, url string, html string")
    assert X.first_contacts(df, **options).first()["email"] == email


def test_rdfa_option(spark):
    html = '<p typeof="schema:ContactPoint">r@b.co</p>'
    df = spark.createDataFrame([(1, "u", html)], "page_id bigint, url string, html string")
    methods = {r["method_ord"] for r in X.page_candidates(df, rdfa=True).collect()}
    assert 20 in methods
