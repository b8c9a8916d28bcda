from pyspark.sql import functions as F

from orgcard.functions import html as H
from orgcard.functions import tree as T


def one(spark, html, column):
    return spark.createDataFrame([(html,)], "h string").select(column(F.col("h"))).first()[0]


def test_visible_text(spark):
    html = (
        '<script>var t="</p>";</script><style>p{}</style><!-- no <b> --><td>info@acme.com</td><td>Phone</td>'
        "a&amp;b &lt;x&gt; &#64;&#x40; &nbsp;&amp;quot; &unknown; &#55296;  ."
    )
    text = one(spark, html, H.visible_text)
    assert text.split() == ["info@acme.com", "Phone", "a&b", "<x>", "@@", "&quot;", "&unknown;", "."]


def test_anchors_frames_metas(spark):
    html = (
        "<a href='/x?a=1&amp;b=2'>One <b>two</b></a><a name=q>no</a><A class=c HREF=/y >Y</A><!-- <a href=/z>z</a> -->"
        '<iframe src="https://f.com/x"></iframe><frame src="/rel"><meta content="/c" name="contact-page">'
        '<meta name="email" content="mail"><a href="tel:x">a</a><a href="TEL: +1 212 555 1234">b</a>'
    )
    assert [tuple(a) for a in one(spark, html, H.anchors)][:2] == [("/x?a=1&b=2", "One  two"), ("/y", "Y")]
    assert one(spark, html, H.frame_sources) == ["https://f.com/x"]
    assert one(spark, html, H.contact_metas) == ["/c"]
    assert one(spark, html, H.tel_link) == "+1 212 555 1234"


def test_json_ld(spark):
    def script(body):
        return f'<script type="application/ld+json">{body}</script>'

    listed = script('{"contactPoint":[{"email":"l@a.com","url":"/l"}],"email":"t@a.com"}')
    assert one(spark, listed, H.json_ld_email) == "l@a.com"
    broken = script('{"email":"x@a.com"') + script('{"email":"y@a.com","telephone":"(212) 555-1234"}')
    assert one(spark, broken, H.json_ld_email) == "y@a.com"
    assert one(spark, broken, H.json_ld_phone) == "(212) 555-1234"
    urls = script('{"contactPoint":{"email":"a"},"url":"/contact"}') + script('{"url":"/Contact-us"}') + script('{"url":"/x"}')
    assert one(spark, urls, lambda h: H.json_ld_contact_urls(h, ["contact"])) == ["/Contact-us"]


def test_relevance(spark):
    html = (
        '<div class="my-contact"><form class="contact-form"></form></div><p>Address: x</p><p>info@acme.com</p>'
    )
    assert abs(one(spark, html, lambda h: H.relevance(h, H.visible_text(h))) - 4.5 / 7) < 1e-9
    full = html + '<ul class="social"></ul><iframe class="map"></iframe>(212) 555-1234'
    assert one(spark, full, lambda h: H.relevance(h, H.visible_text(h))) == 1.0
    assert one(spark, "<p class=contact>x</p>", lambda h: H.relevance(h, H.visible_text(h))) == 0


def test_tree_shape(spark):
    html = "<div class='a'><p>one<p>two</div></b>é<br><ul><li>x<li><i>y</i></ul><!-- c --><script>a<b</script>"
    tree = one(spark, html, T.shred)
    nodes = {(n["tag"], n["id"]): n for n in tree["nodes"]}
    div = nodes[("div", 0)]
    # Nothing is closed on its own: the second paragraph lies in the first one.
    assert [n["tag"] for n in tree["nodes"]][:5] == ["div", "p", "#text", "p", "#text"]
    assert div["end"] == 4 and nodes[("p", 3)]["parent"] == 1
    assert all(n["id"] == i for i, n in enumerate(tree["nodes"]))
    assert tree["text"][div["t0"]:div["t1"]].split() == ["one", "two"]
    assert [n["text"] for n in tree["nodes"] if n["tag"] in ("#comment", "#script")] == [" c ", "a<b"]
    assert [n["text"] for n in tree["nodes"] if n["tag"] == "i"] == ["y"] and "a<b" not in tree["text"]


def test_tree_offsets_match_substrings(spark):
    html = "<nav><a href=/k>Kontäkt 😀</a></nav><footer>&nbsp;ünd</footer>"
    df = spark.createDataFrame([(html,)], "h string").select(T.shred(F.col("h")).alias("t"))
    rows = df.select("t.text", F.explode("t.nodes").alias("n")).select(
        "n.tag", T.subtree_text(F.col("n"), F.col("text")).alias("s")
    ).collect()
    text = {r["tag"]: r["s"].strip() for r in rows}
    assert text["a"] == "Kontäkt 😀" and text["footer"] == "ünd"


def test_json_leaves_keep_order(spark):
    objs = ['{"zmail":"z","n":{"b":["s",{"amail":"a"}],"k":1},"zmail":"y"}', "not json", '{"tel":"1"}']
    df = spark.createDataFrame([(objs,), ([],)], "o array<string>")
    leaves = df.select(T.json_leaves(F.col("o"))).collect()
    assert [(m["script_ord"], m["path"], m["value"]) for m in leaves[0][0]] == [
        (0, "$.zmail", "y"), (0, "$.n.b[1].amail", "a"), (2, "$.tel", "1")]
    assert leaves[1][0] is None
