"""Main text of pages: hand-made cases, and the tree's importance against a plain computation."""

import html
import math
import os
import re

import pytest

from orgcard.llm import common, styletree

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SCHEMA = "page_id long, url string, html string, key string, path long, text string"


def run(spark, rows, **options):
    docs = spark.createDataFrame([(i, u, h, "k", 1, "t") for i, u, h in rows], SCHEMA)
    return {(None if r.key == common.NO_ID else r.key): r for r in styletree.extracted(docs, **options).collect()}


def test_given_pages(spark):
    """The test pages have one article each, so a pattern can tell its text."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    out = {r.key: r for r in styletree.extracted(pages).collect()}
    for r in pages.collect():
        article = re.search(r"(?s)<article>(.*?)</article>", r.html)[1]
        blocks = [" ".join(html.unescape(re.sub("</?b>", "", x.replace("<br>", " "))).split()) for x in re.split("</?(?:p|h1)>", article)]
        want = "\n\n".join(x for x in blocks if x)
        assert out[r.page_id].text == want and out[r.page_id].n_chars == len(want) and out[r.page_id].url == r.url


CASES = [
    ("<body><nav>menu</nav><article><h1>T</h1><p>a &amp; b&nbsp;c<br>d<p>second <b>bold</b>er</article><footer>f</footer>", "T\n\na & b c d\n\nsecond bolder"),
    ("<header>x</header><main><header>Title</header><p>x</p><div class='side-bar sidebar'>no</div><section id='comments'><article><p>me too</p></article></section></main>", "x"),
    ("<article><header><h1>In</h1></header><div class='entry-header'>Sub</div><p>Text</p><form>mail <input></form><div class='advert'>buy</div><aside>s</aside><footer>by</footer></article>", "In\n\nSub\n\nText"),
    ("<div class='cookie-notice'>We</div><div><p>one<p>two</div><div role=navigation>n</div><div hidden>h</div><div style='display: none'>z</div>", "one\n\ntwo"),
    ("<p>a<script>var x='</p><p>no';</script>b</p><style>p{}</style><!-- c <p>d</p> --><p>e", "ab\n\ne"),
    ("<p>x <!-- never closed <p>y</p>", "x"),
    ("<p>x<script>never closed <p>y</p>", "x"),
    ("<ul><li>one<li>two <i>it</ul><table><tr><td>a<td>b<tr><td>c</table>", "one\n\ntwo it\n\na\n\nb\n\nc"),
    ("a &lt;b&gt; &#233;&#x20AC; &am &unknown; 1 < 2", "a <b> é€ &am &unknown; 1 < 2"),
    ("</div></p>stray<a href=\"x>y\">link</a>", "straylink"),
    ("", ""), (None, ""), ("<nav>only</nav>", ""), ("plain  text\n\tof one block", "plain text of one block"),
]


@pytest.mark.parametrize("page,want", CASES)
def test_cases(page, want):
    tree: dict = {}
    styletree.blocks_of(page or "", "h", tree=tree)
    low = frozenset(p for p, v in tree.items() if v[0] == styletree.NOISE)
    assert styletree.main_text(styletree.blocks_of(page or "", "h", low)) == want


def test_repeated_branches_go(spark):
    """Without telling names: what repeats on a host goes, what differs stays, other hosts do not count."""
    page = "<div class=top>Same menu <a>here</a></div><div class=c><p>Story {0} of its own</p></div><div class=b>All rights</div>"
    rows = [(i, f"http://one.example/{i}", page.format(i)) for i in range(8)]
    rows += [(100 + i, f"http://user@two.example:80/{i}", page.format(i)) for i in range(2)]
    rows += [(200, None, page.format(1)), (None, "::", page.format(2)), (201, "http://one.example/x", None), (201, "http://one.example/x", "")]
    out = run(spark, rows)
    assert all(out[i].text == f"Story {i} of its own" for i in range(8))
    assert all(out[100 + i].text == f"Same menu here\n\nStory {i} of its own\n\nAll rights" for i in range(2))
    assert out[200].text.startswith("Same menu") and out[None].text.startswith("Same menu") and out[201].text == ""


def test_repeated_articles_stay(spark):
    rows = [(i, f"http://one.example/{i}", "<article><p>The same story</p></article><p>x</p>") for i in range(9)]
    assert {r.text for r in run(spark, rows).values()} == {"The same story"}


def test_importance_against_plain_computation(spark):
    pages = [("<div class=a>x</div><div class=b><p>u%d</p></div>" % i) + ("<div class=c>%d</div>" % (i // 3)) for i in range(9)]
    rows = spark.createDataFrame([(i, "http://h/", p, "k", 1, "t") for i, p in enumerate(pages)], SCHEMA)
    narrow = rows.selectExpr("page_id as key", "url", "cast(html as binary) as html")

    def importance(contents):
        m = len(contents)
        looks = 0.0  # every page shows the same child styles
        reads = sum(math.log(contents.count(c), m) for c in contents) / m
        return (1 - styletree.GAMMA) * looks + styletree.GAMMA * (1 - reads)

    values = {"a": importance(["x"] * 9), "b": importance(list(range(9))), "c": importance([i // 3 for i in range(9)])}
    for least in (0.05, 0.3, 0.44, 0.46, 0.95):
        gone = styletree.low_branches(narrow, least, 4).groupBy("path").count().count()
        # b holds a p of like importance
        assert gone == (values["a"] < least) + 2 * (values["b"] < least) + (values["c"] < least)


def test_long_and_broken_pages_are_linear():
    import time
    for page in ("<p>" * 200_000, "<div class='" * 50_000, "<!--" * 100_000, "<script>" * 100_000, "<b>" * 30_000 + "x", "<" * 300_000, "word " * 400_000):
        start = time.process_time()
        styletree.main_text(styletree.blocks_of(page, "h", tree={}))
        assert time.process_time() - start < 20


def test_empty(spark):
    assert run(spark, []) == {}


WRAPPED = ["<div class='{0}'><article><p>story</p></article></div>", "<div id='{0}'><div><main><p>story</p></main></div></div>", "<div class='{0}'><p>story</p></div>"]


@pytest.mark.parametrize("page", WRAPPED)
@pytest.mark.parametrize("name", ["content-sidebar-wrap", "has-sidebar", "no-sidebar", "sidebar-right", "with-footer", "header-fixed", "no-comments",
                                  "elementor-widget-container", "elementor-widget-theme-post-content"])
def test_wrappers_keep_their_text(page, name):
    test_cases("<nav>menu</nav>" + page.format(name), "story")


@pytest.mark.parametrize("page,want", [
    ("<div class='sidebar page'><p>menu</p><article><p>story</p><div class='comments'>me</div></article></div>", "story"),
    ("<div id='comments'><article>me too</article></div><main><p>story</p></main>", "story"),
    ("<div class='widget'><article>teaser</article></div><p>story</p>", "teaser\n\nstory"),
    ("<div class='widget'><nav><article>no</article></nav></div><div class='ad-300 cookie-notice'>no</div><p>story</p>", "story"),
])
def test_articles_below_named_elements(page, want):
    test_cases(page, want)


def test_pages_without_id_and_url_are_hosts_of_their_own(spark):
    rows = [(None, None, f"<div class=top>menu</div><p>story {i}</p>") for i in range(6)]
    docs = spark.createDataFrame([(i, u, h, "k", 1, "t") for i, u, h in rows], SCHEMA)
    assert sorted(r.text for r in styletree.extracted(docs).collect()) == [f"menu\n\nstory {i}" for i in range(6)]
