"""Main text of pages by a site style tree.

The DOMs of one host's pages are merged by style path (tags and classes from the root down). A node of the tree has, over
the m pages that show it, the distribution of its presentations (sequence of child styles) and of its contents (text of
the branch). Its importance is the entropy of the presentations (base m) and, weighted by GAMMA to the power of the
child styles, the share of content that is not repeated on other pages: 1 minus the mean of log_m of the pages that show
the same. A branch that looks and reads alike on many pages has importance 0, one that differs on each has 1.

Removed from each page are branches below `least` importance, if at least `pages` pages show them and they are not inside
an article or main element; and branches whose role gives them none whatever they hold: navigation, header (outside an
article), footer, aside, form and dialog elements, such ARIA roles, hidden ones, and those with a class or id made only
of words for menus, adverts, notices, reader comments and the like (cookie-notice, but not content-sidebar-wrap or
no-sidebar, which the tree judges). If the page has an article (else a main element) with text left, that is the text;
else all that is left, and with it any article or main that only the name of an element around it would take away.

Tasks merge their pages' trees before anything is exchanged; a host's nodes are spread by path and value, so a host with
a third of all pages overloads none. Pages travel once, compressed, to meet their low branches.

Blocks are the texts between block-level tags; character references are decoded, white space becomes one blank, blocks
are joined by two line feeds. Broken markup is read like browsers do in the main: unclosed p, li, td and inline tags end
with what ends them, a stray end tag is ignored, an unclosed script, style or comment runs to the end.

Results for special cases: a null or empty html has text ''; a page with a null or broken url is a host of its own;
equal rows give equal rows (and count as two pages of a host); a null page_id comes back null; texts are never cut.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgcard.llm import common

LEAST, PAGES, GAMMA = 0.3, 4, 0.9
NEUTRAL, NOISE, KEPT, NAMED = 0, 1, 2, 3  # NAMED: noise by a class or id only
FINE, RESCUED, GONE = 0, 1, 2  # RESCUED: below a NAMED element that stands in no article or main

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"'<]++|"[^"<]*+"|'[^'<]*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg canvas object xmp noembed noframes math audio video select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike "
                   "strong sub sup time tt u var wbr br".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                   "header hgroup hr main menu nav ol p pre section table ul".split())
ENDS = {"li": (("li",), ("ul", "ol", "menu")), "dd": (("dd", "dt"), ("dl",)), "dt": (("dd", "dt"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)),
        "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tbody": (("tr", "tbody", "thead"), ("table",)),
        "option": (("option",), ("select",))}
NOISE_TAGS = frozenset("nav aside footer form dialog menu button head".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
NOISE_WORDS = frozenset("""nav navbar navigation menu menus breadcrumb breadcrumbs masthead footer sidebar aside ad ads advert adverts advertisement
    advertising adsense banner banners sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert alerts popup modal overlay
    newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments disqus replies respond
    widget widgets toolbar pagination pager copyright""".split())
HEADS = frozenset(("header", "masthead", "banner"))


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)} if text else {}


def style_of(tag: str, attrs: dict[str, str]) -> str:
    names = attrs.get("class")
    return f"{tag}.{'.'.join(sorted(names.split()))}" if names else tag


def role_of(tag: str, attrs: dict[str, str], in_article: bool) -> int:
    """What an element is by name, whatever it holds."""
    if tag in ("article", "main") or attrs.get("role") in ("article", "main"):
        return KEPT
    if tag in NOISE_TAGS or tag == "header" and not in_article:
        return NOISE
    if not attrs or tag in ("html", "body"):
        return NEUTRAL
    names = [{w.lower() for w in WORD.findall(x) if not w.isdigit()} for a in ("class", "id") if a in attrs for x in attrs[a].split()]
    noise = NOISE_WORDS - HEADS if in_article else NOISE_WORDS | HEADS
    hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "")
    if hidden or attrs.get("role", "").lower() in NOISE_ROLES:
        return NOISE
    return NAMED if any(x and x <= noise for x in names) else NEUTRAL


class Node:
    """An open element: its path's hash, the article (2) or main (1) it stands in, whether it is to go (FINE, RESCUED or GONE), and the digest of
    what it has held; a plain inline element shares that of the one around it."""

    __slots__ = ("tag", "path", "inside", "low", "read", "plain")

    def __init__(self, tag: str, path: int, inside: int, low: int, read, plain: bool):
        self.tag, self.path, self.inside, self.low, self.read, self.plain = tag, path, inside, low, read, plain


def blocks_of(text: str, host: str, low=frozenset(), tree: dict | None = None):
    """(inside, FINE, RESCUED or GONE, text) of each block; with tree, fills it with each path's role, presentation and content."""
    stack = [Node("", xxhash.xxh3_64_intdigest(host), 0, FINE, xxhash.xxh3_64(), True)]
    at, held, out, many = 0, [], [], Counter()

    def flush():
        block = " ".join("".join(held).split()) if held else ""
        held.clear()
        if block:
            top = stack[-1]
            out.append((top.inside, top.low, block))
            top.read.update(block)

    def close(depth: int):
        if not all(x.tag in INLINE for x in stack[depth:]):
            flush()
        while len(stack) > depth:
            node = stack.pop()
            many[node.tag] -= 1
            if not node.plain:
                digest = node.read.digest()
                stack[-1].read.update(digest)
                if tree is not None:
                    tree[node.path][2].update(digest)

    def open_element(tag: str, raw: str):
        attrs = attributes(raw)
        if tag in ENDS_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag not in INLINE:
                    break
        elif tag in ENDS:
            ended, scope = ENDS[tag]
            first = None
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in ended:
                    first = k
                elif stack[k].tag in scope:
                    break
            if first is not None:
                close(first)
        if tag not in INLINE:
            flush()
        if tag in VOID:
            return
        above = stack[-1]
        inline = tag in INLINE and not attrs
        role = NEUTRAL if inline else role_of(tag, attrs, above.inside == 2)
        inside = above.inside if role != KEPT else max(above.inside, 2 if tag == "article" or attrs.get("role") == "article" else 1)
        if inline:
            path = above.path
        else:
            style = style_of(tag, attrs)
            path = xxhash.xxh3_64_intdigest(f"{style} {role}", above.path)
            if tree is not None:
                if path not in tree:
                    tree[path] = [NOISE if role in (NOISE, NAMED) else KEPT if inside else NEUTRAL, xxhash.xxh3_64(), xxhash.xxh3_64()]
                if above.path in tree:
                    tree[above.path][1].update(style + " ")
        many[tag] += 1
        gone = FINE if inline or path not in low else RESCUED if role == NAMED and not above.inside else GONE
        stack.append(Node(tag, path, inside, max(above.low, gone), above.read if inline else xxhash.xxh3_64(), inline))

    last = max(text.rfind(">"), text.rfind("<!"))
    while at < len(text):
        m = TOKEN.search(text, at) if at <= last else None
        if m is None:
            held.append(html.unescape(text[at:]))
            break
        if m.start() > at:
            held.append(html.unescape(text[at:m.start()]))
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        tag, ending, raw = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if ending:
            for k in range(len(stack) - 1, 0, -1) if many[tag] else ():
                if stack[k].tag == tag:
                    close(k)
                    break
                if tag in INLINE and stack[k].tag not in INLINE:
                    break
        elif tag == "br":
            held.append(" ")
        elif tag in RAW:
            if not raw.rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(text, at)
                at = end.end() if end else len(text)
        else:
            open_element(tag, raw)
    flush()
    close(1)
    return out


def host_of(url: str | None, key: int) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:\s]+)", url or "")
    return m[1].lower() if m else f"page {key}"


def main_text(blocks) -> str:
    best = max((inside for inside, low, _ in blocks if low == FINE), default=0)
    if best:
        return "\n\n".join(b for inside, low, b in blocks if low == FINE and inside == best)
    return "\n\n".join(b for inside, low, b in blocks if low == FINE or low == RESCUED and inside)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def low_branches(pages: DataFrame, least: float, min_pages: int) -> DataFrame:
    """(key, path) of the branches of each page that are to be removed."""

    def merge(batches):
        for batch in batches:
            rows = []
            for key, url, data in zip(batch.column("key").to_pylist(), batch.column("url").to_pylist(), common.texts_of(batch.column("html"))):
                tree: dict = {}
                blocks_of(data.decode("utf-8", "replace"), host_of(url, key), tree=tree)
                rows += [(key, signed(p), role, signed(a.intdigest()), signed(b.intdigest())) for p, (role, a, b) in tree.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 5, (pa.int64(), pa.int64(), pa.int8(), pa.int64(), pa.int64()))],
                                             names=["key", "path", "role", "presentation", "content"])

    nodes = common.stored(pages.mapInArrow(merge, "key long, path long, role byte, presentation long, content long"))
    values = nodes.select("path", "role", F.posexplode(F.array("presentation", "content")).alias("kind", "value"))
    counts = values.groupBy("path", "role", "kind", "value").agg(F.count("*").alias("c"))
    # sum of c log c over the values gives both: entropy = log m - sum / m, and mean of log c over pages = sum / m
    spread = counts.groupBy("path", "role").agg(
        F.sum(F.when(F.col("kind") == 0, F.col("c"))).alias("m"),
        (F.sum(F.when(F.col("kind") == 0, F.col("c") * F.log("c"))) / F.sum(F.when(F.col("kind") == 0, F.col("c")))).alias("looks"),
        (F.sum(F.when(F.col("kind") == 1, F.col("c") * F.log("c"))) / F.sum(F.when(F.col("kind") == 1, F.col("c")))).alias("reads"))
    node = F.when(F.col("m") > 1, 1 - F.col("looks") / F.log("m")).otherwise(1.0)
    content = F.when(F.col("m") > 1, 1 - F.col("reads") / F.log("m")).otherwise(1.0)
    importance = (1 - GAMMA) * node + GAMMA * content
    low = spread.where((F.col("role") == NOISE) | (F.col("role") == NEUTRAL) & (F.col("m") >= min_pages) & (importance < least)).select("path")
    return nodes.select("key", "path").join(common.cut(low), "path").select("key", "path").distinct()


def extracted(pages: DataFrame, least: float = LEAST, min_pages: int = PAGES, id_col: str = "page_id", url_col: str = "url",
              html_col: str = "html") -> DataFrame:
    """Per row of pages: key, url, text and n_chars."""
    pages = pages.select(common.id_or_last(id_col).alias("key"), F.col(url_col).cast("string").alias("url"),
                         F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("html"))
    pages = pages.withColumn("page", F.xxhash64("key", "url", "html"))  # so that pages without an id, or of one id, stay apart
    low = low_branches(pages.select(F.col("page").alias("key"), "url", "html"), least, min_pages).groupBy(F.col("key").alias("page")).agg(F.collect_list("path").alias("paths"))

    def compress(batches):
        for batch in batches:
            data = [zstandard.ZstdCompressor(level=3).compress(x) for x in common.texts_of(batch.column("html"))]
            yield batch.drop_columns(["html"]).append_column("html", pa.array(data, pa.binary()))

    def extract(batches):
        for batch in batches:
            texts = []
            for page, url, data, paths in zip(*(batch.column(c).to_pylist() for c in ("page", "url", "html", "paths"))):
                text = zstandard.ZstdDecompressor().decompress(data).decode("utf-8", "replace")
                texts.append(main_text(blocks_of(text, host_of(url, page), frozenset(p & (1 << 64) - 1 for p in paths or ()))))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("url"), pa.array(texts, pa.string()),
                                              pa.array([len(x) for x in texts], pa.int64())], names=["key", "url", "text", "n_chars"])

    packed = pages.mapInArrow(compress, "key long, url string, page long, html binary")
    return packed.join(low, "page", "left").mapInArrow(extract, "key long, url string, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    out = extracted(common.table(spark, sf_dir, "pages"))
    return out.select(common.id_or_null("key").alias("page_id"), "url", "text", "n_chars")
