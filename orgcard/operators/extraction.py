"""Contact candidates of a page by all extraction methods, in one pass and without a shuffle.

Each page stays one row: the methods fill an array of candidate structs. ``method_ord``:

0 JSON-LD (homepage only) · 1 page-builder links · 2 page-builder text · 3 contact sections ·
4 tel: link · 5 visible text · 6 markup properties · 7 microdata · 8 script text · 9 script objects ·
10..19 the same on framed pages · 20 RDFa (opt-in).

Methods 1, 4 and 9 override earlier values, the others only fill gaps (``source_class``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgcard import schemas
from orgcard.functions import contacts as C
from orgcard.functions import html as H
from orgcard.functions import tree as T
from orgcard.functions.text import built_once, first_where, let, strip
from orgcard.sources.dims import BUILDER_CLASSES, SECTION_CLASS

# Steps of a page visit in order: methods 1 and 2 alternate by container, 8 and 9 by script.
STAGE = {0: 0, 1: 1, 2: 1, 3: 2, 4: 3, 5: 4, 6: 5, 7: 6, 8: 7, 9: 7, 20: 8}
OVERRIDING = {1, 4, 9}

# Contact sections; the other markup that needs the element tree is found by plain search.
SECTION_TAG = (
    r"""(?i)<(?:div|section)\b[^>]*\sclass\s*=\s*(?:"[^">]*|'[^'>]*|[^\s"'>]*)"""
    "(?:contact|footer|header|info|details)"
)
# Without an address sign, or five digits or plus signs, or a character reference or escape that may stand for them, there
# is nothing to find.
MAY_HOLD_CONTACT = r"@|&commat;|&plus;|&#|\\|[0-9+](?:[^0-9+]*[0-9+]){4}"


def _candidate(
    method: int, kind: str, raw: Column, chunk: Column | None = None, always: Column | None = None
) -> Column:
    return F.struct(
        F.lit(method).alias("method_ord"),
        F.lit(STAGE[method]).alias("stage"),
        (F.lit(0) if chunk is None else chunk).alias("chunk_ord"),
        F.lit(kind).alias("kind"),
        F.lit("override" if method in OVERRIDING else "fill").alias("source_class"),
        (F.lit(False) if always is None else always).alias("always"),
        raw.alias("raw"),
    )


def _pair(method: int, email: Column, phone: Column, **kw) -> list[Column]:
    return [_candidate(method, "email", email, **kw), _candidate(method, "phone", phone, **kw)]


def _with_value(c: Column) -> Column:
    value = F.when(c["kind"] == "phone", C.format_phone(c["raw"])).otherwise(strip(c["raw"]))
    return c.withField("value", value)


def _builders(nodes: Column) -> Column:
    def of(name: str) -> Column:
        return F.filter(nodes, lambda n: T.has_class(n, name))

    return F.concat(*[of(c) for c in BUILDER_CLASSES])


def _sections(nodes: Column) -> Column:
    return F.filter(
        nodes, lambda n: n["tag"].isin("div", "section") & T.class_like(n, SECTION_CLASS)
    )


def _link_value(links: Column, prefix: str, decoded: bool) -> Column:
    chosen = F.filter(links, lambda a: F.contains(F.lower(a["href"]), F.lit(prefix)))
    values = F.transform(chosen, lambda a: strip(F.replace(a["href"], F.lit(prefix), F.lit(""))))
    return F.transform(values, lambda v: H.decode_escapes(v)) if decoded else values


def _builder_candidates(nodes: Column, text: Column, decoded: bool) -> Column:
    """Per container: overriding links, then the text of its paragraphs, spans and divisions.

    An element's text holds that of all elements in it, and comes first, so only the outermost ones are searched; so
    does a container inside one that comes before it, whose text then has nothing to add.
    """

    def of_all(containers: Column) -> Column:
        def of(container: Column, i: Column) -> Column:
            searched = F.exists(F.slice(containers, F.lit(1), i), lambda b: T.inside(container, b))
            return let(T.descendants(nodes, container), lambda own: from_nodes(own, i, searched))

        return F.flatten(F.transform(containers, of))

    def from_nodes(own: Column, i: Column, searched: Column) -> Column:
        links = F.filter(own, lambda n: (n["tag"] == "a") & n["href"].isNotNull())
        chunks = F.when(searched, F.array().cast("array<string>")).otherwise(F.transform(
            T.outermost(F.filter(own, lambda n: n["tag"].isin("p", "span", "div"))),
            lambda n: T.subtree_text(n, text),
        ))
        email = first_where(_link_value(links, "mailto:", decoded), C.is_valid_email)
        number = first_where(_link_value(links, "tel:", decoded), C.is_valid_phone)
        return F.array(
            *_pair(1, email, number, chunk=i, always=i == 0),
            *_pair(2, C.first_email_of(chunks), C.first_phone_raw_of(chunks), chunk=i),
        )

    return let(_builders(nodes), of_all)


def _section_chunks(nodes: Column) -> Column:
    """Strings met on a walk through the contact sections: attributes, then own text."""
    walk = F.flatten(
        F.transform(T.outermost(_sections(nodes)), lambda a: T.descendants(nodes, a, with_self=True))
    )
    parts = F.flatten(
        F.transform(
            walk,
            lambda n: F.array(n["href"], n["data_email"], n["data_phone"], n["content"], n["text"]),
        )
    )
    return F.filter(parts, lambda s: s.isNotNull())


def _microdata(nodes: Column, text: Column, prop: str, predicate) -> Column:
    def of(org: Column) -> Column:
        node = first_where(T.descendants(nodes, org), lambda n: n["itemprop"] == prop)
        value = let(node, lambda n: F.coalesce(n["content"], T.subtree_text(n, text)))
        return let(value, lambda v: F.when(predicate(v), v))

    orgs = F.filter(
        nodes, lambda n: F.coalesce(n["itemtype"].rlike("schema.org/Organization"), F.lit(False))
    )
    return first_where(F.transform(orgs, of), lambda v: v.isNotNull())


def _last_leaf(leaves: Column, keys: str, predicate) -> Column:
    fits = F.filter(leaves, lambda m: F.lower(m["key"]).rlike(keys) & predicate(m["value"]))
    return F.get(fits, F.size(fits) - 1)["value"]


def needs_tree(html: Column) -> Column:
    """Builder containers, microdata or contact sections occur."""
    found = F.contains(html, F.lit("schema.org/Organization"))
    for name in BUILDER_CLASSES:
        found = found | F.contains(html, F.lit(name))
    return found | html.rlike(SECTION_TAG)


@built_once
def _text_and_tree(wanted) -> tuple[Column, Column]:
    html = F.col("html")
    return H.visible_text(html), T.shred(F.when(wanted(html), html))


def with_trees(pages: DataFrame, wanted=needs_tree) -> DataFrame:
    """Add ``text`` (visible) and ``tree`` (NULL where ``wanted(html)`` does not hold)."""
    text, tree = _text_and_tree(wanted)
    return pages.withColumns({"text": text, "tree": tree})


@built_once
def _frame_sources() -> Column:
    return H.frame_sources(F.col("html"))


@built_once
def _script_columns() -> tuple[Column, Column]:
    objects = F.flatten(F.transform("scripts", H.object_literals))
    return H.scripts(F.col("html")), T.json_leaves(objects)


@built_once
def _walk_columns() -> dict[str, Column]:
    nodes = F.col("tree.nodes")
    n_blocks = F.coalesce(F.size(_builders(nodes)) + F.size(_sections(nodes)), F.lit(0))
    return {"chunks": _section_chunks(nodes), "n_blocks": n_blocks}


@built_once
def _candidates(boundary: bool, rdfa: bool, decoded: bool) -> Column:
    """All methods over the columns html, text, tree, scripts, leaves, chunks, n_blocks."""
    html, nodes, tree_text = F.col("html"), F.col("tree.nodes"), F.col("tree.text")
    text, chunks, leaves = F.col("text"), F.col("chunks"), F.col("leaves")
    bodies = F.transform("scripts", lambda s: H.decode_escapes(s)) if decoded else F.col("scripts")
    chunks = F.transform(chunks, lambda c: H.decode_escapes(c)) if decoded else chunks
    simple = [
        *_pair(0, H.json_ld_email(html), H.json_ld_phone(html)),
        *_pair(3, C.first_email_of(chunks), C.first_phone_raw_of(chunks)),
        _candidate(4, "phone", H.tel_link(html), always=F.col("n_blocks") <= 0),
        *_pair(5, C.first_email(text), C.first_phone_raw(text, boundary)),
        *_pair(6, C.markup_email(html), C.markup_phone_raw(html)),
        *_pair(
            7, _microdata(nodes, tree_text, "email", C.is_valid_email),
            _microdata(nodes, tree_text, "telephone", C.is_valid_phone),
        ),
        *_pair(8, C.first_email_of(bodies), C.first_phone_raw_of(bodies)),
        *_pair(
            9, _last_leaf(leaves, "mail", C.is_valid_email),
            _last_leaf(leaves, "phone|tel", C.is_valid_phone), always=F.lit(True),
        ),
    ]
    if rdfa:
        inner = F.transform(C.rdfa_contacts(html), lambda m: H.visible_text(m))
        simple += _pair(20, C.first_email_of(inner), C.first_phone_raw_of(inner))
    raw_type = f"array<{schemas.RAW_CANDIDATE}>"
    found = F.concat(
        F.array(*simple).cast(raw_type),
        F.coalesce(_builder_candidates(nodes, tree_text, decoded).cast(raw_type), F.array().cast(raw_type)),
    )
    return F.transform(F.filter(found, lambda c: c["raw"].isNotNull()), _with_value)


def promising(html: Column, deobfuscated: bool = False, decoded: bool = False, **_) -> Column:
    """Whether anything can be found on a page; with rewrites, that is open."""
    return F.lit(True) if deobfuscated or decoded else html.rlike(MAY_HOLD_CONTACT)


def with_candidates(
    prepared: DataFrame, keep: list[str], deobfuscated: bool = False, decoded: bool = False,
    boundary: bool = False, rdfa: bool = False,
) -> DataFrame:
    """``keep`` and the candidates of pages with the columns html, text and tree."""
    scripts, leaves = _script_columns()
    prepared = prepared.withColumn("scripts", scripts).withColumn("leaves", leaves)
    if deobfuscated or decoded:
        text = H.decode_escapes(F.col("text")) if decoded else F.col("text")
        prepared = prepared.withColumn("text", C.canonical_text(text, deobfuscated))
    return prepared.withColumns(_walk_columns()).select(*keep, _candidates(boundary, rdfa, decoded).alias("candidates"))


def page_evidence(pages: DataFrame, **options) -> DataFrame:
    """(page_id, url, [url_key,] frames, candidates) of (page_id, url, [url_key,] html).

    Options: ``deobfuscated`` (rewrites the text), ``decoded`` (escapes in text, scripts, sections and links), ``boundary`` (phones in digit runs), ``rdfa``.
    """
    keep = [c for c in pages.columns if c != "html"]
    html = F.col("html")
    base = pages.select(*keep, F.when(promising(html, **options), html).alias("html"), _frame_sources().alias("frames"))
    return with_candidates(with_trees(base), [*keep, "frames"], **options)


def page_errors(pages: DataFrame) -> DataFrame:
    """(page_id, url, error) of the pages whose element tree breaks off; what was read before counts, and other pages go on."""
    shredded = with_trees(pages.select("page_id", "url", "html"), lambda html: html.isNotNull())
    return shredded.select("page_id", "url", F.col("tree.error").alias("error")).filter(F.col("error").isNotNull())


def page_candidates(pages: DataFrame, **options) -> DataFrame:
    """Long form of :func:`page_evidence`: one row per candidate.

    The generator is an outer one because Spark tests the size of the array before a plain one,
    which would run the whole extraction twice.
    """
    evidence = page_evidence(pages, **options)
    keep = [c for c in evidence.columns if c not in ("candidates", "frames")]
    rows = evidence.select(*keep, F.inline_outer("candidates"))
    return rows.filter(F.col("method_ord").isNotNull())


@built_once
def _page_picks() -> tuple[Column, Column]:
    """Where both values are known, and the winners, over the columns candidates and cutoff."""

    def rank(c: Column) -> Column:
        return F.struct(c["stage"], c["chunk_ord"])

    def known_at(kind: str) -> Column:
        own = F.filter("candidates", lambda c: c["kind"] == kind)
        return F.array_min(F.transform(own, rank))

    both = known_at("email").isNotNull() & known_at("phone").isNotNull()
    cutoff = F.when(both, F.greatest(known_at("email"), known_at("phone")))

    def ranked(kind: str, source: str) -> Column:
        def counts(c: Column) -> Column:
            mine = (c["kind"] == kind) & (c["source_class"] == source)
            if source == "fill":
                return mine
            return mine & (c["always"] | F.col("cutoff").isNull() | (rank(c) <= F.col("cutoff")))

        return F.transform(
            F.filter("candidates", counts),
            lambda c: F.struct(c["stage"], c["chunk_ord"], c["method_ord"], c["value"]),
        )

    def pick(kind: str) -> Column:
        last = F.array_max(ranked(kind, "override"))["value"]
        return F.coalesce(last, F.array_min(ranked(kind, "fill"))["value"]).alias(kind)

    return cutoff, F.struct(pick("email"), pick("phone"))


def first_contacts(pages: DataFrame, **options) -> DataFrame:
    """One e-mail and phone per page, each page taken by itself (see ``picking`` for sites)."""
    evidence = page_evidence(pages, **options)
    keep = [c for c in evidence.columns if c not in ("candidates", "frames")]
    cutoff, row = _page_picks()
    # A generator keeps later filters on the result from repeating the work above.
    return evidence.withColumn("cutoff", cutoff).select(*keep, F.inline(F.array(row)))


__all__ = ["page_evidence", "page_candidates", "first_contacts", "with_trees"]
