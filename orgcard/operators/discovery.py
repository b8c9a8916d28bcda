"""Contact pages of a site: links, structured data, sitemaps, common paths; score; best three."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orgcard.functions import html as H
from orgcard.functions import tree as T
from orgcard.functions.text import built_once, contains_any, let
from orgcard.functions.urls import (
    authority, contact_score, host, is_valid_url, resolve, scheme, url_key,
)
from orgcard.operators.extraction import with_trees
from orgcard.operators.storage import materialize
from orgcard.sources import dims
from orgcard.sources.pages import fetch

SOURCES = ["homepage", "header", "footer", "main-nav", "json-ld", "meta", "sitemap", "common-path"]


def needs_tree(html: Column) -> Column:
    return html.rlike(r"(?i)<(?:nav|header|footer)\b|(?:main|primary|global)-nav")


def is_contact_reference(
    href: Column, text: Column, terms: list[str], patterns: bool = False
) -> Column:
    """The reference or its text holds a contact term (or, on request, fits a contact pattern)."""
    low = F.lower(href)
    hit = contains_any(low, terms) | contains_any(F.lower(text), terms)
    if patterns:
        prefix = [host(href).startswith(p) for p in dims.host_prefixes()]
        hit = hit | low.rlike(dims.reference_pattern())
        for p in prefix:
            hit = hit | F.coalesce(p, F.lit(False))
    return F.coalesce(hit, F.lit(False))


def _absolute(base: Column, hrefs: Column) -> Column:
    urls = F.transform(hrefs, lambda h: resolve(base, h))
    return F.filter(urls, lambda u: is_valid_url(u))


def _tagged(source: int, urls: Column) -> Column:
    return F.transform(
        urls, lambda u: F.struct(F.lit(source).alias("source_ord"), u.alias("url"))
    )


def _area_links(
    source: int, base: Column, areas: Column, terms: list[str], patterns: bool
) -> Column:
    """Contact references inside the areas (an anchor in nested areas occurs once for each)."""
    nodes, text = F.col("tree.nodes"), F.col("tree.text")

    def of(area: Column) -> Column:
        anchors = F.filter(
            T.descendants(nodes, area),
            lambda n: (n["tag"] == "a")
            & n["href"].isNotNull()
            & is_contact_reference(n["href"], T.subtree_text(n, text), terms, patterns),
        )
        return F.transform(anchors, lambda n: resolve(base, n["href"]))

    urls = F.filter(F.flatten(F.transform(areas, of)), lambda u: is_valid_url(u))
    return _tagged(source, F.coalesce(urls, F.array().cast("array<string>")))


@built_once
def homepage_columns(terms: tuple[str, ...], patterns: bool) -> tuple[Column, Column]:
    """Contact page sources and sitemap addresses over the columns html, url, text, tree."""
    html, base, nodes = F.col("html"), F.col("url"), F.col("tree.nodes")
    none = F.array().cast("array<string>")
    header = F.filter(nodes, lambda n: n["tag"].isin("header", "nav"))
    footer = F.filter(nodes, lambda n: n["tag"] == "footer")
    main_nav = F.filter(nodes, lambda n: T.class_like(n, dims.NAV_CLASS))
    own = F.when(H.relevance(html, F.col("text")) > dims.SELF_RELEVANCE, F.array(base)).otherwise(none)
    sources = F.concat(
        _tagged(0, own),
        *[
            _area_links(i + 1, base, areas, list(terms), patterns)
            for i, areas in enumerate((header, footer, main_nav))
        ],
        _tagged(4, F.transform(H.json_ld_contact_urls(html, list(terms)), lambda u: resolve(base, u))),
        _tagged(5, F.transform(H.contact_metas(html), lambda u: resolve(base, u))),
    )
    sitemaps = F.when(
        html.rlike("(?i)href[^>]*sitemap"),
        F.transform(
            F.filter(H.anchors(html), lambda a: a["href"].rlike("(?i)sitemap")),
            lambda a: resolve(base, a["href"]),
        ),
    ).otherwise(none)
    return sources, sitemaps


def homepage_links(homes: DataFrame, terms: list[str] | None = None, patterns: bool = False) -> DataFrame:
    """(site_key, url, sources[], sitemaps[]) of homepages (site_key, url, html).

    ``sources`` are contact page addresses with their source, found on the homepage itself.
    """
    terms = dims.literal_terms() if terms is None else terms
    sources, sitemaps = homepage_columns(tuple(terms), patterns)
    return with_trees(homes, needs_tree).select(
        "site_key", "url", sources.alias("sources"), sitemaps.alias("sitemaps")
    )


def probes(homes: DataFrame, paths: list[str] | None = None) -> DataFrame:
    """(site_key, url, probe_url): the common contact paths (absolute) of each site."""
    paths = dims.COMMON_PATHS if paths is None else paths
    root = F.concat(scheme(F.col("url")), F.lit("://"), authority(F.col("url")))
    return homes.select("site_key", "url", root.alias("root")).select(
        "site_key", "url", F.explode(F.array(*[F.lit(p) for p in paths])).alias("path"), "root"
    ).select("site_key", "url", F.concat("root", "path").alias("probe_url"))


def site_root(url: Column) -> Column:
    """Scheme and host of a URL as they stand in keys."""
    return F.lower(F.concat(scheme(url), F.lit("://"), authority(url)))


def probed_roots(key: Column, paths: list[str] | None = None) -> Column:
    """The other way round: (root, path) of the sites whose probes would ask for a ``url_key``."""
    paths = dims.COMMON_PATHS if paths is None else paths
    ends = [(p, p.rstrip("/")) for p in paths]  # as keys have them
    return F.array_compact(F.array(*[
        F.when(key.endswith(end), F.struct(F.substring(key, F.lit(1), F.length(key) - len(end)).alias("root"), F.lit(p).alias("path")))
        for p, end in ends
    ]))


def page_relevance(pages: DataFrame) -> DataFrame:
    """(page_id, url, relevance) of pages."""
    text = pages.select("page_id", "url", "html", H.visible_text(F.col("html")).alias("text"))
    return text.select(
        "page_id", "url", F.round(H.relevance(F.col("html"), F.col("text")), 6).alias("relevance")
    )


@built_once
def _second_level_columns() -> list[Column]:
    html = F.col("html")
    return [
        F.when(F.col("is_probe"), let(html, lambda h: H.relevance(h, H.visible_text(h)))).alias("relevance"),
        F.when(F.col("is_map"), H.sitemap_locations(html)).alias("locations"),
        F.when(F.col("is_map"), H.anchors(html)).alias("anchors"),
    ]


@built_once
def _second_level_found(terms: tuple[str, ...], patterns: bool) -> Column:
    """Accepted addresses of an answer; both kinds leave through one generator, so that the pages
    are read and scored once."""
    listed = F.filter("locations", lambda u: contains_any(F.lower(u), list(terms)) & is_valid_url(u))
    anchors = F.filter(
        "anchors", lambda a: is_contact_reference(a["href"], a["text"], list(terms), patterns)
    )
    absolute = _absolute(F.col("base"), F.transform(anchors, lambda a: a["href"]))
    verified = F.when(F.col("relevance") > dims.PROBE_RELEVANCE, F.array("wanted"))
    return F.when(F.col("purpose") == "probe", _tagged(7, verified)).otherwise(
        _tagged(6, F.concat(listed, absolute))
    )


def _second_level(pages: DataFrame, links: DataFrame, terms: list[str], patterns: bool) -> DataFrame:
    """Contact pages that need a further page: sitemap entries and verified common paths."""
    sitemaps = links.select(
        "site_key", F.col("url").alias("base"), F.lit("sitemap").alias("purpose"),
        F.explode("sitemaps").alias("wanted"),
    )
    guesses = probes(links).select(
        "site_key", F.col("url").alias("base"), F.lit("probe").alias("purpose"),
        F.col("probe_url").alias("wanted"),
    )
    requests = sitemaps.unionByName(guesses).withColumn("url_key", url_key(F.col("wanted")))
    known = links.select(F.count("*"), F.sum(F.size("sitemaps"))).first()
    body = fetch(
        pages, requests, rows=known[0] * len(dims.COMMON_PATHS) + (known[1] or 0),
        is_probe=F.bool_or(F.col("purpose") == "probe"), is_map=F.bool_or(F.col("purpose") == "sitemap"),
    ).select("url_key", *_second_level_columns())
    found = _second_level_found(tuple(terms), patterns)
    answers = requests.join(body, "url_key").select("site_key", F.inline_outer(found))
    return answers.filter(F.col("url").isNotNull())


def top_per_key(df: DataFrame, key: str, order: list[Column], n: int, rank: str = "rn") -> DataFrame:
    """First ``n`` rows per key. Spark cuts each key to n rows before the shuffle, hot keys included."""
    window = Window.partitionBy(key).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)


def rank_contact_pages(found: DataFrame, n: int = dims.TOP_CONTACT_PAGES) -> DataFrame:
    """Best pages per site of (site_key, source_ord, url): score, then URL."""
    distinct = (
        found.withColumn("url_key", url_key(F.col("url")))
        .groupBy("site_key", "url_key")
        .agg(F.min("source_ord").alias("source_ord"), F.min("url").alias("url"))
        .withColumn("score", contact_score(F.col("url")))
    )
    best = top_per_key(distinct, "site_key", [F.col("score").desc(), F.col("url")], n)
    names = F.array(*[F.lit(s) for s in SOURCES])
    return best.select(
        "site_key", "url", "url_key", F.get(names, F.col("source_ord")).alias("source"), "score", "rn"
    )


def contact_pages(
    pages: DataFrame, homes: DataFrame, terms: list[str] | None = None, patterns: bool = False
) -> DataFrame:
    """Ranked contact pages of the sites whose homepages are given."""
    terms = dims.literal_terms() if terms is None else terms
    links = materialize(homepage_links(homes, terms, patterns), "homepage_links")
    direct = links.select("site_key", F.inline("sources"))
    return rank_contact_pages(direct.unionByName(_second_level(pages, links, terms, patterns)))
