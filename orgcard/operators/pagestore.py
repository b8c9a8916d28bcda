"""Pages as a store: one narrow row of links for each URL, and one scan of markup that answers all requests.

Which pages a job needs follows from links alone: contact references, sitemaps and frames. :func:`link_rows` finds them
once, by native expressions over all pages; the closure of the requests (homepage, probed paths, sitemap, listed page,
frame) is then a few joins of narrow tables. The requests of a page are merged into one row with a bit for each purpose, and
:func:`answers` reads the markup of the requested pages once and returns what all purposes want from it, again narrow.

The links that lead on are a superset of those that the element tree confirms, but for odd markup that only the tree reads; callers ask
:func:`unanswered` for what is left, which is nothing on a usual crawl, and answer that by a further scan.

Markup moves only if a crawl that was not stored has more requests than may be broadcast. A stored one (:func:`save_store`) is
bucketed by ``url_key``, so its join with the requests moves none however many there are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orgcard.functions import html as H
from orgcard.functions import tree as T
from orgcard.functions.text import built_once, contains_any
from orgcard.functions.urls import authority, is_valid_url, resolve, scheme, url_key
from orgcard.operators import discovery, extraction, resolution
from orgcard.operators.storage import BROADCAST_ROWS, materialize
from orgcard.sources import dims
from orgcard.sources.pages import fresh, with_url_key

HOME, PROBE, MAP, VISIT = 1, 2, 4, 8  # purposes of a request; a frame is read as a visit is
EVIDENCE = VISIT | HOME
LINKS = ["page_id", "url", "contact_hrefs", "declared", "sitemap_hrefs", "locations", "frame_keys", "listed"]


@dataclass(frozen=True)
class PageStore:
    """``pages(page_id, url, html, ...)``, and ``links`` with one row for each ``url_key``, that of its newest page."""

    pages: DataFrame
    links: DataFrame
    terms: tuple[str, ...]
    patterns: bool
    keyed: bool = False  # pages hold one row for each url_key and are bucketed by it


def _unique(urls: Column) -> Column:
    return F.array_distinct(F.coalesce(urls, F.array().cast("array<string>")))


@built_once
def _link_columns(terms: tuple[str, ...], patterns: bool, directories: tuple[str, ...]) -> list[Column]:
    """Over the columns html, url, anchors."""
    html, anchors = F.col("html"), F.col("anchors")
    hrefs = lambda test: F.transform(F.filter(anchors, test), lambda a: a["href"])
    # the text of an anchor that is never closed may go on where only the tree knows
    contact = hrefs(lambda a: ~a["closed"] | discovery.is_contact_reference(a["href"], a["text"], list(terms), patterns))
    declared = F.concat(H.json_ld_contact_urls(html, list(terms)), H.contact_metas(html))
    locations = F.when(html.rlike("(?i)<loc"), F.filter(
        H.sitemap_locations(html), lambda u: contains_any(F.lower(u), list(terms)) & is_valid_url(u)))
    listed = F.when(resolution.directory_ord(F.col("url"), list(directories)).isNotNull(), resolution.directory_website())
    return [
        _unique(contact).alias("contact_hrefs"), _unique(declared).alias("declared"),
        _unique(hrefs(lambda a: a["href"].rlike("(?i)sitemap"))).alias("sitemap_hrefs"), _unique(locations).alias("locations"),
        _unique(F.transform(H.frame_sources(html), lambda f: url_key(f))).alias("frame_keys"), listed.alias("listed"),
    ]


def link_rows(
    pages: DataFrame, terms: list[str] | None = None, patterns: bool = False, directories: list[str] | None = None,
) -> DataFrame:
    """(url_key, page_id, url, links...) of the newest page of each URL: latest ``fetched_at``, then least id.

    Rows are reduced by partial aggregation, so many copies of one URL meet as one row for each task.
    """
    terms = dims.literal_terms() if terms is None else terms
    directories = dims.DIRECTORIES if directories is None else directories
    has_time = ["fetched_at"] if "fetched_at" in pages.columns else []
    body = with_url_key(pages.select("page_id", "url", "html", *has_time).filter(F.col("html").isNotNull()))
    body = body.filter(F.col("url_key").isNotNull())
    rows = body.withColumn("anchors", H.anchors(F.col("html"), ends=True)).select(
        "url_key", *has_time, "page_id", "url", *_link_columns(tuple(terms), patterns, tuple(directories)))
    newest = F.max_by(F.struct(*LINKS), F.struct(*has_time, -F.col("page_id")))
    return rows.groupBy("url_key").agg(newest.alias("row")).select("url_key", "row.*")


def page_store(
    pages: DataFrame, terms: list[str] | None = None, patterns: bool = False, directories: list[str] | None = None,
    as_of: Column | None = None, days: int = dims.CACHE_DAYS,
) -> PageStore:
    """A crawl as a store for one job: one scan of its markup, links written to the shared folder.

    With ``as_of``, pages fetched after it or more than ``days`` before it are left out.
    """
    terms = dims.literal_terms() if terms is None else terms
    if as_of is not None:
        pages = fresh(pages, "fetched_at", as_of, days).filter(F.col("fetched_at") <= as_of)
    return PageStore(pages, materialize(link_rows(pages, terms, patterns, directories), "links"), tuple(terms), patterns)


def save_store(
    pages: DataFrame, table: str, buckets: int, terms: list[str] | None = None, patterns: bool = False,
    directories: list[str] | None = None,
) -> PageStore:
    """Stores the newest page of each URL as table ``table``, and its links as ``table``_links, both bucketed by url_key."""
    links = materialize(link_rows(pages, terms, patterns, directories), "links")
    body = pages.select("page_id", "html").join(links.select("page_id", "url_key", "url"), "page_id")
    for df, name in ((body.select("url_key", "page_id", "url", "html"), table), (links, f"{table}_links")):
        df.repartition(buckets, "url_key").write.mode("overwrite").format("parquet").bucketBy(buckets, "url_key").sortBy("url_key").saveAsTable(name)
    return open_store(pages.sparkSession, table, terms, patterns)


def open_store(spark: SparkSession, table: str, terms: list[str] | None = None, patterns: bool = False) -> PageStore:
    """A stored crawl; ``terms`` and ``patterns`` as it was stored with."""
    terms = dims.literal_terms() if terms is None else terms
    return PageStore(spark.table(table), spark.table(f"{table}_links"), tuple(terms), patterns, keyed=True)


# --- what a job needs ------------------------------------------------------------------------


def _keys(urls: Column, purpose: int) -> Column:
    """Requests for some addresses."""
    return F.transform(F.filter(urls, lambda u: u.isNotNull()), lambda u: F.struct(url_key(u).alias("url_key"), F.lit(purpose).alias("bits")))


def _resolved(base: Column, hrefs: Column) -> Column:
    return F.transform(hrefs, lambda h: resolve(base, h))


def requests_of(store: PageStore, site_keys: DataFrame) -> DataFrame:
    """(url_key, page_id, bits): the pages that mining the sites can need, one row for each, written."""
    links = store.links
    homes = materialize(site_keys.select(F.col("site_key").alias("url_key")).join(links, "url_key"), "homes")
    base = F.col("url")
    # pages that a probe would find, by their keys: there are fewer than probes
    roots = homes.select(discovery.site_root(base).alias("root")).distinct()
    ends = links.select("url_key", F.explode(F.transform(discovery.probed_roots(F.col("url_key")), lambda x: x["root"])).alias("root"))
    root_paths = ends.join(roots, "root", "left_semi").select("url_key", F.lit(PROBE | VISIT).alias("bits"))
    direct = homes.select(F.inline(F.concat(
        F.array(F.struct("url_key", F.lit(HOME).alias("bits"))),
        _keys(_resolved(base, F.concat("contact_hrefs", "declared")), VISIT),
        _keys(_resolved(base, F.col("sitemap_hrefs")), MAP))))
    maps = homes.select(F.col("url").alias("base"), F.explode(F.transform(
        _resolved(base, F.col("sitemap_hrefs")), lambda u: url_key(u))).alias("url_key"))
    listed = maps.join(links.select("url_key", "locations", "contact_hrefs"), "url_key").select(F.inline(F.concat(
        _keys(F.col("locations"), VISIT), _keys(_resolved(F.col("base"), F.col("contact_hrefs")), VISIT))))
    wanted = _merged(direct.unionByName(root_paths).unionByName(listed))
    wanted = materialize(wanted.join(links.select("url_key", "page_id", "frame_keys"), "url_key"), "wanted")
    frames = wanted.filter((F.col("bits").bitwiseAND(EVIDENCE) != 0) & (F.size("frame_keys") > 0)).select(
        F.explode("frame_keys").alias("url_key"), F.lit(VISIT).alias("bits"))
    framed = frames.distinct().join(links.select("url_key", "page_id"), "url_key")
    rows = wanted.select("url_key", "page_id", "bits").unionByName(framed.select("url_key", "page_id", "bits"))
    return materialize(rows.groupBy("url_key", "page_id").agg(F.bit_or("bits").alias("bits")), "requests")


def _merged(requests: DataFrame) -> DataFrame:
    return requests.filter(F.col("url_key").isNotNull()).groupBy("url_key").agg(F.bit_or("bits").alias("bits"))


# --- one scan for all of it ------------------------------------------------------------------


def _has(purpose: int) -> Column:
    return F.col("bits").bitwiseAND(purpose) != 0


def markup(store: PageStore, requests: DataFrame) -> DataFrame:
    """(url_key, page_id, url, html, bits) of written requests (url_key, page_id, bits)."""
    if store.keyed:
        return store.pages.join(requests.select("url_key", "bits"), "url_key")
    small = requests.count() <= BROADCAST_ROWS
    body = store.pages.select("page_id", "url", "html").filter(F.col("html").isNotNull())
    return body.join(F.broadcast(requests) if small else requests, "page_id")


@built_once
def _answer_columns(terms: tuple[str, ...], patterns: bool) -> list[Column]:
    """What homepages, probes and sitemaps are asked for, over the columns html, url, bits, text, tree."""
    html, anchors = F.col("html"), H.anchors(F.col("html"))
    sources, sitemaps = discovery.homepage_columns(terms, patterns)
    references = F.filter(anchors, lambda a: discovery.is_contact_reference(a["href"], a["text"], list(terms), patterns))
    return [
        F.when(_has(HOME), sources).alias("sources"), F.when(_has(HOME), sitemaps).alias("sitemaps"),
        F.when(_has(PROBE), H.relevance(html, F.col("text"))).alias("relevance"),
        F.when(_has(MAP), F.filter(H.sitemap_locations(html), lambda u: contains_any(F.lower(u), list(terms)) & is_valid_url(u))).alias("locations"),
        F.when(_has(MAP), F.transform(references, lambda a: a["href"])).alias("references"),
    ]


@built_once
def _parsed_columns() -> dict[str, Column]:
    html, own = F.col("html"), F.col("own")
    wanted = (_has(HOME) & discovery.needs_tree(html)) | extraction.needs_tree(own)
    return {"text": H.visible_text(F.when(_has(HOME | PROBE) | own.isNotNull(), html)), "tree": T.shred(F.when(wanted, html))}


def answers(store: PageStore, requests: DataFrame, **options) -> DataFrame:
    """(url_key, url, bits, error, sources, sitemaps, relevance, locations, references, candidates, frame_keys) of written
    requests. A page is read once and parsed once for all its purposes; NULL where a purpose is not asked for.
    ``error`` tells where the element tree of a page broke off; what was read before counts."""
    return answers_of(markup(store, requests), store.terms, store.patterns, **options)


def answers_of(body: DataFrame, terms: tuple[str, ...], patterns: bool = False, carried: tuple[str, ...] = (), **options) -> DataFrame:
    """The same for pages (url_key, url, html, bits, carried...) at hand."""
    html = F.col("html")
    body = body.select(
        "url_key", "url", "bits", *carried, "html", F.when(_has(EVIDENCE) & extraction.promising(html, **options), html).alias("own"))
    body = body.withColumns(_parsed_columns())
    found = body.select(
        "url_key", "url", "bits", *carried, "own", "text", "tree", F.col("tree.error").alias("error"), *_answer_columns(terms, patterns),
        F.when(_has(EVIDENCE), F.transform(H.frame_sources(html), lambda f: url_key(f))).alias("frame_keys"))
    keep = ["url_key", "url", "bits", *carried, "error", "sources", "sitemaps", "relevance", "locations", "references", "frame_keys"]
    own = found.select(*keep, F.col("own").alias("html"), "text", F.when(F.col("own").isNotNull(), F.col("tree")).alias("tree"))
    return extraction.with_candidates(own, keep, **options)


def unanswered(store: PageStore, wanted: DataFrame, answered: DataFrame) -> DataFrame:
    """Written requests for the keys of ``wanted`` that have a page but no evidence among the answers."""
    done = answered.filter(_has(EVIDENCE)).select("url_key")
    left = wanted.select("url_key").distinct().join(done, "url_key", "left_anti")
    left = left.join(store.links.select("url_key", "page_id"), "url_key")
    return materialize(left.select("url_key", "page_id", F.lit(VISIT).alias("bits")), "unanswered")


def ranked_pages(answered: DataFrame) -> DataFrame:
    """Ranked contact pages of the answered homepages: see :func:`discovery.rank_contact_pages`."""
    homes = answered.filter(_has(HOME)).select(F.col("url_key").alias("site_key"), "url", "sources", "sitemaps")
    direct = homes.select("site_key", F.inline("sources"))
    accepted = answered.filter(_has(PROBE) & (F.col("relevance") > dims.PROBE_RELEVANCE)).select(
        F.inline(discovery.probed_roots(F.col("url_key"))))
    roots = homes.select("site_key", "url", discovery.site_root(F.col("url")).alias("root"))
    probed = roots.join(accepted, "root").select("site_key", F.lit(7).alias("source_ord"), F.concat(
        scheme(F.col("url")), F.lit("://"), authority(F.col("url")), F.col("path")).alias("url"))
    maps = homes.select("site_key", F.col("url").alias("base"), F.explode("sitemaps").alias("wanted")).withColumn("url_key", url_key(F.col("wanted")))
    found = maps.join(answered.filter(_has(MAP)).select("url_key", "locations", "references"), "url_key")
    listed = found.select("site_key", F.lit(6).alias("source_ord"), F.explode(F.concat(
        "locations", F.filter(_resolved(F.col("base"), F.col("references")), lambda u: is_valid_url(u)))).alias("url"))
    return discovery.rank_contact_pages(direct.unionByName(probed).unionByName(listed))
