"""Website of a company: search hits matched to the name, then business directories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgcard.functions import html as H
from orgcard.functions import names as N
from orgcard.functions.text import built_once, first_where, let
from orgcard.functions.urls import is_valid_url, registrable_label, url_key
from orgcard.sources import dims


def name_queries(names: DataFrame) -> DataFrame:
    """(company_name, attempt, query): the plain name, then the extended query."""
    name = F.col("company_name")
    extended = F.concat_ws(" ", name, F.lit(dims.QUERY_SUFFIX))
    return names.select(
        "company_name", F.posexplode(F.array(name, extended)).alias("attempt", "query")
    )


def match_hits(
    hits: DataFrame, suffixes: list[str] | None = None, stop_words: list[str] | None = None,
) -> DataFrame:
    """Add ``fits``: whether the domain of a hit (company_name, url, ...) matches the name.

    The three exact rules run in the JVM; only hits that fail them and whose lengths allow the
    threshold reach the similarity function.
    """
    name, label = F.col("company_name"), F.col("label")
    labelled = hits.withColumn("label", registrable_label(F.col("url"), suffixes))
    exact = labelled.withColumn("exact", N.matches_label_exactly(name, label, stop_words))
    open_ = ~F.col("exact") & ~label.isin(N.EXCLUDED_LABELS)
    scored = exact.withColumn("ratio", N.similarity(name, label, wanted=open_))
    fits = F.col("exact") | F.coalesce(F.col("ratio") > N.MIN_SIMILARITY, F.lit(False))
    return scored.withColumn("fits", fits).drop("exact", "ratio", "label")


def directory_ord(url: Column, directories: list[str]) -> Column:
    """Position of the first directory the URL belongs to, NULL when none."""
    return F.coalesce(
        *[F.when(F.contains(url, F.lit(d)), F.lit(i)) for i, d in enumerate(directories)]
    )


def _directory_rank(directories: list[str], slug: bool) -> Column:
    """Order of a hit among directory entries of its company; NULL when it is none."""
    low, name = F.lower("url"), F.lower("company_name")
    named = F.contains(low, name)
    if slug:
        named = named | F.contains(low, F.regexp_replace(name, r"\s+", "-"))
    place = directory_ord(F.col("url"), directories)
    return F.when(
        place.isNotNull() & named,
        F.struct(place.alias("dir_ord"), "engine_ord", "attempt", "rank", "url"),
    )


def best_hits(
    names: DataFrame, serp: DataFrame, suffixes: list[str] | None = None,
    stop_words: list[str] | None = None, directories: list[str] | None = None, slug: bool = False,
) -> DataFrame:
    """(company_name, website, entry): first fitting hit and first directory entry per name.

    Precedence is engine, attempt, rank for websites, and directory first for entries: its URL
    must hold the directory and the lower-case name (``slug``: or its hyphenated form). Both come
    out of one aggregation, which reduces each name before the shuffle.
    """
    directories = dims.DIRECTORIES if directories is None else directories
    useful = (F.col("rank") < dims.TOP_HITS) | directory_ord(F.col("url"), directories).isNotNull()
    hits = name_queries(names).join(serp.filter(useful), "query")
    order = F.struct("engine_ord", "attempt", "rank", "url")
    fitting = F.col("fits") & (F.col("rank") < dims.TOP_HITS)
    return (
        match_hits(hits, suffixes, stop_words)
        .groupBy("company_name")
        .agg(
            F.min_by("url", F.when(fitting, order)).alias("website"),
            F.min_by("url", _directory_rank(directories, slug)).alias("entry"),
        )
    )


@built_once
def directory_website() -> Column:
    """Link from a directory page (column html) to the company: anchor text decides, in pattern order."""

    def by_text(anchors: Column, pattern: str) -> Column:
        return first_where(anchors, lambda a: a["text"].rlike(pattern) & is_valid_url(a["href"]))["href"]

    return let(H.anchors(F.col("html")), lambda a: F.coalesce(*[by_text(a, p) for p in dims.WEBSITE_ANCHORS]))


def listings(pages: DataFrame, directories: list[str] | None = None) -> DataFrame:
    """(url_key, listed): the company link of the newest page of each directory address."""
    directories = dims.DIRECTORIES if directories is None else directories
    has_time = ["fetched_at"] if "fetched_at" in pages.columns else []
    entries = pages.filter(F.col("html").isNotNull() & directory_ord(F.col("url"), directories).isNotNull())
    found = entries.select(url_key(F.col("url")).alias("url_key"), *has_time, "page_id", directory_website().alias("listed"))
    newest = F.max_by("listed", F.struct(*has_time, -F.col("page_id")))
    return found.groupBy("url_key").agg(newest.alias("listed"))


def resolve_websites(
    companies: DataFrame, serp: DataFrame, pages: DataFrame | None = None,
    suffixes: list[str] | None = None, stop_words: list[str] | None = None,
    directories: list[str] | None = None, slug: bool = False,
) -> DataFrame:
    """(company_id, company_name, website) for every company; website NULL when none fits.

    Names are resolved once however many companies share them. Precedence: engine, attempt, rank. ``pages`` is a
    table of pages, or the links of a page store (url_key, listed), which tell what directory pages say without their markup.
    """
    names = companies.select("company_name").distinct()
    best = best_hits(names, serp, suffixes, stop_words, directories, slug)
    if pages is not None:
        links = pages if "listed" in pages.columns else listings(pages, directories)
        best = best.withColumn("url_key", F.when(F.col("website").isNull(), url_key(F.col("entry"))))
        listed = links.filter(F.col("listed").isNotNull()).select("url_key", "listed")
        best = best.join(listed, "url_key", "left").withColumn("website", F.coalesce("website", "listed"))
    return companies.join(best, "company_name", "left").select("company_id", "company_name", "website")
