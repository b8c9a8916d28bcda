"""The whole job: companies to contacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from orgcard.functions.urls import url_key
from orgcard.operators.pagestore import EVIDENCE, PageStore, answers, page_store, ranked_pages, requests_of, unanswered
from orgcard.operators.picking import pick_contacts, site_candidates
from orgcard.operators.resolution import resolve_websites
from orgcard.operators.results import (
    COLUMNS, FIELDS, decode_names, incomplete, merge_results, with_status,
)
from orgcard.operators.storage import materialize


def visit_list(site_keys: DataFrame, ranked: DataFrame) -> DataFrame:
    """(site_key, page_ord, url_key): the homepage, then its ranked contact pages."""
    home = site_keys.select("site_key", F.lit(0).alias("page_ord"), F.col("site_key").alias("url_key"))
    others = ranked.filter(F.col("url_key") != F.col("site_key")).select(
        "site_key", F.col("rn").alias("page_ord"), "url_key"
    )
    return home.unionByName(others)


def mine_sites(
    pages: DataFrame | PageStore, site_keys: DataFrame, terms: list[str] | None = None, patterns: bool = False,
    **options,
) -> DataFrame:
    """(site_key, email, phone, email_method, phone_method, broken) of the sites with a crawled homepage and a value, or with a
    visited page whose markup breaks off (broken).

    ``site_keys`` holds distinct keys, best read from a written table.

    Only pages that a visit can need are parsed; each is read and parsed once, however many companies share
    its site and whatever it is wanted for. Small derived tables (links, requests, answers) are written, markup never is.
    """
    store = pages if isinstance(pages, PageStore) else page_store(pages, terms, patterns)
    answered = materialize(answers(store, requests_of(store, site_keys), **options), "answers")
    homes = answered.filter(F.col("sources").isNotNull()).select(F.col("url_key").alias("site_key"))
    visits = materialize(visit_list(homes, ranked_pages(answered)), "visits")
    while True:  # visits and frames that the links alone did not tell of
        own = visits.select("url_key").distinct().join(answered.select("url_key", "frame_keys"), "url_key")
        frames = own.filter(F.size("frame_keys") > 0).select(F.explode("frame_keys").alias("url_key"))
        left = unanswered(store, visits.select("url_key").unionByName(frames), answered)
        if left.isEmpty():
            break
        more = answers(store, left, **options)
        only = answered.join(left.select("url_key"), "url_key", "left_anti")  # an answer without evidence is replaced
        answered = materialize(only.unionByName(more), "answers")
    evidence = answered.filter(F.col("bits").bitwiseAND(EVIDENCE) != 0).select("url_key", "candidates", "frame_keys")
    picked = pick_contacts(site_candidates(visits, evidence, evidence))
    failed = visits.join(answered.filter(F.col("error").isNotNull()).select("url_key"), "url_key")
    broken = failed.select("site_key").distinct().withColumn("broken", F.lit(True))
    return picked.join(broken, "site_key", "full").withColumn("broken", F.coalesce("broken", F.lit(False)))


def mine_companies(
    companies: DataFrame, serp: DataFrame, pages: DataFrame | PageStore, suffixes: list[str] | None = None,
    stop_words: list[str] | None = None, directories: list[str] | None = None,
    terms: list[str] | None = None, patterns: bool = False, as_of: Column | None = None, **options,
) -> DataFrame:
    """One row per company: company_id, company_name, website, email, phone, status. The status is ``error`` where a value is
    missing and the markup of a visited page breaks off; such pages stop no others, and what was read before counts.

    ``pages`` is a table of pages or a store of them; ``as_of`` leaves pages of a table out that the cache would not hold then.

    Names may arrive as bytes; those that are no UTF-8 get the status ``encoding_error``.
    """
    if isinstance(companies.schema["company_name"].dataType, BinaryType):
        named = decode_names(companies)
        broken = named.filter(F.col("status").isNotNull()).withColumns(
            {field: F.lit(None).cast("string") for field in FIELDS}
        )
        readable = named.filter(F.col("status").isNull()).drop("status")
        mined = mine_companies(readable, serp, pages, suffixes, stop_words, directories, terms, patterns, as_of, **options)
        return mined.unionByName(broken.select(*COLUMNS))
    store = pages if isinstance(pages, PageStore) else page_store(pages, terms, patterns, directories, as_of)
    resolved = resolve_websites(companies, serp, store.links, suffixes, stop_words, directories)
    websites = materialize(
        resolved.withColumn("site_key", url_key(F.col("website"))), "websites"
    )
    site_keys = websites.filter(F.col("site_key").isNotNull()).select("site_key").distinct()
    contacts = mine_sites(store, site_keys, **options).select("site_key", "email", "phone", "broken")
    # companies without a website would all meet in one task of the join
    nowhere = websites.filter(F.col("site_key").isNull()).withColumns(
        {"email": F.lit(None).cast("string"), "phone": F.lit(None).cast("string"), "broken": F.lit(False)})
    found = websites.filter(F.col("site_key").isNotNull()).join(contacts, "site_key", "left")
    gap = F.col("email").isNull() | F.col("phone").isNull()
    rows = with_status(found.unionByName(nowhere))
    return rows.withColumn("status", F.when(F.col("broken") & gap, "error").otherwise(F.col("status"))).select(*COLUMNS)


def reprocess(results: DataFrame, serp: DataFrame, pages: DataFrame, **options) -> DataFrame:
    """Mine the incomplete rows again (newer hits and pages) and close their gaps."""
    again = incomplete(results).select("company_id", "company_name")
    return merge_results(results, mine_companies(again, serp, pages, **options))
