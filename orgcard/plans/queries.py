"""Registered queries: every operator over the whole given tables or tables derived from them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from orgcard.functions import contacts as C
from orgcard.functions import html as H
from orgcard.functions import names as N
from orgcard.functions import urls as U
from orgcard.functions.text import let
from orgcard.operators import discovery, extraction, matching, picking, positions, resolution, results, suffixes, summary
from orgcard.operators.storage import materialize, shared_folder
from orgcard.plans import derived, mining
from orgcard.plans.derived import table
from orgcard.sources import companies, dims, versions
from orgcard.sources import results as results_table
from orgcard.sources.pages import fresh, latest_snapshot, spread
from orgcard.streaming import jobs
from orgcard.streaming import sites as site_jobs

# Hosts of the page table end in these, so the company label stands left of them.
TEST_SUFFIXES = ["example.com", "example.net", "example.org"]
Query = Callable[[SparkSession, str], DataFrame]


def pages_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages"))


def documents_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"


# --- documents ------------------------------------------------------------------------------


def doc_first_email(spark, sf_dir):
    text = F.col("text")
    return documents_of(spark, sf_dir).select("doc_id", C.first_email(text).alias("email"))


def doc_first_phone(spark, sf_dir):
    docs = documents_of(spark, sf_dir).select("doc_id", C.first_phone_raw(F.col("text")).alias("raw"))
    return docs.select("doc_id", "raw", C.format_phone(F.col("raw")).alias("phone"))


def doc_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return documents_of(spark, sf_dir).select(
        "doc_id", "lang", "source",
        C.first_email(text).alias("email"), C.first_phone(text).alias("phone"),
    )


def doc_deobfuscated(spark, sf_dir):
    """Opt-in rewriting: every address is first hidden as ``name [at] host [dot] tld``."""
    hidden = F.regexp_replace(
        "text", r"([A-Za-z0-9._%+-]+)@([A-Za-z0-9.-]+)\.([A-Za-z]{2,})", "$1 [at] $2 [dot] $3"
    )
    text = documents_of(spark, sf_dir).select("doc_id", hidden.alias("text"))
    return text.select(
        "doc_id",
        C.first_email(F.col("text")).alias("plain_email"),
        C.first_email(C.canonical_text(F.col("text"), deobfuscated=True)).alias("email"),
    )


def email_domain_counts(spark, sf_dir):
    emails = documents_of(spark, sf_dir).select(
        "doc_id", F.explode_outer(C.all_emails(F.col("text"))).alias("email")
    ).filter(F.col("email").isNotNull())
    keyed = emails.select("doc_id", C.email_key(F.col("email")).alias("email"))
    return (
        keyed.groupBy(F.substring_index("email", "@", -1).alias("domain"))
        .agg(
            F.count("*").alias("n_hits"),
            F.countDistinct("email").alias("n_emails"),
            F.countDistinct("doc_id").alias("n_docs"),
        )
    )


def phone_dedup(spark, sf_dir):
    return (
        doc_contacts(spark, sf_dir).filter(F.col("phone").isNotNull())
        .groupBy("phone").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))
    )


def coverage_by_lang(spark, sf_dir):
    docs = doc_contacts(spark, sf_dir).select(
        "lang", F.lit(None).cast("string").alias("website"), "email", "phone",
        F.when(F.col("email").isNotNull() | F.col("phone").isNotNull(), "success")
        .otherwise("failed").alias("status"),
    )
    return summary.coverage(docs, "lang")


def conversation_contacts(spark, sf_dir):
    text = F.col("text")
    turns = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", C.first_email(text).alias("e"), C.first_phone(text).alias("p")
    )
    return turns.groupBy("conv_id").agg(
        F.count("*").alias("n_turns"),
        F.min_by("e", F.when(F.col("e").isNotNull(), F.col("turn"))).alias("email"),
        F.min_by("p", F.when(F.col("p").isNotNull(), F.col("turn"))).alias("phone"),
    )


# --- pages ----------------------------------------------------------------------------------


def page_url_parts(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", U.scheme(url).alias("scheme"), U.authority(url).alias("authority"),
        U.path(url).alias("path"), U.query(url).alias("query"), U.fragment(url).alias("fragment"),
        U.url_key(url).alias("url_key"),
        U.registrable_label(url, TEST_SUFFIXES).alias("label"),
    )


def page_url_valid(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", U.is_valid_url(url).alias("valid"),
        U.is_valid_url(url, directories=["spam-farm.example.org/biz"]).alias("no_directory"),
        U.contact_score(url).alias("score"),
    )


def page_links(spark, sf_dir):
    anchors = H.anchors(F.col("html"))
    links = pages_of(spark, sf_dir).select("page_id", "url", F.posexplode_outer(anchors).alias("pos", "a"))
    return links.filter(F.col("pos").isNotNull()).select(
        "page_id", "pos", "a.href", "a.text", U.resolve(F.col("url"), F.col("a.href")).alias("target")
    )


def page_visible_text(spark, sf_dir):
    text = pages_of(spark, sf_dir).select("page_id", H.visible_text(F.col("html")).alias("text"))
    return text.select("page_id", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("digest"))


def page_contacts(spark, sf_dir):
    """All extraction methods on every page; one e-mail and phone per page."""
    return extraction.first_contacts(pages_of(spark, sf_dir)).select("page_id", "url", "email", "phone")


def site_contacts(spark, sf_dir):
    """First values per host over all its pages, in page order."""
    pages = pages_of(spark, sf_dir)
    found = extraction.page_candidates(pages).select(
        U.host(F.col("url")).alias("site_key"), F.col("page_id").alias("page_ord"),
        F.lit(0).alias("block_ord"), "stage", "chunk_ord", "method_ord", "kind", "value",
    )
    picked = picking.pick_contacts(found, policy="first")
    hosts = pages.select(U.host(F.col("url")).alias("site_key")).groupBy("site_key").agg(
        F.count("*").alias("n_pages")
    )
    return hosts.join(picked, "site_key", "left").select("site_key", "n_pages", "email", "phone")


def url_score_top3(spark, sf_dir):
    """Best three page URLs per company label, scored as contact pages."""
    url = F.col("url")
    scored = table(spark, sf_dir, "pages").select(
        U.registrable_label(url, TEST_SUFFIXES).alias("site_key"), "url",
        U.contact_score(url).alias("score"),
    )
    return discovery.top_per_key(scored, "site_key", [F.col("score").desc(), url], 3)


def term_links(spark, sf_dir):
    """Links per page, and those that hold a contact term or fit a contact pattern."""
    terms = dims.literal_terms()
    anchors = F.col("anchors")
    counted = pages_of(spark, sf_dir).select("page_id", H.anchors(F.col("html")).alias("anchors"))

    def n(patterns: bool) -> Column:
        fits = F.filter(
            anchors,
            lambda a: discovery.is_contact_reference(a["href"], a["text"], terms, patterns),
        )
        return F.size(fits)

    names = F.filter(
        anchors,
        lambda a: discovery.is_contact_reference(a["href"], a["text"], dims.category_names()),
    )
    return counted.select(
        "page_id", F.size(anchors).alias("n_links"), n(False).alias("n_contact"),
        n(True).alias("n_pattern"), F.size(names).alias("n_category"),
    )


def page_relevance(spark, sf_dir):
    return discovery.page_relevance(pages_of(spark, sf_dir)).select("page_id", "relevance")


def page_hits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Companies named after host labels, and their pages as search hits (engine 0 is https)."""
    url = F.col("url")
    labelled = table(spark, sf_dir, "pages").select(
        "page_id", "url", U.registrable_label(url, TEST_SUFFIXES).alias("label"),
        F.when(U.scheme(url) == "https", 0).otherwise(1).alias("engine_ord"),
    )
    name = F.concat(F.initcap(F.replace(F.col("label"), F.lit("-"), F.lit(" "))), F.lit(" Group"))
    named = labelled.withColumn("query", name).withColumn("key", F.struct("query", "engine_ord"))
    top = discovery.top_per_key(named, "key", [F.col("page_id")], dims.TOP_HITS)
    serp = top.select("query", "engine_ord", (F.col("rn") - 1).alias("rank"), "url")
    companies = named.groupBy(F.col("query").alias("company_name")).agg(
        F.min("page_id").alias("company_id")
    )
    return companies.select("company_id", "company_name"), serp


def serp_first_hit(spark, sf_dir):
    companies, serp = page_hits(spark, sf_dir)
    return resolution.resolve_websites(companies, serp, suffixes=TEST_SUFFIXES)


def excluded_domains(spark, sf_dir):
    """Search hits per domain label, with the excluded domains gone."""
    _, serp, _ = derived.site_tables(spark, sf_dir)
    label = U.registrable_label(F.col("url"))
    hits = serp.select("query", label.alias("label"))
    return (
        hits.filter(~F.col("label").isin(N.EXCLUDED_LABELS))
        .groupBy("label").agg(F.count("*").alias("n_hits"))
    )


# --- company names --------------------------------------------------------------------------


def company_domain_match(spark, sf_dir):
    """Five name/domain pairs per supplier, one per rule."""
    digits = F.substring("s_name", 10, 9)
    values = {"d": digits}
    pairs = [
        ("word", "Acme Supplier$d$, Inc.", "https://www.supplier$d$.com/"),
        ("initials", "Quick & Brown Fox $d$", "http://qbf0.co.uk/x"),
        ("squeezed", "a b $d$", "https://shop.ab$d$.net"),
        ("excluded", "Amazon $d$", "https://amazon.com/$d$"),
        ("none", "Zeta Ltd $d$", "https://example$d$x.co.uk/"),
    ]
    rows = F.array(
        *[
            F.struct(F.lit(k).alias("variant"), derived.filled(n, **values).alias("company_name"),
                     derived.filled(u, **values).alias("url"))
            for k, n, u in pairs
        ]
    )
    name, label = F.col("company_name"), F.col("label")
    hits = table(spark, sf_dir, "supplier").select("s_suppkey", F.inline(rows))
    return hits.withColumn("label", U.registrable_label(F.col("url"))).select(
        "s_suppkey", "variant", "label", N.clean_name(name).alias("clean"),
        N.word_in_label(name, label).alias("by_word"),
        (N.initials(name) == label).alias("by_initials"),
        (N.squeezed(name) == label).alias("by_squeezed"),
        N.matches_label_exactly(name, label).alias("matched"),
    )


def company_domain_similarity(spark, sf_dir):
    """Suppliers against domains that drop the last letters of their name."""
    name = F.concat(F.lit("Sup plier"), F.substring("s_name", 10, 9))
    cut = lambda n: F.expr(f"left(s_name, 8) || substr(s_name, 10, {n})")
    rows = F.array(*[F.struct(F.lit(n).alias("kept"), F.lower(cut(n)).alias("label")) for n in (9, 5, 1)])
    pairs = table(spark, sf_dir, "supplier").select(
        "s_suppkey", name.alias("company_name"), F.inline(rows)
    )
    ratio = N.similarity(F.col("company_name"), F.col("label"))
    scored = pairs.withColumn("ratio", F.round(ratio, 6))
    return scored.select(
        "s_suppkey", "kept", "ratio", F.coalesce(F.col("ratio") > N.MIN_SIMILARITY, F.lit(False)).alias("similar")
    )


def company_domain_pairs(spark, sf_dir):
    """Companies (customers, and those named after hosts) against the labels of all hosts, without search hits, by the exact rules."""
    named, _ = page_hits(spark, sf_dir)
    names = named.select("company_name").unionByName(table(spark, sf_dir, "customer").select(F.col("c_name").alias("company_name")))
    labels = table(spark, sf_dir, "pages").select(U.registrable_label(F.col("url"), TEST_SUFFIXES).alias("label"))
    return matching.match_domains(names, labels, similar=False)


def page_suffix_labels(spark, sf_dir):
    """Suffix and label of every page by a table of rules: one suffix, a wildcard and its exception."""
    rules = spark.createDataFrame([("com",), ("net",), ("example.com",), ("*.net",), ("!example.net",)], "suffix string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return suffixes.with_registrable_label(pages, rules).select("page_id", "suffix", "label")


def page_escaped_contacts(spark, sf_dir):
    """Every page with an address spliced in that is escaped in one of five ways, in a script or a link."""
    user = F.concat(F.lit("user"), F.col("page_id").cast("string"))
    values = {"u": user, "html": F.coalesce("html", F.lit(""))}
    ways = [
        "$html$<script>m = unescape('$u$%40site.te%73t')</script>",
        r"$html$<script>m = decodeURIComponent('$u$\x40site\x2etest')</script>".replace("\\\\", "\\"),
        r"$html$<script>m = '$u$\u0040site.test'</script>".replace("\\\\", "\\"),
        "$html$<script>m = unescape('$u$%2540site%252etest')</script>",
        '$html$<div class="vc_column_text"><a href="mailto:$u$%40site.test">Mail</a></div>',
    ]
    html = F.coalesce(*[F.when(F.col("page_id") % len(ways) == i, derived.filled(w, **values)) for i, w in enumerate(ways)])
    pages = pages_of(spark, sf_dir).select("page_id", "url", html.alias("html"))
    found = extraction.page_candidates(pages, decoded=True)
    spliced = found.filter((F.col("kind") == "email") & F.col("method_ord").isin(1, 8))
    return spliced.select("page_id", "method_ord", F.col("value").alias("email"))


def page_error_counts(spark, sf_dir):
    """Pages by whether their markup breaks off, as that of every seventh is made to; the text before still counts."""
    broken = F.concat(F.coalesce("html", F.lit("")), F.when(F.col("page_id") % 7 == 0, "<![broken[ x ]]>").otherwise(""))
    pages = pages_of(spark, sf_dir).select("page_id", "url", broken.alias("html"))
    errors = extraction.page_errors(pages).select("page_id", F.lit("error").alias("status"))
    status = pages.select("page_id").join(errors, "page_id", "left").select(F.coalesce("status", F.lit("success")).alias("status"))
    return status.groupBy("status").agg(F.count("*").alias("n"))


def site_company_errors(spark, sf_dir):
    """The whole job where the contact pages of one segment break off before their links: statuses of all companies."""
    named, serp, pages = derived.site_tables(spark, sf_dir)
    broken = F.when(F.col("html").contains("elementor-widget"), F.concat(F.lit("<![broken[ "), "html")).otherwise(F.col("html"))
    mined = mining.mine_companies(named, serp, pages.withColumn("html", broken))
    return mined.groupBy("status").agg(F.count("*").alias("n"), F.count("email").alias("n_email"))


def homepage_declared(spark, sf_dir):
    """Contact pages that homepages declare in structured data and meta tags, and homepages that are their own contact page."""
    values = {"u": F.lower(F.replace(F.col("s_name"), F.lit("#"), F.lit("")))}
    parts = [
        '<script type="application/ld+json">{"contactPoint":{"url":"/ld-$u$"}}</script><meta name="email-us" content="/meta-$u$">',
        '<script type="application/ld+json">{"url":"https://$u$.com/contact-ld"}</script><meta name="author" content="/no">',
        '<div class="contact"><form class="contact"></form></div><p>Address: $u$@$u$.com</p>',
        '<script type="application/ld+json">{"contactPoint":{"email":"x"},"url":"/contact"}</script><meta name="contact" content="mailto:x">',
    ]
    html = F.coalesce(*[F.when(F.col("s_suppkey") % 4 == i, derived.filled(p, **values)) for i, p in enumerate(parts)])
    homes = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("site_key"), derived.filled("https://$u$.com/", **values).alias("url"), html.alias("html"))
    sources = discovery.homepage_links(homes).select("site_key", F.inline_outer("sources")).filter(F.col("url").isNotNull())
    return sources.select("site_key", F.get(F.array(*map(F.lit, discovery.SOURCES)), F.col("source_ord")).alias("source"), "url")


def name_encodings(spark, sf_dir):
    """Company names as bytes, those of every third customer no UTF-8."""
    bad = F.concat(F.encode("c_name", "UTF-8"), F.unhex(F.lit("FF")))
    raw = F.when(F.col("c_custkey") % 3 == 0, bad).otherwise(F.encode(F.concat("c_name", F.lit(" é")), "UTF-8"))
    return results.decode_names(table(spark, sf_dir, "customer").select("c_custkey", raw.alias("company_name")))


def company_list(spark, sf_dir):
    """A list of names written as CSV and read back: first column, trimmed, missing ones gone, equal ones with keys of their own."""
    name = F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit("  "), "c_mktsegment", F.lit(" ")))
    path = scratch(spark)
    table(spark, sf_dir, "customer").select(name.alias("Firma"), "c_nationkey").write.option("header", True).option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    named = companies.read_companies(spark, path, "csv")
    return named.groupBy("company_name").agg(F.count("*").alias("n"), F.countDistinct("company_id").alias("n_keys"))


# --- one extraction method each, on card pages ----------------------------------------------


def _method_values(method: int, card: str) -> Query:
    def query(spark, sf_dir):
        evidence = extraction.page_evidence(derived.card_pages(spark, sf_dir, card))

        def value(kind: str) -> Column:
            own = F.filter("candidates", lambda c: (c["method_ord"] == method) & (c["kind"] == kind))
            return F.get(own, F.size(own) - 1)["value"].alias(kind)

        return evidence.select("page_id", value("email"), value("phone"))

    return query


def builder_contacts(spark, sf_dir):
    pages = derived.card_pages(spark, sf_dir, "builder")
    return extraction.first_contacts(pages).select("page_id", "email", "phone")


def markup_website(spark, sf_dir):
    """Declared website and RDFa patterns (opt-in) over pages that carry them."""
    values = {"u": F.lower(F.replace(F.col("s_name"), F.lit("#"), F.lit("")))}
    html = derived.filled(
        '<meta property="og:url" content="https://$u$.com/"><script>{"url": "https://x.$u$.com"}</script>'
        '<div typeof="schema:ContactPoint">Mail <b>$u$@$u$.com</b></div>', **values,
    )
    pages = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("page_id"), html.alias("html"))
    rdfa = let(C.rdfa_contacts(F.col("html")), lambda parts: C.first_email_of(parts))
    return pages.select("page_id", C.markup_website(F.col("html")).alias("website"), rdfa.alias("rdfa_email"))


# --- whole sites ----------------------------------------------------------------------------


def site_company_contacts(spark, sf_dir):
    """The whole job: companies and search hits to one contact row per company."""
    companies, serp, pages = derived.site_tables(spark, sf_dir)
    return mining.mine_companies(companies, serp, pages)


def _homes(pages: DataFrame) -> DataFrame:
    homes = pages.filter(U.path(F.col("url")) == "/")
    return homes.select(U.url_key(F.col("url")).alias("site_key"), "url", "html")


def contact_page_ranking(spark, sf_dir):
    _, _, pages = derived.site_tables(spark, sf_dir)
    ranked = discovery.contact_pages(pages, _homes(pages))
    return ranked.select("site_key", "url", "source", "score", "rn")


def sitemap_pages(spark, sf_dir):
    _, _, pages = derived.site_tables(spark, sf_dir)
    links = discovery.homepage_links(_homes(pages)).select(
        "site_key", F.explode_outer("sitemaps").alias("sitemap")
    ).filter(F.col("sitemap").isNotNull())
    maps = pages.select(F.col("url").alias("sitemap"), "html")
    listed = links.join(maps.hint("merge"), "sitemap").select(
        "site_key", F.explode(H.sitemap_locations(F.col("html"))).alias("url")
    )
    contact = discovery.is_contact_reference(F.col("url"), F.lit(""), dims.literal_terms())
    return listed.withColumn("is_contact", contact)


def common_path_probe(spark, sf_dir):
    """The 11 common paths of every site: which exist, and how relevant they are."""
    _, _, pages = derived.site_tables(spark, sf_dir)
    guesses = discovery.probes(_homes(pages)).select(
        "site_key", U.url_key(F.col("probe_url")).alias("url_key")
    )
    known = discovery.page_relevance(pages).select(U.url_key(F.col("url")).alias("url_key"), "relevance")
    # many rows are made of each row of the table, which the planner does not count; it would broadcast a side
    return guesses.join(known.hint("merge"), "url_key").withColumn("accepted", F.col("relevance") > dims.PROBE_RELEVANCE)


def directory_website(spark, sf_dir):
    companies, serp, pages = derived.site_tables(spark, sf_dir)
    best = resolution.best_hits(companies.select("company_name").distinct(), serp)
    entries = best.filter(F.col("entry").isNotNull()).select("company_name", F.col("entry").alias("url"))
    links = pages.select("url", "html").join(entries.hint("merge"), "url")
    return links.select("company_name", "url", resolution.directory_website().alias("website"))


def frame_contacts(spark, sf_dir):
    """Contacts of every site by method, framed pages included (methods 10 and up)."""
    _, _, pages = derived.site_tables(spark, sf_dir)
    keys = _homes(pages).select("site_key")
    picked = mining.mine_sites(pages, keys)
    return picking.method_coverage(picked)


# --- results --------------------------------------------------------------------------------


def order_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as result rows with status and gaps, numbered in key order."""
    status = (
        F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "no_website_found")
        .when(F.col("o_orderpriority").startswith("1"), "error").otherwise("failed")
    )
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") != "O", F.col("o_orderpriority")).alias("website"),
        F.when(F.col("o_totalprice") > 100000, F.col("o_orderpriority")).otherwise("").alias("email"),
        F.when(F.col("o_totalprice") < 200000, F.col("o_orderpriority")).alias("phone"),
        status.alias("status"),
    )
    return positions.with_position(rows, "o_orderkey")


def batch_summary(spark, sf_dir):
    batches = positions.slice_and_batch(order_results(spark, sf_dir), batch_size=1000)
    return summary.coverage(batches, "batch_id")


def status_breakdown(spark, sf_dir):
    batches = positions.slice_and_batch(order_results(spark, sf_dir), batch_size=5000)
    return summary.status_breakdown(batches, "batch_id")


def company_batches(spark, sf_dir):
    """Company list in input order: positions, slice, batches, missing and padded names."""
    raw = table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.when(F.col("c_mktsegment") != "BUILDING", F.concat(F.lit(" \t"), "c_name", F.lit("\n"))).alias("name"),
    )
    batches = positions.slice_and_batch(
        positions.with_position(raw, "c_custkey"), start_index=10, batch_size=50
    )
    return positions.clean_companies(batches, "name").select("c_custkey", "name", "pos", "batch_id")


def ordered_results(spark, sf_dir):
    """Result rows written as a version in input order: where each row stands in its files, taken in name order."""
    path = scratch(spark)
    rows = order_results(spark, sf_dir).select("o_orderkey", "status", "pos")
    versions.write_version(materialize(rows, "ordered"), path, 0, "pos", file_rows=5000)
    return versions.in_written_order(versions.read_version(spark, path))


def doc_result_batches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as result rows: first run with e-mails, second run with phones."""
    found = doc_contacts(spark, sf_dir)
    null = F.lit(None).cast("string")
    first = found.select(
        F.col("doc_id").alias("company_id"), F.col("source").alias("company_name"),
        F.when(F.col("email").isNotNull(), F.concat(F.lit("https://"), F.substring_index("email", "@", -1)))
        .alias("website"), "email", null.alias("phone"),
    )
    second = found.filter(F.col("phone").isNotNull()).select(
        F.col("doc_id").alias("company_id"), F.col("source").alias("company_name"),
        F.lit("https://second.example.net/").alias("website"), F.lit("second@example.net").alias("email"), "phone",
    )
    return results.with_status(first), results.with_status(second)


def reprocess_merge(spark, sf_dir):
    old, new = doc_result_batches(spark, sf_dir)
    again = results.incomplete(old).select("company_id")
    return results.merge_results(old, new.join(again, "company_id", "left_semi"))


def upsert_results(spark, sf_dir):
    """Two batches written to a results table, the second one twice; newest row per company."""
    old, new = doc_result_batches(spark, sf_dir)
    path = scratch(spark)
    results_table.write_batch(old, path, 0)
    for _ in range(2):
        results_table.write_batch(new, path, 1)
    return results_table.read_results(spark, path)


def upsert_by_key(spark, sf_dir):
    old, new = doc_result_batches(spark, sf_dir)
    return results.upsert(old, new)


def snapshot_latest(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    recent = fresh(events, "ts")
    return latest_snapshot(recent, "user_id", "ts", "event_id", ["event_id", "event_type", "value"])


def stream_results(spark, sf_dir):
    """Documents as a stream: each micro-batch becomes result rows in the results table."""
    schema = table(spark, sf_dir, "documents").schema
    # as a pattern, the path may be that of a file or of a folder of files
    arriving = spark.readStream.schema(schema).parquet(f"{sf_dir}/{{documents}}.parquet")
    text = F.col("text")

    def to_results(batch: DataFrame) -> DataFrame:
        found = batch.select(
            F.col("doc_id").alias("company_id"), F.col("source").alias("company_name"),
            F.lit(None).cast("string").alias("website"),
            C.first_email(text).alias("email"), C.first_phone(text).alias("phone"),
        )
        return results.with_status(found)

    base = scratch(spark)
    jobs.upsert_stream(arriving, to_results, f"{base}/results", f"{base}/checkpoint").awaitTermination()
    return results_table.read_results(spark, f"{base}/results")


def stream_first_seen(spark, sf_dir):
    """Events as a stream of several micro-batches in time order: each user passes once per cache period.

    Each quarter of the time is written by all tasks and then taken by the stream, which goes on from its checkpoint."""
    events, base = table(spark, sf_dir, "events"), scratch(spark)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    cuts = events.agg(F.percentile_approx(at, [0.25, 0.5, 0.75])).first()[0] or []
    quarter = F.coalesce(sum([(at > cut).cast("int") for cut in cuts], F.lit(0)), F.lit(0))
    events.withColumn("quarter", quarter).write.partitionBy("quarter").parquet(f"{base}/quarters")
    parts = spark.read.schema(StructType([*events.schema.fields, StructField("quarter", IntegerType())])).parquet(f"{base}/quarters")
    for n in range(len(cuts) + 1):
        parts.where(F.col("quarter") == n).drop("quarter").write.mode("append").parquet(f"{base}/events")
        arriving = spark.readStream.schema(events.schema).parquet(f"{base}/events")
        passed = jobs.first_in_window(arriving, "user_id", "ts")
        jobs.append_stream(passed, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.schema("user_id bigint, ts timestamp_ntz").parquet(f"{base}/out").select("user_id", F.col("ts").cast("timestamp").alias("ts"))


def stream_site_contacts(spark, sf_dir):
    """The pages of all sites arrive in three parts, dealt by their addresses; the sites a part touches are mined again."""
    _, _, pages = derived.site_tables(spark, sf_dir)
    base, cores = scratch(spark), spark.sparkContext.defaultParallelism
    pages.repartition(3 * cores, "url").write.parquet(f"{base}/pages")
    arriving = spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", cores).parquet(f"{base}/pages")
    sites = _homes(pages).select("site_key")
    site_jobs.site_stream(arriving, sites, f"{base}/tables", f"{base}/checkpoint").awaitTermination()
    return site_jobs.read_sites(spark, f"{base}/tables").select("site_key", "email", "phone")


def props_json(spark, sf_dir):
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return table(spark, sf_dir, "events").select("event_type", k.alias("k")).groupBy("event_type").agg(
        F.count("*").alias("n"), F.sum("k").alias("sum_k"), F.max("k").alias("max_k")
    )


def registry() -> dict[str, Query]:
    named = [
        doc_first_email, doc_first_phone, doc_deobfuscated, email_domain_counts, phone_dedup,
        coverage_by_lang, conversation_contacts, page_url_parts, page_url_valid, page_links,
        page_visible_text, page_contacts, site_contacts, url_score_top3, term_links, page_relevance,
        serp_first_hit, excluded_domains, company_domain_match, company_domain_similarity,
        builder_contacts, markup_website, site_company_contacts, contact_page_ranking, sitemap_pages,
        common_path_probe, directory_website, frame_contacts, batch_summary, status_breakdown,
        company_batches, reprocess_merge, upsert_results, upsert_by_key, snapshot_latest,
        stream_results, stream_first_seen, stream_site_contacts, ordered_results, props_json, company_domain_pairs, page_suffix_labels, page_escaped_contacts,
        page_error_counts, site_company_errors, homepage_declared, name_encodings, company_list,
    ]
    queries: dict[str, Query] = {f.__name__: f for f in named}
    queries["jsonld_contacts"] = _method_values(0, "jsonld")
    queries["js_object_contacts"] = _method_values(9, "objects")
    queries["microdata_contacts"] = _method_values(7, "microdata")
    queries["markup_property_contacts"] = _method_values(6, "properties")
    queries["section_contacts"] = _method_values(3, "section")
    return queries


__all__ = ["registry"]
