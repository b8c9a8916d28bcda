"""One e-mail and phone per site out of its candidates.

A site is visited page by page until both values are known; inside a page the visible steps end
as soon as both are. Override candidates replace what was found before, fill candidates only close
gaps. As a set: with ``rank = (page_ord, block_ord, stage, chunk_ord)`` and ``cutoff`` the later one
of the first e-mail and the first phone, an override counts when its page was visited and it lies
no later than the cutoff (or is one that no stop rule skips); the last such override wins, else the
first fill.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANK = ("page_ord", "block_ord", "stage", "chunk_ord")


def site_candidates(visits: DataFrame, evidence: DataFrame, frame_evidence: DataFrame) -> DataFrame:
    """Candidates of visited pages and of the frames on them.

    ``visits(site_key, page_ord, url_key)``; evidence tables hold one row per ``url_key``.
    """
    own = visits.join(evidence, "url_key")
    pages = own.select(
        "site_key", "page_ord", F.lit(0).alias("block_ord"), F.inline("candidates")
    ).filter((F.col("method_ord") != 0) | (F.col("page_ord") == 0))
    framed = (
        own.select("site_key", "page_ord", F.posexplode("frame_keys").alias("frame_ord", "frame_key"))
        .join(
            frame_evidence.select(F.col("url_key").alias("frame_key"), "candidates"), "frame_key"
        )
        .select(
            "site_key", "page_ord", (F.col("frame_ord") + 1).alias("block_ord"), F.inline("candidates")
        )
        .filter(F.col("method_ord") != 0)
        .withColumn("method_ord", F.col("method_ord") + 10)
    )
    return pages.unionByName(framed)


def pick_contacts(candidates: DataFrame, policy: str = "crawl") -> DataFrame:
    """(site_key, email, phone, email_method, phone_method).

    ``policy='crawl'`` follows the visit order above; the window holds the candidates of one
    site, at most four visited pages. ``policy='first'`` takes the first value in order by plain
    partial aggregation and suits groups of any size.
    """
    rank = F.struct(*RANK)
    if policy == "first":
        best = lambda kind: F.min_by(
            F.struct("value", "method_ord"),
            F.when(F.col("kind") == kind, F.struct(*RANK, "method_ord")),
        )
        picked = candidates.groupBy("site_key").agg(best("email").alias("e"), best("phone").alias("p"))
        return _flat(picked)

    site = Window.partitionBy("site_key")
    known_at = lambda kind: F.min(F.when(F.col("kind") == kind, rank)).over(site)
    seen = candidates.withColumn("first_email", known_at("email")).withColumn(
        "first_phone", known_at("phone")
    )
    both = F.col("first_email").isNotNull() & F.col("first_phone").isNotNull()
    seen = seen.withColumn("cutoff", F.when(both, F.greatest("first_email", "first_phone")))
    cutoff = F.col("cutoff")
    visited = cutoff.isNull() | (F.col("page_ord") == 0) | (F.col("page_ord") <= cutoff["page_ord"])
    applies = visited & (F.col("always") | cutoff.isNull() | (rank <= cutoff))

    def winner(kind: str) -> Column:
        row, order = F.struct("value", "method_ord"), F.struct(*RANK, "method_ord")
        mine = F.col("kind") == kind
        override = F.max_by(row, F.when(mine & applies & (F.col("source_class") == "override"), order))
        fill = F.min_by(row, F.when(mine & (F.col("source_class") == "fill"), order))
        return F.coalesce(override, fill)

    return _flat(seen.groupBy("site_key").agg(winner("email").alias("e"), winner("phone").alias("p")))


def _flat(picked: DataFrame) -> DataFrame:
    return picked.select(
        "site_key",
        F.col("e.value").alias("email"), F.col("p.value").alias("phone"),
        F.col("e.method_ord").alias("email_method"), F.col("p.method_ord").alias("phone_method"),
    )


def method_coverage(picked: DataFrame) -> DataFrame:
    """How many winners each extraction method gave, by kind."""
    return (
        picked.select(
            F.inline(
                F.array(
                    F.struct(F.lit("email").alias("kind"), F.col("email_method").alias("method_ord")),
                    F.struct(F.lit("phone").alias("kind"), F.col("phone_method").alias("method_ord")),
                )
            )
        )
        .filter(F.col("method_ord").isNotNull())
        .groupBy("kind", "method_ord").agg(F.count("*").alias("n"))
    )
