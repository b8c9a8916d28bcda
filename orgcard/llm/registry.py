"""Registered queries of the corpus operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from orgcard.llm import common, decontaminate, filteraudit, hnsw, jaccard, langid, mixing, packing, parttrie, styletree, substring, suffixes, vectorpack, warc


QUERIES = {
    "op1_jaccard_join": jaccard.query,
    "op2_warc_packages": warc.query,
    "op3_embedding_dedup": hnsw.query,
    "op4_source_mixing": mixing.query,
    "op5_suffix_dedup": suffixes.query,
    "op6_html_extraction": styletree.query,
    "op7_token_packing": packing.query,
    "op8_substring_dedup": substring.query,
    "op9_language_id": langid.query,
    "op10_decontamination": decontaminate.query,
    "op11_vector_packing": vectorpack.query,
    "op12_filter_audit": filteraudit.query,
    "op13_vector_codes": parttrie.query,
}


def shipping(query):
    """The query, with this package given to the executors first."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        common.ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: shipping(query) for name, query in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_jaccard_join": jaccard.ORACLE,
        "op2_warc_packages": warc.ORACLE,
        "op3_embedding_dedup": hnsw.ORACLE,
        "op8_substring_dedup": substring.ORACLE,
        "op12_filter_audit": filteraudit.ORACLE,
        "op13_vector_codes": parttrie.ORACLE,
    }
