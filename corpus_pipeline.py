"""A training corpus out of documents: five stages, each a table that the next one reads.

Language ID keeps what has a language; of each group of near copies one document stays; documents that hold benchmark
items go; sources are mixed to their weights; the rest is tokenised and packed. All stages but the last return the
columns of documents. Near copies here are sets of five-word shingles with a Jaccard similarity of 0.8 or more.

Results for special cases follow the operators: null or letterless texts are rejected by the first stage; for the
second, equal texts under one id are one document and different ones are documents of their own, of which the one with the
least hash counts as that id and the others come after all ids; a null id is kept as such.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orgcard.llm import common, decontaminate, jaccard, langid, mixing, packing

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
FEW = 200_000  # ids that have several texts, for a broadcast
ROWS = 2000  # with whole texts that go to a Python worker at a time
NEAR_ROWS = 4000  # the same for near copies, whose runs of keys are shorter the fewer rows they are made of
LEAST_SCORE = 0.5  # of a prediction; below it no language is more likely than all others together


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; lang becomes the predicted one where it was null."""
    common.ship(spark)
    common.hand_over(spark, ROWS)
    out = langid.identified(docs, keep=COLUMNS)
    out = out.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return out.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def with_vertex(docs: DataFrame) -> DataFrame:
    """Column key: the id, but for rows whose id has another text of less hash a number made of id and text."""
    text = F.xxhash64(F.col("text").cast("string"))
    several = docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("shared")).agg(F.min(text).alias("least"), F.max(text).alias("most"))
    several = common.cut(several.where("least <> most").select("shared", "least"))
    n = several.count()
    docs = docs.withColumn("key", jaccard.vertex("doc_id", "text"))
    if not n:
        return docs
    own = F.lit(jaccard.NAMELESS) + F.shiftrightunsigned(F.xxhash64("doc_id", F.col("text").cast("string")), 2)
    docs = docs.join(F.broadcast(several) if n <= FEW else several, F.col("doc_id") == F.col("shared"), "left")
    return docs.withColumn("key", F.when(text != F.col("least"), own).otherwise(F.col("key"))).drop("shared", "least")


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each component of near copies; documents without a link stay."""
    common.ship(spark)
    common.hand_over(spark, NEAR_ROWS)
    docs = with_vertex(docs.select(*COLUMNS))
    place = jaccard.joined(docs, gram=5, percent=80, id_col="key").where("key = component_id").select("key").distinct()
    first = F.min(F.struct("text", "lang", "source", "n_chars", "doc_id")).alias("row")  # of equal texts under one id
    return docs.join(place, "key", "left_semi").groupBy("key").agg(first).select(*(F.col(f"row.{c}") for c in COLUMNS))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    common.ship(spark)
    common.hand_over(spark, ROWS)
    found = decontaminate.found_items(docs, common.table(spark, sf_dir, "benchmark"), keep=COLUMNS)
    return found.where("n_items = 0").select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: a row for each time that words of a document are taken, with their text."""
    common.ship(spark)
    common.hand_over(spark, ROWS)
    out = mixing.mix(docs, with_text=True, keep=("lang",))
    return out.select(common.id_or_null("key").alias("doc_id"), "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed rows of token ids."""
    common.ship(spark)
    common.hand_over(spark, ROWS)
    return packing.packed(docs)


STAGES = [
    ("language_id", identify),
    ("near_duplicates", deduplicate),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("token_packing", tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir, each but the last written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    folder = f"{common.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
