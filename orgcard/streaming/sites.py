"""Contacts of sites kept up to date while pages arrive.

What a page has to say (:func:`orgcard.operators.pagestore.answers_of`) depends on that page alone, so its markup is read and
parsed once, when it arrives; the answers are kept as a narrow table. A site depends on few pages: its homepage, sitemaps,
probed paths, visited pages and their frames, crawled or not. These are kept as ``wants(site_key, url_key)``. A micro-batch
touches the sites whose homepage arrives or that want an arriving page; only those are picked again, out of the answers.

Tables below ``path``, each with one folder for a micro-batch: ``answers``, ``wants``, ``sites``. A micro-batch that is replayed
replaces its own folders and reads those of earlier ones only, so it ends as it did. After any micro-batch :func:`read_sites`
gives what :func:`orgcard.plans.mining.mine_sites` gives on all pages that have arrived, in whatever order they came.

Pages without markup or without a valid address are left out. Of several pages of a URL the latest ``fetched_at`` counts, then the
least id. The list of sites is fixed for a checkpoint: the homepage of a site that is listed later must arrive again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from orgcard.functions.urls import url_key
from orgcard.operators import discovery, pagestore
from orgcard.operators.picking import pick_contacts, site_candidates
from orgcard.operators.results import latest_batch
from orgcard.operators.storage import BROADCAST_ROWS, materialize
from orgcard.plans.mining import visit_list
from orgcard.sources import dims
from orgcard.sources.pages import with_url_key

SITE_COLUMNS = "site_key string, email string, phone string, email_method int, phone_method int, broken boolean"
WANTS = "site_key string, url_key string"


def _small(keys: DataFrame) -> DataFrame:
    """Written keys, broadcast where they are few."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


class SiteTables:
    """The tables of one stream."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write(self, df: DataFrame, name: str, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/batch_id={batch_id}")

    def read(self, name: str, schema: str | StructType) -> DataFrame:
        fields = (StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
        return self.spark.read.schema(StructType([*fields, StructField("batch_id", LongType())])).parquet(f"{self.path}/{name}")

    def current(self, keys: DataFrame, schema: StructType, batch_id: int) -> DataFrame:
        """Written newest answers of some distinct written keys, as of a micro-batch."""
        kept = self.read("answers", schema).where(F.col("batch_id") <= batch_id).join(_small(keys), "url_key", "left_semi")
        order = F.struct(*(["fetched_at"] if "fetched_at" in kept.columns else []), -F.col("page_id"), "batch_id")
        row = F.max_by(F.struct(*[c for c in schema.names if c != "url_key"]), order)
        return materialize(kept.groupBy("url_key").agg(row.alias("row")).select("url_key", "row.*"), "current")


def arriving_answers(pages: DataFrame, sites: DataFrame, terms: tuple[str, ...], patterns: bool = False, **options) -> DataFrame:
    """Answers of pages for all purposes they can have: homepages are the listed ones, probed pages those at a common path."""
    body = with_url_key(pages.where(F.col("html").isNotNull())).where(F.col("url_key").isNotNull())
    homes = sites.select(F.col("site_key").alias("url_key"), F.lit(pagestore.HOME).alias("home"))
    probed = F.when(F.size(discovery.probed_roots(F.col("url_key"))) > 0, pagestore.PROBE).otherwise(0)
    bits = F.coalesce("home", F.lit(0)).bitwiseOR(probed).bitwiseOR(F.lit(pagestore.MAP | pagestore.VISIT))
    body = body.join(_small(homes), "url_key", "left").withColumn("bits", bits)
    carried = ("page_id", *(["fetched_at"] if "fetched_at" in pages.columns else []))
    return pagestore.answers_of(body, terms, patterns, carried, **options)


def _keys(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("url_key").isNotNull()).distinct()


def mine_touched(tables: SiteTables, touched: DataFrame, schema: StructType, batch_id: int) -> tuple[DataFrame, DataFrame]:
    """(sites, wants) of some written site keys, out of the answers that are kept."""
    current = lambda keys: tables.current(materialize(_keys(keys), "keys"), schema, batch_id)
    homes = current(touched.select(F.col("site_key").alias("url_key"))).where(F.col("sources").isNotNull())
    homes = homes.withColumn("site_key", F.col("url_key"))
    maps = homes.select("site_key", F.explode(F.transform("sitemaps", lambda u: url_key(u))).alias("url_key"))
    probed = discovery.probes(homes).select("site_key", url_key(F.col("probe_url")).alias("url_key"))
    wants = maps.unionByName(probed)
    second = current(wants.select("url_key"))
    # a page that is a homepage and wanted by another site answers for both, each as one row
    not_home = F.lit(~pagestore.HOME)
    answered = homes.drop("site_key").withColumn("bits", F.lit(pagestore.HOME)).unionByName(
        second.withColumn("bits", F.col("bits").bitwiseAND(not_home)))
    visits = materialize(visit_list(homes.select("site_key"), pagestore.ranked_pages(answered)), "visits")
    own = current(visits.select("url_key"))
    frames = visits.join(own.where(F.size("frame_keys") > 0).select("url_key", "frame_keys"), "url_key").select(
        "site_key", F.explode("frame_keys").alias("url_key"))
    framed = current(frames.select("url_key"))
    evidence = ["url_key", "candidates", "frame_keys"]
    picked = pick_contacts(site_candidates(visits, own.select(*evidence), framed.select(*evidence)))
    failed = visits.join(own.where(F.col("error").isNotNull()).select("url_key"), "url_key").select("site_key").distinct()
    rows = touched.join(picked, "site_key", "left").join(failed.withColumn("broken", F.lit(True)), "site_key", "left")
    rows = rows.withColumn("broken", F.coalesce("broken", F.lit(False))).select(
        "site_key", "email", "phone", F.col("email_method").cast("int"), F.col("phone_method").cast("int"), "broken")
    wants = wants.unionByName(visits.select("site_key", "url_key")).unionByName(frames)
    return rows, wants.where(F.col("url_key").isNotNull()).distinct()


def site_stream(
    arriving: DataFrame, sites: DataFrame, path: str, checkpoint: str, terms: list[str] | None = None, patterns: bool = False,
    **options,
) -> StreamingQuery:
    """Keeps the contacts of ``sites(site_key)`` up to date with ``arriving`` pages (page_id, url, html[, fetched_at])."""
    terms = tuple(dims.literal_terms() if terms is None else terms)
    spark = arriving.sparkSession
    sites = materialize(sites.select("site_key").where(F.col("site_key").isNotNull()).distinct(), "sites")
    # so that there is a table for the first micro-batch to read
    SiteTables(spark, path).write(spark.createDataFrame([], WANTS), "wants", -1)

    def step(batch: DataFrame, batch_id: int) -> None:
        tables = SiteTables(batch.sparkSession, path)
        answers = arriving_answers(batch, sites, terms, patterns, **options)
        tables.write(answers, "answers", batch_id)
        kept = tables.read("answers", answers.schema).where(F.col("batch_id") == batch_id)
        keys = materialize(kept.select("url_key").distinct(), "keys")
        own = keys.select(F.col("url_key").alias("site_key")).join(sites, "site_key", "left_semi")
        earlier = tables.read("wants", WANTS).where(F.col("batch_id") < batch_id)
        waiting = earlier.join(_small(keys), "url_key", "left_semi").select("site_key")
        touched = materialize(own.unionByName(waiting).distinct(), "touched")
        rows, wants = mine_touched(tables, touched, answers.schema, batch_id)
        tables.write(wants, "wants", batch_id)
        tables.write(rows, "sites", batch_id)

    return arriving.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    """One row for each site with a value or a visited page that breaks off, as of its newest micro-batch."""
    newest = latest_batch(SiteTables(spark, path).read("sites", SITE_COLUMNS), "site_key").drop("batch_id")
    return newest.where(F.col("email").isNotNull() | F.col("phone").isNotNull() | F.col("broken"))
