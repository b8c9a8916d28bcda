"""What each filter of a chain removes, for every order in which the filters could be applied.

A row's mask has a bit for each filter it fails. In an order of the n filters the row goes at the first one that it fails.
Orders are numbered by their Lehmer rank, that is lexicographically, so all orders that begin with the same filters are
one interval of ranks. A mask is removed at step s by filter f exactly in the orders that begin with s - 1 filters outside
the mask and then f, which is one interval for each such beginning. So the rows of a mask are added where its intervals
begin and subtracted where they end, these differences are summed for each step and rank, and a prefix sum over
the n! ranks gives what each step of each order removes. Rows are never looked at once for each order.

Rows are first counted by part and mask (2**n masks at most), so what follows is as small as parts x n! x n rows. All of it
is DataFrame functions; the texts are read once and never shuffled, only their digests are.

A row fails the repeat filter if the same text stands under a smaller id anywhere in the table.

Results for special cases: a null text is an empty one; a null part is the empty string, and the same part as that; a
null id is neither smaller nor larger than any, so such rows never fail the repeat filter nor make others fail it; rows
with equal ids are rows of their own, so two rows of one id and text do not fail it for each other; an id that `labels`
holds more than once counts as labelled if any of its rows says so; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orgcard.llm import common

MOST_FILTERS = 7  # 5,040 orders, 35,280 rows for each part
COUNTS = ("n", "good", "toxic")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
REPEAT = "E"


def conditions(text: Column) -> dict[str, Column]:
    """The failure conditions of a text by filter letter, but for the repeat filter, which needs the whole table."""
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * (F.length(text) - F.length(F.translate(text, UPPER, ""))) > 2 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def removals(letters: str) -> list[tuple[int, int, int, int]]:
    """(mask, step, rank, +1 or -1): for each mask and each step where an interval of orders begins to remove it and where it
    ends. The rank where an interval of orders beginning with some filters begins is that of its first order."""
    n, out = len(letters), []
    for length in range(1, n + 1):
        for k, head in enumerate(permutations(range(n), length)):  # lexicographic, so the k-th of equal intervals
            size = factorial(n - length)
            outside = [i for i in range(n) if i not in head]
            for rest in range(1 << len(outside)):
                mask = 1 << head[-1] | sum(1 << i for j, i in enumerate(outside) if rest >> j & 1)
                out += [(mask, length, k * size, 1), (mask, length, (k + 1) * size, -1)]
    return out


def repeated(rows: DataFrame) -> DataFrame:
    """rows(digest, key, ...) with the column repeat: is the digest held by a row with a smaller key?"""
    first = rows.where("key is not null").groupBy("digest").agg(F.min("key").alias("key")).withColumn("first", F.lit(True))
    # The join is on digest and key: a text that many rows share is spread by their ids.
    return rows.join(first, ["digest", "key"], "left").withColumn("repeat", F.col("key").isNotNull() & F.col("first").isNull()).drop("first")


def masks(docs: DataFrame, labels: DataFrame, filters: dict[str, Column], repeat: str | None, id_col: str, text: Column, part: Column) -> DataFrame:
    """(part, mask, n, good, toxic): rows by part and failed filters. Bits are in the order of the filter letters."""
    letters = sorted([*filters, *([repeat] if repeat else [])])
    bit = {x: 1 << i for i, x in enumerate(letters)}
    failed = sum((F.when(F.coalesce(c, F.lit(False)), bit[x]).otherwise(0) for x, c in filters.items()), F.lit(0))
    rows = docs.select(F.col(id_col).cast("long").alias("key"), F.unhex(F.sha2(text, 256)).alias("digest"),
                       F.coalesce(part.cast("string"), F.lit("")).alias("part"), failed.cast("int").alias("mask"))
    # Equal rows become one with their number, so no key is frequent from here on but an id under many texts.
    rows = common.stored(rows.groupBy("digest", "key", "part", "mask").agg(F.count("*").alias("n")))
    if repeat:
        rows = repeated(rows).withColumn("mask", F.col("mask") + F.when(F.col("repeat"), bit[repeat]).otherwise(0))
    # By id, part and mask: an id under many texts is a few rows when it meets its label.
    rows = rows.groupBy("key", "part", "mask").agg(F.sum("n").alias("n"))
    yes = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).cast("int").alias(c)
    own = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("key")).agg(yes("quality"), yes("toxic"))
    rows = rows.join(own, "key", "left")
    total = lambda flag, name: F.sum(F.col("n") * F.coalesce(F.col(flag), F.lit(0))).alias(name)
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), total("quality", "good"), total("toxic", "toxic"))


def interactions(counts: DataFrame, letters: str) -> DataFrame:
    """counts(part, mask, n, good, toxic) as a row for each part, order and step."""
    n = len(letters)
    if not 1 <= n <= MOST_FILTERS or len(set(letters)) < n:
        raise ValueError(f"1 to {MOST_FILTERS} filters with letters of their own")
    spark, ranks = counts.sparkSession, factorial(n)
    counts = common.cut(counts)  # parts x 2**n rows at most
    ends = spark.createDataFrame(removals(letters), "mask int, step int, rank int, sign int").where(F.col("rank") < ranks)
    steps = counts.join(F.broadcast(ends), "mask").groupBy("part", "step", "rank").agg(*(F.sum(F.col(c) * F.col("sign")).alias(c) for c in COUNTS))
    # A row of zero differences for each part, step and rank: the prefix sums have a value everywhere.
    every = counts.groupBy("part").agg(F.sum("n").alias("rows"))
    grid = every.select("part", "rows", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step")).select(
        "part", "rows", "step", F.explode(F.sequence(F.lit(0), F.lit(ranks - 1))).alias("rank"))
    steps = grid.join(steps, ["part", "step", "rank"], "left")
    along = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.select("part", "rows", "step", "rank", *(F.sum(F.coalesce(c, F.lit(0))).over(along).alias(c) for c in COUNTS))
    orders = F.array(*(F.lit("".join(p)) for p in permutations(sorted(letters))))
    steps = steps.withColumn("filter_order", F.element_at(orders, F.col("rank") + 1)).withColumn("letter", F.expr("substring(filter_order, step, 1)"))
    so_far = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    alike = Window.partitionBy("part", "letter")
    steps = steps.withColumn("gone", F.sum("n").over(so_far)).withColumn("shapley", F.sum("n").over(alike))
    each = counts.select("part", "mask", "n", F.explode(F.array(*(
        F.struct(F.lit(x).alias("letter"), F.lit(1 << i).alias("bit")) for i, x in enumerate(sorted(letters))))).alias("f"))
    fails = each.groupBy("part", F.col("f.letter").alias("letter")).agg(
        F.sum(F.when(F.col("mask").bitwiseAND(F.col("f.bit")) != 0, F.col("n")).otherwise(0)).alias("fails"),
        F.sum(F.when(F.col("mask") == F.col("f.bit"), F.col("n")).otherwise(0)).alias("unique_fails"))
    return steps.join(fails, ["part", "letter"]).select(
        "part", "filter_order", "step", (F.col("rows") - F.col("gone")).alias("kept"), F.col("n").alias("removed"),
        (F.col("fails") - F.col("n")).alias("redundant"), "unique_fails", F.col("good").alias("good_lost"),
        F.col("toxic").alias("toxic_lost"), "shapley", F.col("letter").alias("filter"))


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Column] | None = None, repeat: str | None = REPEAT,
          id_col: str = "doc_id", text_col: str = "text", part: Column | None = None) -> DataFrame:
    """For each part, each order of the filters and each step: rows kept after it, removed by it, failing its filter but
    removed earlier (redundant), failing its filter alone, removed with label quality=1 and toxic=1, and the filter's
    removals summed over all orders (shapley). `filters` are failure conditions on docs by one-letter names (null: not
    failed), by default conditions(); `repeat` names the filter on repeated texts (None: without it)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    filters = conditions(text) if filters is None else filters
    letters = "".join(sorted([*filters, *([repeat] if repeat else [])]))
    return interactions(masks(docs, labels, filters, repeat, id_col, text, F.col("source") if part is None else part), letters)


def query(spark, sf_dir: str) -> DataFrame:
    return audit(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
      FROM labels GROUP BY doc_id),
m AS (
  SELECT part, concat(CASE WHEN len(w) < 200 THEN 'A' ELSE '' END, CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END,
                      CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END,
                      CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END, CASE WHEN w.doc_id > least THEN 'E' ELSE '' END) AS mask,
         coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
o(p) AS (SELECT '' UNION ALL SELECT p || x FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(p, x)),
s AS (SELECT p, i AS step, p[i] AS f, p[1:i - 1] AS before FROM (SELECT p FROM o WHERE length(p) = 5), (SELECT unnest(range(1, 6)) AS i)),
r AS (
  SELECT part, p, step, f, contains(mask, f) AS fails, mask = f AS alone, n, good, toxic,
         length(translate(mask, before, '')) < length(mask) AS gone
  FROM c, s),
a AS (
  SELECT part, p, step, f, sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END) AS removed, sum(CASE WHEN fails AND gone THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN alone THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN fails AND NOT gone THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN fails AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
  FROM r GROUP BY part, p, step, f)
SELECT part, p AS filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley, f AS filter
FROM a
"""
