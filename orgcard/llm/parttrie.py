"""Vectors compressed to short codes: each of a few consecutive parts becomes the index of its codebook's nearest entry.

Components become integers, floor(scale x component), so all distances are exact. The distinct values of each part, with
the number of vectors that have them, are sorted over the cluster; a task's run of sorted values is a trie in
lexicographic order whose levels are the dimensions. It is walked depth first. A node holds the distances of its prefix to
all entries, summed over the dimensions so far: a child adds one dimension to its parent's vector, so values with a common
prefix share its work. A leaf takes the nearest entry (the first of equals) and adds value x count to that entry's sums.
Subtrees of few leaves are walked level by level, all nodes of a level at once; the sharing is the same.

A round sends the codebooks, a fixed size, to the tasks and gets sums and counts of each entry back, summed in the
cluster. The last assignment walks the tries of the vectors' own batches, so no vector is shuffled for its code.

Results for special cases: rows whose vector is null or holds null or non-finite components go; so do vectors with a component of
2**28 / scale or more in magnitude, whose distances 64-bit integers need not hold. Vectors are filled up with zero components to the longest
one's length, and that to a multiple of the number of parts. A null id comes last among ids and stays null; rows with
equal ids are rows of their own, in the order of their components; with fewer vectors than entries the codebook is as short as their
number; null labels are one label; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgcard.llm import common

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
BOUND = 1 << 28  # of a component: the squares of 64 differences, or of 2**6 dimensions a part, stay below 2**63
LEAVES = 256  # of a subtree that is walked level by level
BATCH = 4096  # vectors at a time in the last pass
OFTEN = 1000  # labels that may be frequent: those with more than a thousandth of the rows
VECTORS = "key long, label string, v binary"
SUMS = "part int, entry int, n long, sums array<long>"


def integers(column, scale: int) -> tuple[np.ndarray, list[bytes]]:
    """For the rows of an Arrow list column: is it kept, and its integers as order-preserving big-endian bytes."""
    sizes = np.array([-1 if x is None else x for x in column.value_lengths().to_pylist()], np.int64)
    flat = column.flatten().cast(pa.float64())
    values = flat.fill_null(np.nan).to_numpy(zero_copy_only=False)
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = np.floor(values * float(scale))
    bad = ~(np.abs(scaled) < BOUND)
    end = np.cumsum(np.maximum(sizes, 0))
    wrong = np.concatenate([[0], np.cumsum(bad)])
    keep = (sizes >= 0) & (wrong[end] == wrong[end - np.maximum(sizes, 0)])
    data = to_bytes(np.where(bad, 0, scaled).astype(np.int64))
    return keep, [data[4 * (e - n):4 * e] for e, n in zip(end[keep].tolist(), sizes[keep].tolist())]


def to_bytes(values: np.ndarray) -> bytes:
    """Integers below 2**31 as bytes whose order is that of the numbers."""
    return (values + (1 << 31)).astype(">u4").tobytes()


def from_bytes(data: list[bytes], width: int) -> np.ndarray:
    """Rows of width integers; shorter ones are filled up with zeros."""
    zeros = to_bytes(np.zeros(width, np.int64))
    raw = b"".join(x + zeros[len(x):] for x in data)
    return (np.frombuffer(raw, ">u4").astype(np.int64) - (1 << 31)).reshape(len(data), width)


class Walk:
    """Depth-first walk of the trie of sorted distinct rows: nearest entry and its squared distance for each leaf."""

    def __init__(self, rows: np.ndarray, entries: np.ndarray):
        self.rows, self.columns = rows, np.ascontiguousarray(entries.T)
        n, self.depth = rows.shape
        # Where a value differs from the one before it: at this dimension or an earlier one.
        self.new = np.ones((n, self.depth), bool)
        if n > 1 and self.depth:
            np.logical_or.accumulate(rows[1:] != rows[:-1], axis=1, out=self.new[1:])
        self.nearest, self.distance = np.zeros(n, np.int64), np.zeros(n, np.int64)
        if n:
            self.walk(0, n, 0, np.zeros(len(entries), np.int64))

    def walk(self, lo: int, hi: int, depth: int, so_far: np.ndarray):
        """The leaves lo..hi, which agree in the dimensions before depth."""
        while hi - lo > LEAVES and depth < self.depth:
            edges = lo + np.flatnonzero(self.new[lo:hi, depth])
            if len(edges) and edges[0] == lo:
                edges = edges[1:]
            if len(edges):
                for a, b in self.children(lo, hi, edges.tolist()):
                    if b - a > LEAVES:
                        self.walk(a, b, depth + 1, so_far + (self.rows[a, depth] - self.columns[depth]) ** 2)
                    else:
                        self.level(a, b, depth, so_far)
                return
            so_far = so_far + (self.rows[lo, depth] - self.columns[depth]) ** 2
            depth += 1
        self.level(lo, hi, depth, so_far)

    @staticmethod
    def children(lo: int, hi: int, edges: list[int]):
        """Runs of leaves below the children of a node; neighbours that are few leaves together stay one run."""
        begin = lo
        ends = [*edges, hi]
        for i, end in enumerate(ends):
            if i + 1 == len(ends) or ends[i + 1] - begin > LEAVES:
                yield begin, end
                begin = end

    def level(self, lo: int, hi: int, depth: int, so_far: np.ndarray):
        """A small subtree, or a few neighbouring ones below one node, dimension by dimension."""
        sums, parent = so_far[None, :], np.zeros(hi - lo, np.int64)  # a row for each node; the node of each leaf
        for d in range(depth, self.depth):
            new = self.new[lo:hi, d].copy()
            new[0] = True
            first = np.flatnonzero(new)
            sums = sums[parent[first]] + (self.rows[lo + first, d][:, None] - self.columns[d]) ** 2
            parent = np.cumsum(new) - 1
        best = sums.argmin(axis=1)
        self.nearest[lo:hi] = best[parent]
        self.distance[lo:hi] = sums[np.arange(len(best)), best][parent]


def sums_of(walk: Walk, counts: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of parts of each entry and their sums."""
    n, sums = np.zeros(entries, np.int64), np.zeros((entries, walk.depth), np.int64)
    np.add.at(n, walk.nearest, counts)
    np.add.at(sums, walk.nearest, walk.rows * counts[:, None])
    return n, sums


def kept(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, scale: int) -> DataFrame:
    vectors = vectors.select(F.col(id_col).cast("long").alias("key"), F.col(label_col).cast("string").alias("label"),
                             F.col(vec_col).cast("array<double>").alias("v"))

    def convert(batches):
        for batch in batches:
            keep, data = integers(batch.column("v"), scale)
            rows = batch.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([rows.column("key"), rows.column("label"), pa.array(data, pa.binary())], names=["key", "label", "v"])

    return vectors.where("v is not null").mapInArrow(convert, VECTORS)


def distinct_parts(rows: DataFrame, width: int, parts: int) -> DataFrame:
    """(part, x, n): the distinct values of each part and how many vectors have them, sorted over the cluster."""
    step = 4 * width // parts
    zeros = F.lit(to_bytes(np.zeros(width, np.int64)))
    full = F.concat("v", F.expr(f"substring(zeros, octet_length(v) + 1)"))
    rows = rows.withColumn("zeros", zeros).select(full.alias("v"))
    each = F.explode(F.array(*(F.struct(F.lit(p).alias("part"), F.expr(f"substring(v, {p * step + 1}, {step})").alias("x")) for p in range(parts))))
    rows = rows.select(each.alias("p")).groupBy("p.part", "p.x").agg(F.count("*").alias("n"))
    return rows.repartitionByRange("part", "x").sortWithinPartitions("part", "x")


def round_of(parts: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round; books is (parts, entries, dimensions)."""
    shape = books.shape

    def assign(batches):
        total = {}
        for batch in batches:
            part, n = batch.column("part").to_numpy(), batch.column("n").to_numpy()
            x = batch.column("x").to_pylist()
            for p in np.unique(part).tolist():
                own = np.flatnonzero(part == p)
                walk = Walk(from_bytes([x[i] for i in own.tolist()], shape[2]), books[p])
                found = sums_of(walk, n[own], shape[1])
                before = total.get(p)
                total[p] = found if before is None else (before[0] + found[0], before[1] + found[1])
        rows = [(p, e, int(n[e]), sums[e].tolist()) for p, (n, sums) in total.items() for e in np.flatnonzero(n).tolist()]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
        columns = list(zip(*rows)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["part", "entry", "n", "sums"])

    found = parts.mapInArrow(assign, SUMS)
    each = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(shape[2])]
    books = books.copy()
    for row in found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *each).collect():  # parts x entries at most
        books[row["part"], row["entry"]] = np.array(row[3:], np.int64) // row["n"]
    return books


def label_sums(rows: DataFrame) -> DataFrame:
    """rows with label_error, the sum of error over the rows of equal label. Frequent labels, of which there are few, are
    broadcast; the rest meet their sums in a shuffle, where no label has more than a thousandth of the rows."""
    totals = common.cut(rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("rows")))
    often = F.col("rows") * OFTEN > (totals.agg(F.sum("rows")).first()[0] or 0)
    totals = totals.withColumn("often", often).drop("rows").withColumnRenamed("label", "l")
    frequent, rest = (totals.where(c).drop("often") for c in ("often", "not often"))
    same = F.col("label").eqNullSafe(F.col("l"))
    names = frequent.select(F.col("l").alias("name"))
    is_frequent = F.col("label").eqNullSafe(F.col("name"))
    return rows.join(F.broadcast(frequent), same).drop("l").unionByName(
        rows.join(F.broadcast(names), is_frequent, "left_anti").join(rest, same).drop("l"))


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
               id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """(rows, books): rows(key, label, codes array<int>, error long) of every vector that is kept, and the codebooks as an
    array of parts x entries x dimensions, a fixed size. Codebooks begin as the parts of the vectors with the least ids."""
    if not 1 <= entries or parts < 1:
        raise ValueError("at least one part and one entry")
    rows = common.stored(kept(vectors, id_col, vec_col, label_col, scale))
    longest = (rows.agg(F.max(F.octet_length("v"))).first()[0] or 0) // 4
    width = -(-longest // parts) * parts
    least = rows.orderBy(F.col("key").asc_nulls_last(), "v", "label").limit(entries).select("v").collect()
    first = from_bytes([bytes(r.v) for r in least], width)
    books = np.ascontiguousarray(first.reshape(len(least), parts, width // parts).transpose(1, 0, 2))
    if len(least) and width:
        trie = common.stored(distinct_parts(rows, width, parts))
        for _ in range(rounds):
            books = round_of(trie, books)
    final, step = books, width // parts

    def encode(batches):
        for batch in batches:
            for at in range(0, len(batch), BATCH):
                some = batch.slice(at, BATCH)
                x = from_bytes(some.column("v").to_pylist(), width)
                codes, error = np.zeros((len(x), parts), np.int32), np.zeros(len(x), np.int64)
                for p in range(parts if width else 0):
                    distinct, index = np.unique(x[:, p * step:(p + 1) * step], axis=0, return_inverse=True)
                    walk = Walk(distinct, final[p])
                    codes[:, p] = walk.nearest[index.reshape(-1)]
                    error += walk.distance[index.reshape(-1)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, parts), pa.int32()), pa.array(codes.reshape(-1)))
                yield pa.RecordBatch.from_arrays([some.column("key"), some.column("label"), lists, pa.array(error)], names=["key", "label", "codes", "error"])

    return rows.mapInArrow(encode, "key long, label string, codes array<int>, error long"), books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def query(spark, sf_dir: str) -> DataFrame:
    rows, books = compressed(common.table(spark, sf_dir, "embeddings"))
    rows = common.stored(rows)
    code = F.concat_ws("", F.transform("codes", lambda x: F.lpad(F.lower(F.hex(x)), 2, "0")))
    return label_sums(rows).select(F.col("key").alias("vec_id"), code.alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def oracle() -> str:
    """DuckDB SQL of query(): the rounds written out one after the other."""
    steps = [f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e, row_number() OVER (ORDER BY vec_id) - 1 AS r
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (
  SELECT vec_id, r, k, CAST(len(e) / {PARTS} AS BIGINT) AS w, e[CAST(k * len(e) / {PARTS} AS BIGINT) + 1:CAST((k + 1) * len(e) / {PARTS} AS BIGINT)] AS x
  FROM v, (SELECT unnest(range({PARTS})) AS k)),
b0 AS MATERIALIZED (SELECT k, r AS i, x AS c FROM p WHERE r < {ENTRIES})"""]
    for n in range(ROUNDS + 1):
        steps.append(f"""
n{n} AS MATERIALIZED (
  SELECT vec_id, k, min(s) AS s FROM (
    SELECT p.vec_id, p.k, struct_pack(d := list_sum(list_transform(list_zip(p.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), i := b.i) AS s
    FROM p JOIN b{n} b ON p.k = b.k) GROUP BY vec_id, k)""")
        if n < ROUNDS:
            steps.append(f"""
u{n} AS (SELECT k, i, list(m ORDER BY j) AS c FROM (
  SELECT k, i, j, CAST(floor(CAST(sum(y) AS DOUBLE) / count(*)) AS BIGINT) AS m FROM (
    SELECT n.k, n.s.i AS i, unnest(p.x) AS y, generate_subscripts(p.x, 1) AS j FROM n{n} n JOIN p ON n.vec_id = p.vec_id AND n.k = p.k)
  GROUP BY k, i, j) GROUP BY k, i),
b{n + 1} AS MATERIALIZED (SELECT b.k, b.i, coalesce(u.c, b.c) AS c FROM b{n} b LEFT JOIN u{n} u ON b.k = u.k AND b.i = u.i)""")
    return ",".join(steps) + f""",
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY k, i)) AS h FROM b{ROUNDS}),
f AS (SELECT vec_id, string_agg(lpad(lower(to_hex(s.i)), 2, '0'), '' ORDER BY k) AS code, CAST(sum(s.d) AS BIGINT) AS error FROM n{ROUNDS} GROUP BY vec_id)
SELECT f.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM f JOIN v ON f.vec_id = v.vec_id, h
"""


ORACLE = oracle()
