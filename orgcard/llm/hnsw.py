"""Embedding near-dedup with hierarchical navigable small-world graphs, one for each shard of a label.

1. Equal vectors of a label are one class with the least id; classes are dealt to shards of about `shard_rows`.
2. A task builds a graph for each shard: a seeded geometric number of levels, diverse neighbours, vertices added in
   growing batches whose members also see each other.
3. Every block of classes queries every shard of its label. Searches run for many queries in step, as array operations.
   The beam is doubled until an audit passes: for `audit` rows of the shard, the neighbours found against brute force,
   both those within the threshold and the nearest ten, `recall` at least. A query whose whole beam is within the
   threshold then widens its own beam until it is not, so large groups are found to their end.
4. Cosines are verified in double precision. A task returns for each query the number of vectors linked and, instead of
   the links, a spanning forest of them; the forests are joined to components.

Results for special cases: a vector that is null, empty, zero or holds null or non-finite components, or whose label is
null, links with nothing; vectors of different length never link; equal rows link, rows that share an id are one
component; a null id counts as larger than every other and comes back null.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgcard.llm import common

COSINE, SHARD, NEIGHBOURS, BEAM, AUDIT, RECALL = 0.98, 4096, 12, 64, 256, 0.99


class Graph:
    """Unit vectors x and, for each level, up to `width` neighbours of each vertex (-1: none)."""

    def __init__(self, x: np.ndarray, seed: int = 1, width: int = NEIGHBOURS, beam: int = BEAM):
        self.x, n = np.ascontiguousarray(x, np.float32), len(x)
        random = np.random.RandomState(seed).random_sample(n)
        self.level = np.minimum((-np.log(1 - random) / np.log(width)).astype(int), 6)
        order = np.argsort(-self.level, kind="stable")  # the highest first: they are the entries of all others
        self.links = [np.full((n, 2 * width if k == 0 else width), -1, np.int32) for k in range(int(self.level.max(initial=0)) + 1)]
        self.entry, done = (int(order[0]) if n else -1), 1
        while done < n:
            size = min(256, max(1, done // 2), n - done)
            self._add(order[done:done + size], order[:done], max(beam, 2 * width))
            done += size

    def _add(self, new: np.ndarray, old: np.ndarray, beam: int):
        close = self.x[new] @ self.x[new].T
        np.fill_diagonal(close, -2)
        top = len(self.links) - 1
        start = np.full((len(new), 1), self.entry)
        for k in range(top, -1, -1):
            here = self.level[new] >= k
            ids, sims = self.search_level(self.x[new], start, k, beam if here.any() else 1)
            start = ids[:, :1]
            for row in np.flatnonzero(here):
                peers = np.argpartition(-close[row], min(8, len(new) - 1))[:8] if len(new) > 1 else np.zeros(0, int)
                peers = peers[(self.level[new[peers]] >= k) & (close[row, peers] > -2)]
                found = np.concatenate([ids[row][ids[row] >= 0], new[peers]])
                sim = np.concatenate([sims[row][ids[row] >= 0], close[row, peers]])
                self._link(int(new[row]), found, sim, k)

    def _link(self, v: int, found: np.ndarray, sim: np.ndarray, k: int):
        width = self.links[k].shape[1]
        chosen = self._diverse(found, sim, width if k else width // 2)
        own = self.links[k][v]
        chosen = chosen[~np.isin(chosen, own)]
        free = np.flatnonzero(own < 0)[:len(chosen)]
        own[free] = chosen[:len(free)]
        for u in chosen[:len(free)].tolist():
            other = self.links[k][u]
            if v in other:
                continue
            slot = np.flatnonzero(other < 0)
            if len(slot):
                other[slot[0]] = v
            else:
                around = np.append(other, v)
                kept = self._diverse(around, self.x[around] @ self.x[u], width)
                other[:] = -1
                other[:len(kept)] = kept

    def _diverse(self, found: np.ndarray, sim: np.ndarray, most: int) -> np.ndarray:
        """Nearest first, those that are nearer to v than to any chosen one; then the nearest of the rest."""
        order = np.argsort(-sim, kind="stable")
        found, sim = found[order], sim[order]
        near = self.x[found] @ self.x[found].T
        chosen: list[int] = []
        worst = np.full(len(found), -2.0, np.float32)
        for i in range(len(found)):
            if worst[i] < sim[i]:
                chosen.append(i)
                worst = np.maximum(worst, near[i])
                if len(chosen) == most:
                    break
        if len(chosen) < most:
            have = set(chosen)
            chosen += [i for i in range(len(found)) if i not in have][:most - len(chosen)]
        return found[chosen]

    def search_level(self, q: np.ndarray, start: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and cosines of the best `beam` vertices found for each query, best first; -1 where there are fewer."""
        links, n = self.links[k], len(q)
        seen = np.zeros((n, len(self.x)), bool)
        ids = np.full((n, beam), -1, np.int64)
        sims = np.full((n, beam), -3.0, np.float32)
        ids[:, 0] = start[:, 0]
        sims[:, 0] = np.einsum("ij,ij->i", q, self.x[start[:, 0]])
        seen[np.arange(n), start[:, 0]] = True
        opened = np.zeros((n, beam), bool)
        rows, take = np.arange(n), min(beam, max(4, beam // 8))  # opened at once: more of a wide beam
        while len(rows):
            waiting = np.where(opened[rows] | (ids[rows] < 0), -4.0, sims[rows])
            best = np.argpartition(-waiting, take - 1, axis=1)[:, :take]
            fresh = np.take_along_axis(waiting, best, 1) > -3.5
            live = fresh.any(1)
            rows, best, fresh = rows[live], best[live], fresh[live]
            if not len(rows):
                break
            np.put_along_axis(sub := opened[rows], best, True, 1)
            opened[rows] = sub
            nodes = np.take_along_axis(ids[rows], best, 1)
            near = np.where(fresh[:, :, None], links[np.maximum(nodes, 0)], -1).reshape(len(rows), -1)
            near = np.sort(near, axis=1)
            good = near >= 0
            good[:, 1:] &= near[:, 1:] != near[:, :-1]
            good &= ~seen[rows[:, None], np.maximum(near, 0)]
            r, c = np.nonzero(good)
            seen[rows[r], near[r, c]] = True
            sim = np.full(near.shape, -3.0, np.float32)
            sim[r, c] = np.einsum("ij,ij->i", q[rows[r]], self.x[near[r, c]])
            all_ids = np.concatenate([ids[rows], np.where(good, near, -1)], 1)
            all_sims = np.concatenate([sims[rows], sim], 1)
            all_open = np.concatenate([opened[rows], np.zeros(near.shape, bool)], 1)
            keep = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam] if all_sims.shape[1] > beam else np.tile(np.arange(beam), (len(rows), 1))
            ids[rows], sims[rows], opened[rows] = (np.take_along_axis(x, keep, 1) for x in (all_ids, all_sims, all_open))
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def search(self, q: np.ndarray, beam: int, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
        beam = min(beam, len(self.x))
        out = []
        for i in range(0, len(q), block):
            part = np.ascontiguousarray(q[i:i + block], np.float32)
            start = np.full((len(part), 1), self.entry)
            for k in range(len(self.links) - 1, 0, -1):
                start = self.search_level(part, start, k, 1)[0][:, :1]
            out.append(self.search_level(part, start, 0, beam))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros((0, beam), np.int64), np.zeros((0, beam), np.float32))

    def audited_beam(self, cosine: float, audit: int = AUDIT, recall: float = RECALL, beam: int = BEAM) -> int:
        """Least beam, doubling, whose searches find `recall` of the neighbours that brute force finds for some rows."""
        n = len(self.x)
        rows = np.unique(np.linspace(0, n - 1, min(audit, n)).astype(int))
        true = self.x[rows] @ self.x.T
        nearest = np.argpartition(-true, min(10, n - 1), axis=1)[:, :10]
        within = true >= cosine
        while beam < n:
            ids, _ = self.search(self.x[rows], max(beam, 10))
            got = np.zeros((len(rows), n + 1), bool)
            np.put_along_axis(got, np.where(ids < 0, n, ids), True, 1)
            enough = min(beam, n) > within.sum(1).max()  # a smaller beam cannot hold them; such queries widen on their own
            near = (got[:, :n] & within).sum() >= recall * within.sum() or not enough
            if near and np.take_along_axis(got[:, :n], nearest, 1).mean() >= recall:
                return beam
            beam *= 2
        return n

    def within(self, q: np.ndarray, cosine: float, beam: int) -> list[np.ndarray]:
        """For each query the vertices found with at least that cosine."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(q)
        rows = np.arange(len(q))
        while len(rows):
            ids, sims = self.search(q[rows], beam, max(8, 256 * BEAM // beam))
            more = []
            for i, row in enumerate(rows.tolist()):
                hit = (sims[i] >= cosine) & (ids[i] >= 0)
                out[row] = ids[i][hit]
                if hit.all() and beam < len(self.x):
                    more.append(row)
            rows, beam = np.array(more, int), 2 * beam
        return out


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what the links (a, b) connect, fewer than there are vertices."""
    root: dict[int, int] = {}

    def find(v: int) -> int:
        while root.setdefault(v, v) != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def unit(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def linked(vectors: DataFrame, cosine: float = COSINE, shard_rows: int = SHARD, audit: int = AUDIT, recall: float = RECALL,
           id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per row of vectors: key, n_links and component_id."""
    rows = vectors.select(common.id_or_last(id_col).alias("key"), F.col(label_col).cast("long").alias("label"),
                          F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.col("label").isNotNull() & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
                                                   & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("hash", F.when(fine, F.xxhash64("label", "v")))
    classes = common.stored(rows.where("hash is not null").groupBy("hash", "label", "v").agg(
        F.min("key").alias("rep"), F.count("*").alias("copies")).withColumn("dim", F.size("v")))
    sizes = common.cut(classes.groupBy("label", "dim").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards")))
    dealt = classes.join(sizes, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("rep"), F.col("shards")).cast("int"))
    dealt = dealt.select("label", "dim", "shard", "shards", "rep", "copies", "v")

    def build(t: pa.Table) -> pa.Table:
        order = np.argsort(t["rep"].to_numpy(), kind="stable")
        t = t.take(pa.array(order))
        x = unit(matrix(t["v"]))
        g, out = Graph(x), io.BytesIO()
        np.savez(out, x=x, rep=t["rep"].to_numpy(), copies=t["copies"].to_numpy(), beam=g.audited_beam(cosine, audit, recall),
                 entry=g.entry, **{f"links{k}": v for k, v in enumerate(g.links)})
        return t.slice(0, 1).select(["label", "dim", "shard", "shards"]).append_column("graph", pa.array([out.getvalue()], pa.large_binary()).cast(pa.binary()))

    graphs = dealt.groupBy("label", "dim", "shard").applyInArrow(build, "label long, dim int, shard int, shards int, graph binary")
    every = F.explode(F.sequence(F.lit(0), F.col("shards") - 1))
    graphs = common.stored(graphs).select("label", "dim", "shard", "graph", every.alias("block"))
    asking = dealt.select("label", "dim", F.col("shard").alias("block"), "rep", "v", every.alias("shard"))
    keys = ["label", "dim", "shard", "block"]

    def answer(graph: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(graph) or not len(queries):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        held = np.load(io.BytesIO(graph["graph"][0].as_py()))
        g = Graph.__new__(Graph)
        g.x, g.entry = held["x"].astype(np.float32), int(held["entry"])
        g.links = [held[f"links{k}"] for k in range(sum(name.startswith("links") for name in held.files))]
        x, rep, copies = held["x"], held["rep"], held["copies"]
        q, own = unit(matrix(queries["v"])), queries["rep"].to_numpy()
        found = g.within(q, cosine - 1e-4, int(held["beam"]))
        n = np.fromiter(map(len, found), np.int64, len(found))
        i, j = np.repeat(np.arange(len(q)), n), np.concatenate(found) if len(found) else np.zeros(0, np.int64)
        exact = np.einsum("ij,ij->i", q[i], x[j])
        sure = (exact >= cosine) & (own[i] != rep[j])
        i, j = i[sure], j[sure]
        links = np.bincount(i, weights=copies[j], minlength=len(q)).astype(np.int64)
        some = np.flatnonzero(links)
        edges = forest(own[i], rep[j])
        return pa.table({"a": pa.array([*own[some].tolist(), *(a for a, _ in edges)], pa.int64()),
                         "b": pa.array([*[None] * len(some), *(b for _, b in edges)], pa.int64()),
                         "n": pa.array([*links[some].tolist(), *[None] * len(edges)], pa.int64())})

    found = common.cut(graphs.groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInArrow(answer, "a long, b long, n long"))
    place = common.cut(common.components(found.where("b is not null").select("a", "b")))
    links = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    classes = classes.join(links, classes["rep"] == links["a"], "left").join(place, classes["rep"] == place["id"], "left").select(
        F.col("hash").alias("h"), F.col("label").alias("l"), F.col("v").alias("w"), "rep", "copies", "n", "component")
    classes = common.stored(classes)
    same = (rows["hash"] == classes["h"]) & (rows["label"] == classes["l"]) & (rows["v"] == classes["w"])
    return rows.join(classes, same, "left").select(
        "key", F.coalesce(F.coalesce("n", F.lit(0)) + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "rep", "key").alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    out = linked(common.table(spark, sf_dir, "embeddings"))
    return out.select(common.id_or_null("key").alias("vec_id"), "n_links", common.id_or_null("component_id").alias("component_id"),
                      (F.col("key") == F.col("component_id")).alias("kept"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND list_sum([x * x FOR x IN e]) > 0
      AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r(vec_id, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.vec_id),
m AS (SELECT vec_id, min(c) AS c FROM r GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, m.c AS component_id, vec_id = m.c AS kept
FROM m LEFT JOIN n USING (vec_id)
"""
