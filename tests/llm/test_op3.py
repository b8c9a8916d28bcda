"""Graph search against brute force."""

import numpy as np
import pytest

from orgcard.llm import common, hnsw

SCHEMA = "vec_id long, embedding array<float>, label int, key string, hash long"


def vectors(seed, n=900, dim=16, labels=3):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        if i % 4 == 3:  # near copies of earlier ones, one hot
            base = np.array(rows[0 if i % 8 == 7 else int(r.integers(len(rows)))][1])
            v, label = base + r.normal(size=dim) * 0.02 * np.linalg.norm(base) / np.sqrt(dim), rows[0][2] if i % 8 == 7 else int(r.integers(labels))
        else:
            v, label = r.normal(size=dim) * 10.0 ** r.integers(-3, 4), int(r.integers(labels))
        rows.append((i, [float(x) for x in v.astype(np.float32)], label))
    return rows


def brute(rows, cosine):
    x = [None if v is None or label is None or not len(v) or any(c is None or not np.isfinite(c) for c in v) or not any(v)
         else np.array(v, float) / np.linalg.norm(np.array(v, float)) for _, v, label in rows]
    ids = [common.NO_ID if i is None else i for i, _, _ in rows]
    root, links = {i: i for i in ids}, [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if x[a] is not None and x[b] is not None and rows[a][2] == rows[b][2] and len(x[a]) == len(x[b]) and x[a] @ x[b] >= cosine:
                links[a] += 1
                links[b] += 1
                p, q = sorted((find(ids[a]), find(ids[b])))
                root[q] = p
    return sorted((i, n, find(i)) for i, n in zip(ids, links))


@pytest.mark.parametrize("seed,shard", [(1, 4096), (2, 100)])
def test_links_and_components(spark, seed, shard):
    rows = vectors(seed)
    rows += [(10**6, None, 1), (10**6 + 1, [0.0] * 16, 1), (10**6 + 2, [1.0, None] * 8, 1), (10**6 + 3, [float("nan")] * 16, 1),
             (10**6 + 4, rows[5][1], None), (10**6 + 5, [], 1), (10**6 + 6, rows[8][1][:7], rows[8][2]), (None, rows[9][1], rows[9][2]),
             rows[11], *[(2 * 10**6 + i, rows[12][1], rows[12][2]) for i in range(30)], (10**6 + 7, [float("inf")] * 16, 1)]
    frame = spark.createDataFrame([(i, v, label, "x", 7) for i, v, label in rows], SCHEMA)
    out = sorted((r.key, r.n_links, r.component_id) for r in hnsw.linked(frame, shard_rows=shard).collect())
    want = brute(rows, 0.98)
    assert [x[0] for x in out] == [x[0] for x in want]
    total = sum(x[1] for x in want)
    assert sum(x[1] for x in out) >= 0.99 * total and all(a[1] <= b[1] for a, b in zip(out, want))
    assert sum(a[2] == b[2] for a, b in zip(out, want)) >= 0.99 * len(want)


def test_recall_of_nearest():
    x = hnsw.unit(np.random.default_rng(4).normal(size=(1500, 32)))
    g = hnsw.Graph(x)
    beam = g.audited_beam(0.98)
    ids, _ = g.search(x[:200], beam)
    true = np.argsort(-(x[:200] @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a[:10]) & set(b)) / 10 for a, b in zip(ids, true)]) >= 0.9


def test_empty(spark):
    assert hnsw.linked(spark.createDataFrame([], SCHEMA)).collect() == []
    out = hnsw.linked(spark.createDataFrame([(1, [1.0, 2.0], 3, "x", 1)], SCHEMA)).collect()
    assert [(r.key, r.n_links, r.component_id) for r in out] == [(1, 0, 1)]
