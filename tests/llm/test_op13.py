"""Vector codes: plain distances over all entries, round by round."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orgcard.llm import parttrie

SCHEMA = "vec_id long, embedding array<float>, label int, key int, v string, part int, x int"


def plain(rows, parts=4, entries=256, rounds=4):
    """Codes, errors and books by Python integers."""
    kept = [(k, [math.floor(1024 * x) for x in map(float, map(np.float32, v))]) for k, v in rows
            if v is not None and all(x is not None and math.isfinite(np.float32(x)) for x in v)]
    longest = max((len(v) for _, v in kept), default=0)
    width = -(-longest // parts) * parts
    kept = sorted(((k is None, k or 0, v + [0] * (width - len(v))) for k, v in kept))
    step = width // parts
    cut = [[v[p * step:(p + 1) * step] for p in range(parts)] for _, _, v in kept]
    books = [[list(x[p]) for x in cut[:entries]] for p in range(parts)]
    nearest = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c)), i) for i, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            found = {}
            for x in cut:
                found.setdefault(nearest(x[p], books[p])[1], []).append(x[p])
            for i, xs in found.items():
                books[p][i] = [sum(column) // len(xs) for column in zip(*xs)]
    out = []
    for (none, k, _), x in zip(kept, cut):
        best = [nearest(x[p], books[p]) for p in range(parts)]
        out.append((None if none else k, [i for _, i in best], sum(d for d, _ in best)))
    return out, books


def rows_of(r, n, dims, spread):
    vectors = [[r.choice([-1, 1]) * r.randrange(spread) / 64 + r.random() / 2048 for _ in range(dims)] for _ in range(n)]
    return [(i * 3, r.choice(vectors), r.choice([None, 1, 2]), 1, "v", 2, 3) for i in range(n)]


@pytest.mark.parametrize("n,dims,spread,entries", [(300, 8, 3, 16), (120, 6, 40, 7), (40, 3, 2, 64), (200, 4, 1, 5)])
def test_against_plain_distances(spark, monkeypatch, n, dims, spread, entries):
    monkeypatch.setattr(parttrie, "LEAVES", 16)
    rows = rows_of(random.Random(n), n, dims, spread)
    out, books = parttrie.compressed(spark.createDataFrame(rows, SCHEMA).repartition(5), entries=entries)
    want, plain_books = plain([x[:2] for x in rows], entries=entries)
    assert books.tolist() == plain_books
    assert sorted((x.key, x.codes, x.error) for x in out.collect()) == sorted(want)


def test_walk_shares_and_agrees():
    r = np.random.default_rng(1)
    for depth, n, high, leaves in [(1, 900, 2000, 8), (3, 2000, 6, 8), (6, 700, 3, 16), (5, 3000, 50, 256), (4, 1, 9, 8)]:
        rows = np.unique(r.integers(-high, high, (n, depth)), axis=0)
        entries = r.integers(-high, high, (33, depth))
        before, parttrie.LEAVES = parttrie.LEAVES, leaves
        try:
            walk = parttrie.Walk(rows, entries)
        finally:
            parttrie.LEAVES = before
        d = ((rows[:, None, :] - entries[None]) ** 2).sum(axis=2)
        assert (walk.nearest == d.argmin(axis=1)).all() and (walk.distance == d.min(axis=1)).all()


def test_special_cases(spark):
    make = lambda rows: spark.createDataFrame([(*x, 1, "v", 2, 3) for x in rows], SCHEMA)
    good = [(5, [0.5, -0.25, 1.0, 2.0], 1), (5, [0.5, -0.25, 1.0, 2.0], 1), (5, [0.1, 0.0, 0.0, 0.0], None), (None, [1.0, 1.0, 1.0, 1.0], None), (1, [1.0], 2), (2, [], 2)]
    bad = [(7, None, 1), (8, [1.0, None, 1.0, 1.0], 1), (9, [1.0, float("nan"), 1.0, 1.0], 1), (10, [1.0, float("inf"), 1.0, 1.0], 1), (11, [3e38, 1.0, 1.0, 1.0], 1)]
    out, books = parttrie.compressed(make(good + bad), entries=3)
    want, plain_books = plain([x[:2] for x in good], entries=3)
    key = lambda x: (x[0] is None, x[0] or 0, x[1], x[2])
    assert sorted(((x.key, x.codes, x.error) for x in out.collect()), key=key) == sorted(want, key=key) and books.tolist() == plain_books
    assert parttrie.compressed(make([]))[0].collect() == []
    assert parttrie.compressed(make(bad[:1]))[0].collect() == []
    assert parttrie.compressed(make([(1, [], 1)]))[0].collect()[0].error == 0
    with pytest.raises(ValueError):
        parttrie.compressed(make(good), entries=0)


def test_sums_of_frequent_and_rare_labels(spark):
    labels = ["hot"] * 900 + [None] * 300 + [f"l{i % 2000}" for i in range(4000)]
    rows = spark.createDataFrame([(i, x, i) for i, x in enumerate(labels)], "key long, label string, error long")
    want = {}
    for i, x in enumerate(labels):
        want[x] = want.get(x, 0) + i
    got = parttrie.label_sums(rows).collect()
    assert len(got) == len(labels) and all(r.label_error == want[r.label] for r in got)


def test_one_value_is_counted_before_the_sort(spark, plan):
    """A part that a third of the vectors share is one row of the trie."""
    rows = spark.createDataFrame([(i, [0.0] * 4 if i % 3 else [i / 64] * 4, 1, 1, "v", 2, 3) for i in range(300)], SCHEMA)
    parts = parttrie.distinct_parts(parttrie.kept(rows, "vec_id", "embedding", "label", 1024), 4, 4)
    assert parts.where("part = 0").agg(F.max("n"), F.count("*")).first() == (201, 100)
