"""The Jaccard join against all pairs."""

import random

import pytest

from orgcard.llm import jaccard

SCHEMA = "doc_id long, text string, n long, rep long"


def shingle_set(text, gram=4):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + gram]) for i in range(max(1, len(w) - gram + 1))} if w else set()


def brute(rows, percent):
    sets = [(jaccard.NAMELESS + k if i is None else i, shingle_set(x)) for k, (i, x) in enumerate(rows)]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, x) in enumerate(sets):
        for j, y in sets[:k]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return plain((i, len(x), find(i)) for i, x in sets)


def plain(rows):
    return sorted((min(i, jaccard.NAMELESS), n, min(c, jaccard.NAMELESS)) for i, n, c in rows)


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["The", "É"]
    line = lambda n: [r.choice(vocab) for _ in range(n)]
    shared, out = line(60), []
    for base in range(12):
        words = line(r.choice([3, 8, 15, 40, 90, 300])) + (shared if base % 3 == 0 else [])
        for _ in range(r.choice([1, 3, 12])):
            own = list(words)
            for _ in range(r.choice([0, 0, 1, 1, 2, 5])):
                at = r.randrange(len(own))
                own[at:at + r.randrange(2)] = line(r.randrange(2))
            out.append(" ".join(own))
    rows = [(i, x.upper() if i % 5 == 0 else x) for i, x in enumerate(out)]
    return rows + [(rows[4][0], rows[4][1]), (10**6, None), (10**6 + 1, "  "), (None, rows[7][1]), (None, "some text of its own"), (None, None), (10**6 + 2, "a b"), (10**6 + 3, "A b"), (10**6 + 4, "")]


@pytest.mark.parametrize("seed,boundary,block,percent", [(1, None, 2048, 85), (2, 0, 3, 85), (3, 1000, 2048, 85), (4, 30, 2, 60), (5, 60, 5, 70)])
def test_all_pairs(spark, seed, boundary, block, percent):
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, x, 1, 2) for i, x in rows], SCHEMA)
    out = jaccard.joined(docs, boundary=boundary, block=block, percent=percent).collect()
    assert plain((r.key, r.n_shingles, r.component_id) for r in out) == brute(rows, percent)


def test_empty(spark):
    assert jaccard.joined(spark.createDataFrame([], SCHEMA)).collect() == []
    alone = jaccard.joined(spark.createDataFrame([(3, None, 1, 1), (3, "x", 1, 1)], SCHEMA)).collect()
    assert sorted(r.n_shingles for r in alone) == [0, 1]


def test_boundary_has_least_cost():
    import numpy as np
    sizes = np.array([0, 5, 9, 3, 50, 20] + [7] * 200)

    def cost(x, scan):
        total = 0
        for n, many in enumerate(sizes):
            head = n - int(-(-85 * n // 100)) + 1
            total += many * ((head + 1) * head / 2 if n <= x else head * scan) if n else 0
        return total

    for scan in (1, 4, 8):
        assert cost(jaccard.boundary_of(sizes, 85, scan), scan) == min(cost(x, scan) for x in range(len(sizes)))
