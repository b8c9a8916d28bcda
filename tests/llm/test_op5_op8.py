"""Substring and suffix-array dedup against brute force."""

import hashlib
import random

import numpy as np
import pytest

from orgcard.llm import chunks, substring, suffixes

SCHEMA = "doc_id long, text string, n_words string, chunk string, key string"


def corpus(seed, ids):
    r = random.Random(seed)
    vocab = ["the", "of", "é", "strange", "naïve", "x", "a", "lorem", "ipsum", "Dolor", "sit"]
    line = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    shared = [line(n) for n in (9, 15, 40, 60)]
    out = []
    for i in ids:
        parts = [r.choice([line(r.randrange(12)), r.choice(shared), line(4)]) for _ in range(r.randrange(5))]
        out.append((i, r.choice([" ", "\n", "\t \x0b"]).join(parts)))
    out += [(out[3][0], out[3][1]), (10**6, out[5][1]), (10**6 + 1, None), (None, out[7][1]), (10**6 + 2, ""),
            (10**6 + 3, "a " * 60), (10**6 + 4, "ab" * 70), (10**6 + 5, "\x00" * 55 + "ab"), (10**6 + 6, "\xa0".join(shared))]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, x, "a", "b", "c") for i, x in rows], SCHEMA)


def words_brute(rows, width):
    from collections import Counter
    docs = [(i, (x or "").encode().split()) for i, x in rows]
    seen = Counter(tuple(w[s:s + width]) for _, w in docs for s in range(len(w) - width + 1))
    out = []
    for i, w in docs:
        gone = set()
        for s in range(len(w) - width + 1):
            if seen[tuple(w[s:s + width])] > 1:
                gone.update(range(s, s + width))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def bytes_brute(rows, length):
    last = 1 << 63
    docs = [(i, (x or "").encode()) for i, x in rows]
    least = {}
    for i, b in docs:
        for s in range(len(b) - length + 1):
            k = b[s:s + length]
            least[k] = min(least.get(k, last), last if i is None else i)
    out = []
    for i, b in docs:
        gone = [False] * len(b)
        for s in range(len(b) - length + 1):
            if least[b[s:s + length]] < (last if i is None else i):
                gone[s:s + length] = [True] * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and not p for g, p in zip(gone, [False, *gone]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("seed,chunk_bytes", [(1, 1 << 22), (2, 600), (3, 300)])
def test_words(spark, seed, chunk_bytes):
    rows = corpus(seed, range(60))
    for width, gram in ((35, 8), (6, 3)):
        out = substring.removed(frame(spark, rows), width=width, gram=gram, chunk_bytes=chunk_bytes).collect()
        got = ordered((None if r.key == substring.common.NO_ID else r.key, r.n_words, r.n_removed, r.kept_sha256) for r in out)
        assert got == ordered(words_brute(rows, width))


@pytest.mark.parametrize("seed,chunk_bytes", [(1, 1 << 22), (2, 600), (3, 300)])
def test_bytes(spark, seed, chunk_bytes):
    rows = corpus(seed, range(60))
    for length, gram in ((50, 16), (20, 6)):
        out = suffixes.removed(frame(spark, rows), length=length, gram=gram, chunk_bytes=chunk_bytes).collect()
        got = ordered((None if r.key == substring.common.NO_ID else r.key, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
                      for r in out)
        assert got == ordered(bytes_brute(rows, length))


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert substring.removed(none).collect() == [] and suffixes.removed(none).collect() == []
    nulls = frame(spark, [(None, None), (None, "")])
    assert [r.n_words for r in substring.removed(nulls).collect()] == [0, 0]
    assert [r.n_bytes for r in suffixes.removed(nulls).collect()] == [0, 0]


def test_loser_tree():
    r = random.Random(5)
    runs = [sorted(bytes(r.choice(b"ab") for _ in range(r.randrange(1, 9))) for _ in range(r.randrange(30))) for _ in range(7)]
    coded = [suffixes.decoded(*suffixes.front_coded(x)) for x in runs]
    assert [x for x, _ in coded] == runs
    out = [(runs[k][i], n) for k, i, n in suffixes.LoserTree(coded)]
    assert [x for x, _ in out] == sorted(x for y in runs for x in y)
    for (x, _), (y, n) in zip(out, out[1:]):
        assert n == suffixes.differ_at(x, y, 0)


def test_rows_of_one_id_are_spread_over_chunks(spark):
    from pyspark.sql import functions as F

    from orgcard.llm import common
    rows = spark.range(4000).select(F.lit(common.NO_ID).alias("key"), F.concat(F.lit("text "), "id").alias("text"))
    got = [r["count"] for r in chunks.dealt(rows, chunks.Layout(8 * common.CHUNK)).groupBy("chunk").count().collect()]
    assert len(got) == 8 and max(got) < 800


def test_rows_of_a_chunk_come_in_any_order(spark, monkeypatch):
    """On several executors the blocks of a chunk arrive in another order in each stage."""
    import numpy as np

    dealt = chunks.dealt

    def shuffled(batches):
        for batch in batches:
            yield batch.take(np.random.RandomState().permutation(len(batch)))

    def other_order(docs, layout, *cols):
        held = dealt(docs, layout, *cols)
        return held.mapInArrow(shuffled, held.schema)

    monkeypatch.setattr(chunks, "dealt", other_order)
    rows = corpus(4, range(60))
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        out = suffixes.removed(frame(spark, rows), chunk_bytes=3000).collect()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    got = ordered((None if r.key == substring.common.NO_ID else r.key, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out)
    assert got == ordered(bytes_brute(rows, 50))


def test_matches_keep_classes_apart_whose_mixed_hashes_are_equal(monkeypatch):
    """The classes are those of both hashes, by the one sort and by the other that is left for mixed hashes which collide."""
    r = random.Random(9)
    strings = [bytes(r.choice(b"ab") for _ in range(r.randrange(4, 12))) for _ in range(300)]
    right = np.array([r.randrange(0, len(x)) for x in strings])
    ids, group = np.arange(300)[::-1].copy(), np.repeat(np.arange(6), 50)
    least, seen = {}, []
    for i, (x, n) in enumerate(zip(strings, right.tolist())):
        text = x[n:][::-1] + x[:n]
        for offset in range(len(text) - 3):
            key = (text[offset:offset + 4], len(x) - n - offset, int(group[i]))
            seen.append((i, offset, key))
            least[key] = min(least.get(key, 999), int(ids[i]))
    expected = [(i, offset, least[key]) for i, offset, key in seen]
    starts, widths = suffixes.class_starts, []
    monkeypatch.setattr(suffixes, "class_starts", lambda *keys: widths.append(len(keys)) or starts(*keys))
    found = lambda: [tuple(map(int, row)) for row in zip(*suffixes.matches(strings, right, ids, group, 4))]
    assert found() == expected and widths == [2, 1]
    monkeypatch.setattr(suffixes, "class_starts", lambda *keys: widths.append(len(keys)) or (starts(*keys) if len(keys) == 2 else starts(keys[0] >> np.uint64(63))))
    assert found() == expected and widths[2:] == [2, 1, 2]
