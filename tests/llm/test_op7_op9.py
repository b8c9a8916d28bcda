"""Packing against an exact round trip; language ID against enumerated segmentations and held-out accuracy."""

import base64
import itertools
import os
import random

import numpy as np
import pytest

from orgcard.llm import common, langid, packing

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain_encoder():
    import tiktoken
    with open(packing.RANKS, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f.read().splitlines())}
    return tiktoken.Encoding("plain", pat_str=packing.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, key string, ids long")


def test_encoder_agrees_with_the_whole_text():
    r, encode = random.Random(3), plain_encoder()
    with open(packing.RANKS, "rb") as f:
        e = packing.Encoder(f.read())
    parts = [" ", "  ", "\n", "\t", "a", "don't", "Été", "12", "!?", " ", "　", "'s", "x", "\x85", "ß", "the"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(40))) for _ in range(600)] + ["", " ", "a b", "   b"]
    for batch in (texts[:300], texts[300:], texts):
        ids, begin = e.ids([x.encode() for x in batch])
        for x, a, b in zip(batch, begin, begin[1:]):
            assert ids[a:b].tolist() == encode(x) + [e.end], repr(x)


@pytest.mark.parametrize("length", [16, 2048])
def test_round_trip(spark, length):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(None, None), (10**9, ""), (10**9 + 1, "word " * 5000)], "doc_id long, text string"))
    rows = packing.packed(docs, length=length, batch_tokens=50_000).collect()
    encode, got = plain_encoder(), {}
    for r in rows:
        ids = np.frombuffer(bytes(r.ids), "<u2")
        assert len(ids) == length and r.n_tokens == r.cu_seqlens[-1] <= length and r.cu_seqlens[0] == 0
        assert r.resets == r.cu_seqlens[:-1] and (ids[r.n_tokens:] == 50256).all()
        for key, start, a, b in zip(r.doc_ids, r.piece_starts, r.cu_seqlens, r.cu_seqlens[1:]):
            got.setdefault(key, []).append((start, ids[a:b].tolist()))
    for r in docs.collect():
        whole = [t for _, piece in sorted(got.pop(r.doc_id)) for t in piece]
        assert whole == encode(r.text or "") + [50256]
    assert not got
    full = sum(r.n_tokens for r in rows) / (len(rows) * length)
    assert full > 0.9
    assert packing.packed(documents(spark, [])).collect() == []
    assert len(packing.packed(documents(spark, [(1, "a"), (1, "a")]).coalesce(1)).collect()[0].doc_ids) == 2


def test_best_fit():
    r = random.Random(1)
    for _ in range(60):
        length = r.choice([5, 16, 31])
        sizes = [r.randrange(1, length + 1) for _ in range(r.randrange(60))]
        rows, spaces = packing.best_fit_decreasing(sizes, length), []
        for n in sorted(sizes, reverse=True):  # the plain rule: the fullest row that still holds it
            fit = [i for i, s in enumerate(spaces) if s >= n]
            i = min(fit, key=lambda i: spaces[i], default=None)
            if i is None:
                spaces.append(length - n)
            else:
                spaces[i] -= n
        assert sorted(length - sum(sizes[i] for i in row) for row in rows) == sorted(spaces)
        assert sorted(i for row in rows for i in row) == list(range(len(sizes)))


def test_forward_sums_all_segmentations():
    pieces = sorted([b"a", b"b", b" ", b" a", b"ab", b"aba", b"ba", b"bab"])
    p = np.random.default_rng(0).random((len(pieces), 2))
    words = [b" abab", b"b", b" aabba", b"ababab"]
    lattice = langid.Lattice(langid.Trie(pieces), words)
    got = lattice.forward(p)[lattice.last]
    back = lattice.backward(p)[lattice.begin]
    for word, row, other in zip(words, got, back):
        total = np.zeros(2)
        for cuts in itertools.product([0, 1], repeat=len(word) - 1):
            at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(word)]
            parts = [word[a:b] for a, b in zip(at, at[1:])]
            if all(x in pieces for x in parts):
                total += np.prod([p[pieces.index(x)] for x in parts], axis=0)
        assert np.allclose(row, total) and np.allclose(other, total)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.identified(docs).select("key", "held_out", "lang_pred", "score").collect()
    lang = {r.doc_id: (r.lang, r.text) for r in docs.collect()}
    import zlib
    assert len(out) == len(lang)
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.key).encode()) % 4 == 2) and 0 <= r.score <= 1
    tested = [r for r in out if r.held_out and any(c.isalpha() for c in lang[r.key][1])]
    assert sum(r.lang_pred == lang[r.key][0] for r in tested) / len(tested) > 0.97


def test_special_cases(spark):
    rows = [(1, "the cat sat on the mat", "en", "x"), (2, "die Katze saß auf der Matte", "de", "x"), (3, None, "en", "x"),
            (4, "123 !?", "en", "x"), (5, "", None, "x"), (None, "the mat", None, "x"), (7, "k" * 5000, None, "x"), (1, "the cat", "en", "y")]
    schema = "doc_id long, text string, lang string, held_out string"
    out = {r.key: r for r in langid.identified(spark.createDataFrame(rows, schema), keep=("held_out",)).collect()}
    assert [out[k].lang_pred for k in (3, 4, 5)] == ["und"] * 3 and out[3].score == 0
    assert out[common.NO_ID].lang_pred in ("en", "de") and out[7].score > 0
    assert langid.identified(spark.createDataFrame([], schema)).collect() == []
    alone = langid.identified(spark.createDataFrame([(1, "abc", None, "x")], schema)).collect()
    assert alone[0].lang_pred == "und"


def test_the_sample_is_bounded_by_rows(spark):
    """Rows without an id, with one id for all or equal to each other are no way round the bound."""
    rows = [(None, f"word{i} the cat", "en") for i in range(60)] + [(7, f"wort{i} die Katze", "de") for i in range(60)] + [(8, "gleich", "fr")] * 50
    docs = spark.createDataFrame(rows, "key long, text string, lang string").withColumn("key", common.id_or_last("key"))
    assert {r.lang: r["count"] for r in langid.sampled(docs, 20).groupBy("lang").count().collect()} == {"en": 20, "de": 20, "fr": 1}


def test_caches_of_other_operators_are_dropped():
    common.cache("a")["x"] = 1
    assert common.cache("a") == {"x": 1}
    assert common.cache("b") == {} and common.cache("a") == {}
