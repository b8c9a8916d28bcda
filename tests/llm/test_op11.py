"""Vector bin packing: exact round trip, limits, padding, and the heuristic against a plain search."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from orgcard.llm import vectorpack
from tests.llm.test_registered import SF_DIR

with open(public_tokenizers.path(vectorpack.TOKENIZER), encoding="utf-8") as f:
    DEFINITION = f.read()
PLAIN = Tokenizer.from_str(DEFINITION)
PLAIN.encode_special_tokens = True


def encode(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


def test_units_agree_with_the_whole_text():
    r, t = random.Random(3), vectorpack.Tokens(DEFINITION)
    parts = [" ", "  ", "\n", "\t", "a", "don't", "Été", "12", "!?", " ", "　", "'s", "x", "\x85", "ß", "the", "<|endoftext|>"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(40))) for _ in range(600)] + ["", " ", "a b", "   b"]
    for batch in (texts[:300], texts[300:], texts, [""]):
        ids, begin = t.ids([x.encode() for x in batch])
        for x, a, b in zip(batch, begin, begin[1:]):
            assert ids[a:b].tolist() == encode(x), repr(x)


def test_a_full_cache_is_emptied(monkeypatch):
    monkeypatch.setattr(vectorpack, "UNITS", 50)
    t = vectorpack.Tokens(DEFINITION)
    for k in range(6):
        texts = [f"word{i} and number{i + k}" for i in range(30)]
        ids, begin = t.ids([x.encode() for x in texts])
        assert [ids[a:b].tolist() for a, b in zip(begin, begin[1:])] == [encode(x) for x in texts]


def check(rows, want, tokens, segments, loss):
    """Sequences keep the limits and are gapless; the pieces of each document give its ids. Returns sequence lengths."""
    sequences, documents = {}, {}
    for r in rows:
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert r.length == len(ids) > 0
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length, r.loss_tokens, r.segment))
        documents.setdefault(r.doc_id, []).append((r.start, ids, r.doc_tokens))
    for pieces in sequences.values():
        pieces.sort()
        assert [p[0] for p in pieces] == np.cumsum([0, *(p[1] for p in pieces[:-1])]).tolist()
        assert [p[3] for p in pieces] == list(range(len(pieces))) and len(pieces) <= segments
        assert sum(p[1] for p in pieces) <= tokens and sum(p[2] for p in pieces) <= loss
    for key, ids in want.items():
        pieces = sorted(documents.pop(key))
        assert [t for _, own, _ in pieces for t in own] == ids
        assert [p[0] for p in pieces] == np.cumsum([0, *(len(p[1]) for p in pieces[:-1])]).tolist()
        assert {p[2] for p in pieces} == {len(ids)}
    assert not documents
    return [sum(p[1] for p in pieces) for pieces in sequences.values()]


@pytest.mark.parametrize("tokens,segments,loss", [(2048, 256, 2048), (64, 3, 64), (64, 64, 16), (100, 2, 7)])
def test_round_trip_of_documents(spark, tokens, segments, loss):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    more = [(None, None), (10**9, ""), (10**9 + 1, "word " * 5000), (10**9 + 2, "x")]
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    rows = vectorpack.packed(docs, DEFINITION, tokens=tokens, segments=segments, loss=loss, batch_tokens=20_000).collect()
    lengths = check(rows, {r.doc_id: [*encode(r.text), 1] for r in docs.collect()}, tokens, segments, loss)
    assert all(n == tokens or n & (n - 1) == 0 for n in lengths)
    if segments == 256:  # a task's last tokens make as many sequences as their number has binary ones
        assert sum(n < tokens for n in lengths) <= 11 * docs.rdd.getNumPartitions()


def turns(spark, n, seed=5):
    r = random.Random(seed)
    rows = [(i, [(" ".join(["tell"] * r.randrange(1, 30)), False), (" ".join(["yes"] * r.randrange(0, 25)), True)][: r.choice([1, 2, 2])]) for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, parts array<struct<text string, loss boolean>>")


@pytest.mark.parametrize("cut", [True, False])
def test_instruction_data_keeps_every_limit(spark, cut):
    rows, examples = turns(spark, 300)
    out = vectorpack.packed(examples.coalesce(2), DEFINITION, parts=F.col("parts"), tokens=128, segments=5, loss=40, cut=cut).collect()
    lengths = check(out, {i: [t for text, _ in parts for t in encode(text)] + [1] for i, parts in rows}, 128, 5, 40)
    if cut:
        assert all(n & (n - 1) == 0 for n in lengths)
    else:
        assert len(out) == len(rows)  # nothing exceeds a limit by itself
        need = np.array([(len(encode("".join(t for t, _ in parts))), 1, sum(len(encode(t)) for t, bears in parts if bears)) for _, parts in rows])
        assert len(lengths) <= 1.3 * (need.sum(axis=0) / [128, 5, 40]).max() + 2


def test_the_heuristic_against_a_plain_search():
    r = random.Random(2)
    for _ in range(40):
        limit = (r.randrange(8, 40), r.randrange(1, 6), r.randrange(4, 40))
        examples = []
        for i in range(r.randrange(1, 50)):
            bears = np.array([r.random() < 0.4 for _ in range(r.randrange(1, limit[0] + 1))])
            bears[np.cumsum(bears) > limit[2]] = False
            examples.append(vectorpack.Example(i, np.zeros(len(bears), np.uint16), np.concatenate([[0], np.cumsum(bears)])))
        packer = vectorpack.Packer(*limit, False)
        got = [sorted(e.key for e, _, _ in row) for row in packer.sequences(examples, True)]
        need = {e.key: (len(e.ids), 1, e.lost(0, len(e.ids))) for e in examples}
        share = np.mean([np.array(x) / limit for x in need.values()], axis=0)
        waiting, want = dict(need), []
        while waiting:
            room, row = list(limit), []
            while fits := [k for k, x in waiting.items() if all(a <= b for a, b in zip(x, room))]:
                score = {k: round(float(sum(share * np.array(need[k]) / limit * np.array(room) / limit)), 9) for k in fits}
                k = max(fits, key=lambda k: (score[k], need[k][0], -k))
                room = [a - b for a, b in zip(room, waiting.pop(k))]
                row.append(k)
            want.append(row)
        assert [sorted(need[k] for k in row) for row in got] == [sorted(need[k] for k in row) for row in want]


def test_special_cases(spark):
    schema = "doc_id long, text string, key string, ids long, parts array<struct<text string, loss boolean>>"
    pack = lambda rows, **kw: vectorpack.packed(spark.createDataFrame(rows, schema).coalesce(1), DEFINITION, **kw).collect()
    assert pack([]) == []
    same = pack([(1, "a", "x", 1, None)] * 3)
    assert len(same) >= 3 and sum(r.length for r in same) == 6 and {r.doc_id for r in same} == {1}
    parts = [(1, "a", "x", 1, None), (2, "a", "x", 1, []), (3, "a", "x", 1, [(None, None)]), (None, None, None, None, [("b c", None), ("d", True)])]
    out = pack(parts, parts=F.col("parts"), cut=False)
    assert sorted((r.doc_id or 0, r.length, r.loss_tokens) for r in out) == [(0, 4, 2), (1, 1, 1), (2, 1, 1), (3, 1, 0)]
    with pytest.raises(ValueError):
        pack([], tokens=0)


def test_query(spark):
    rows = vectorpack.query(spark, SF_DIR).collect()
    docs = {r.doc_id: [*encode(r.text), 1] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    for r in rows:
        ids = docs[r.doc_id][r.start:r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes()) and r.doc_tokens == len(docs[r.doc_id])
    assert sum(r.length for r in rows) == sum(map(len, docs.values()))
