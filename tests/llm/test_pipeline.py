"""The pipeline's stages against plain versions on a small corpus, and the registered names."""

import base64
import os

import numpy as np
import pyarrow as pa

import corpus_pipeline
from orgcard.llm import common, decontaminate, packing

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def sets_of(rows):
    out = []
    for r in rows:
        w = r.text.encode().lower().split()
        out.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = docs.first().text
    extra = [(None, text + " tail", None, None, 1), (None, "deux mots de la langue pour toi", None, None, 1), (10**7, None, "en", "x", 0), (10**7 + 1, "12 34", "en", "x", 0)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    kept = corpus_pipeline.identify(spark, docs, SF)
    assert kept.columns == docs.columns
    want = sorted((r.doc_id or -1, r.text) for r in docs.collect() if r.text and any(c.isalpha() for c in r.text))
    assert sorted((r.doc_id or -1, r.text) for r in kept.collect()) == want
    kept = common.stored(kept)

    rows = sorted(kept.collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    sets, root = sets_of(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    unique = common.stored(corpus_pipeline.deduplicate(spark, kept, SF))
    assert unique.columns == docs.columns
    assert sorted((r.doc_id or -1, r.text) for r in unique.collect()) == sorted((r.doc_id or -1, r.text) for i, r in enumerate(rows) if find(i) == i)

    clean = common.stored(corpus_pipeline.decontaminated(spark, unique, SF))
    left, items = {r.text for r in clean.collect()}, [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for r in unique.collect():
        if any(x in r.text for x in items):
            assert r.text not in left
    assert clean.columns == docs.columns and len(left) > 0.8 * unique.count()

    mixed = common.stored(corpus_pipeline.mixed(spark, clean, SF))
    assert mixed.columns == docs.columns
    size = {r.doc_id: len(r.text.encode().split()) for r in clean.collect()}
    taken = {}
    for r in mixed.collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len(r.text.encode().split())
        assert r.n_chars == len(r.text)
    assert all(n <= 3 * size[k] for k, n in taken.items()) and abs(sum(taken.values()) - sum(size.values())) < 0.05 * sum(size.values())

    out = corpus_pipeline.tokens(spark, mixed, SF).collect()
    with open(packing.RANKS, "rb") as f:
        names = {int(b): base64.b64decode(a) for a, b in (x.split() for x in f.read().splitlines())}
    got = {}
    for r in out:
        ids = np.frombuffer(bytes(r.ids), "<u2")
        for key, start, a, b in zip(r.doc_ids, r.piece_starts, r.cu_seqlens, r.cu_seqlens[1:]):
            got.setdefault(key, []).append(sum(len(names.get(int(t), b"")) for t in ids[a:b]))
    want = {}
    for r in mixed.collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + len(r.text.encode())
    assert {k: sum(v) for k, v in got.items()} == want


def test_run_and_names(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "mixing", "token_packing"]
    import __spark_entry__
    names = list(__spark_entry__.queries())
    assert "pipeline" in names and all(any(x.startswith(f"op{n}_") for x in names) for n in range(1, 11))


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        none_out = stage(spark, none, SF)
        assert none_out.collect() == []
    assert decontaminate.RANK


def test_texts_that_share_an_id_are_documents_of_their_own(spark):
    text = lambda name: " ".join(f"{name}{i}" for i in range(60))
    rows = [(1, text(x), "en", "s", 1) for x in "abcde"] + [(1, text("a"), "en", "s", 1), (0, text("b") + " tail", "en", "s", 1)]
    rows += [(2, text("c") + " end", "en", "s", 1), (None, text("n"), "en", "s", 1), (None, text("m"), "en", "s", 1), (3, text("z"), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = [(r.doc_id, r.text) for r in corpus_pipeline.deduplicate(spark, docs, SF).collect()]
    assert len(out) == len(set(out)) and set(out) <= {(i, t) for i, t, *_ in rows}
    by_first = lambda x: sorted(t[0] for _, t in x)
    assert by_first(out) == list("abcdemnz") and (0, text("b") + " tail") in out  # the least id of b's copies
    for few in (0, 10):
        corpus_pipeline.FEW, before = few, corpus_pipeline.FEW
        again = corpus_pipeline.with_vertex(docs).select("key").distinct().count()
        corpus_pipeline.FEW = before
        assert again == len(set(rows))


def test_tokens_are_made_of_small_slices(monkeypatch):
    seen, ids = [], packing.Encoder.ids

    class Docs:  # takes the task's function, as a session would
        sparkSession = type("S", (), {"sparkContext": type("C", (), {"broadcast": staticmethod(lambda x: type("B", (), {"value": x}))})})

        def select(self, *_):
            return self

        def mapInArrow(self, function, _):
            return function

    class Any:
        def __getattr__(self, _):
            return lambda *a, **k: self

    monkeypatch.setattr(packing, "F", Any())
    monkeypatch.setattr(packing.Encoder, "ids", lambda self, texts: seen.append(sum(map(len, texts))) or ids(self, texts))
    texts = [f"{i} some words of a text ".encode() * 400 for i in range(400)]
    batch = pa.RecordBatch.from_pydict({"key": pa.array(range(400), pa.int64()), "text": pa.array(texts, pa.binary())})
    rows = [r for out in packing.packed(Docs())([batch]) for r in out.to_pylist()]
    assert sum(seen) == sum(map(len, texts)) and max(seen) <= common.SLICE >> 1
    assert sorted({k for r in rows for k in r["doc_ids"]}) == list(range(400))


def test_a_task_gives_back_what_it_freed():
    calls, before = [], common.trim_heap
    common.trim_heap = lambda: calls.append(1)
    try:
        run = common.lean(lambda batches: (x + 1 for x in batches))
        assert list(run(iter([1, 2]))) == [2, 3] and calls == [1]
    finally:
        common.trim_heap = before


def test_near_copies_are_handed_over_in_small_batches(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.deduplicate(spark, docs, SF).count() == 1
    assert int(spark.conf.get(common.BATCH_ROWS)) == corpus_pipeline.NEAR_ROWS
    common.hand_over(spark)
