"""Decontamination against a plain search of every item in every document."""

import os

import numpy as np
from pyspark.sql import functions as F

from orgcard.llm import common, decontaminate

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(row[j + 1], new[j], row[j] + (x == y)))
        row = new
    return row[-1]


def test_lcs():
    import random
    r = random.Random(2)
    for _ in range(300):
        a, b = ([r.randrange(5) for _ in range(r.randrange(1, 20))] for _ in range(2))
        assert decontaminate.lcs_length(a, b) == plain_lcs(a, b)


def plain(docs, items):
    """Items of which 0.8 of the words are in some stretch of one and a half their length, in order."""
    out = {}
    for key, text in docs:
        w = decontaminate.words_of([(text or "").encode()])[0].tolist()
        for item, words in items:
            n, have = len(words), set(words)
            if sum(x in have for x in w) < 0.8 * n:
                continue
            for at in range(0, max(1, len(w) - n // 2), max(1, n // 4)):
                if plain_lcs(words, w[at:at + n + n // 2]) >= 0.8 * n:
                    out.setdefault(key, set()).add(item)
                    break
    return out


def test_recall_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    rows, items = [tuple(r) for r in docs.collect()], []
    for r in benchmark.collect():
        items.append((r.item_id, decontaminate.words_of([r.text.encode()])[0].tolist()))
    words = benchmark.first().text.split()
    changed = " ".join(w if i % 8 else "zzz" for i, w in enumerate(words))  # an eighth of the words replaced
    rows += [(10**6, "nothing here " * 30 + changed.upper() + " and on it goes" * 20), (10**6 + 1, None), (None, benchmark.first().text)]
    expected = plain(rows, items)
    out = decontaminate.found_items(spark.createDataFrame(rows, docs.schema), benchmark).collect()
    assert len(out) == len(rows)
    got = {(None if r.key == common.NO_ID else r.key): set(r.item_ids) for r in out if r.n_items}
    links = {(k, i) for k, v in expected.items() for i in v}
    found = {(k, i) for k, v in got.items() for i in v}
    assert len(links & found) >= 0.98 * len(links) and 10**6 in got and None in got
    assert set(got) <= set(expected)  # clean documents stay clean


def test_special_cases(spark):
    documents = "doc_id long, text string, key string, n_items int"
    items = spark.createDataFrame([(1, None), (2, "..."), (3, "what is the colour of the sea? It is deep blue"), (3, "what is the colour of the sea? It is deep blue"),
                                   (None, "one two three four five six seven")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Q: WHAT is the colour of the sea! it is deep blue.", "a", 1), (2, "", "a", 1), (3, "the sea is blue", "a", 1),
                                  (4, "one two three four five six seven", "a", 1)] + [(5, f"filler text number {i}", "a", 1) for i in range(50)], documents)
    out = {r.key: r for r in decontaminate.found_items(docs, items).collect()}
    assert out[1].item_ids == [3, 3] and out[2].n_items == 0 and out[3].n_items == 0 and out[4].n_items == 1 and out[4].item_ids == []
    assert decontaminate.found_items(spark.createDataFrame([], documents), items).collect() == []
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(r.n_items == 0 for r in decontaminate.found_items(docs, none).collect())


def test_copies_of_a_frequent_item(spark):
    """Verbatim copies are found however many of the documents hold the item, so that its words weigh nothing."""
    import random
    r = random.Random(5)
    common_words, rare = [f"w{i}" for i in range(40)], [f"rare{i}" for i in range(5000)]
    item = [f"hot{i}" for i in range(36)]
    rows = []
    for i in range(300):
        around = [r.choice(rare if i % 2 else common_words) for _ in range(r.randrange(30, 200))]
        at = r.randrange(len(around))
        rows.append((i, " ".join(around[:at] + item * (i % 3 == 0) + around[at:])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(f"other{i}" for i in range(50)))], "item_id long, text string")
    assert {x.key for x in decontaminate.found_items(docs, items).collect() if x.item_ids == [1]} == set(range(0, 300, 3))
    everywhere = spark.createDataFrame([(i, " ".join(item)) for i in range(9)], "doc_id long, text string")
    assert all(x.item_ids == [1] for x in decontaminate.found_items(everywhere, items).collect())


def test_recall_of_paraphrases_that_keep_the_answer(spark):
    """The branch of 0.6 and the answer against brute force over every stretch of an item's length and a half."""
    import random
    r = random.Random(9)
    frequent, rare = [f"w{i}" for i in range(300)], [f"rare{i}" for i in range(9000)]
    items, rows = [], []
    for k in range(12):
        n = r.randrange(24, 60)
        items.append((k, [r.choice(frequent) for _ in range(n)], [r.choice(frequent) for _ in range(6)]))
    for i in range(360):
        k, question, answer = items[i % 12]
        words, n = list(question), len(question) + len(answer)
        for at in r.sample(range(len(question)), int((0.2, 0.3, 0.38)[i % 3] * n)):
            words[at] = r.choice(rare if i // 12 % 2 else frequent)
        around = [r.choice(frequent) for _ in range(r.randrange(20, 300))]
        at = r.randrange(len(around))
        rows.append((i, " ".join(around[:at] + words + answer + around[at:])))
    rows += [(1000 + i, " ".join(r.choice(frequent) for _ in range(200))) for i in range(60)]
    benchmark = spark.createDataFrame([(k, " ".join(q) + ". " + " ".join(a)) for k, q, a in items], "item_id long, text string")
    got = {x.key: set(x.item_ids) for x in decontaminate.found_items(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()}
    assert [i for i in range(360) if i % 12 not in got[i]] == []
    for i, text in rows:
        words = text.split()
        for k in got[i]:
            item, answer = items[k][1] + items[k][2], items[k][2]
            # no stretch that is looked at is longer than three times the item
            stretches = [words[at:at + 3 * len(item)] for at in range(0, max(1, len(words) - 2 * len(item)), 4)]
            assert any(plain_lcs(item, x) >= 0.57 * len(item) and plain_lcs(answer, x) >= len(answer) - 1 for x in stretches)


def test_reworded_items_are_found_through_the_latent_space(spark):
    """Items whose plain words are all replaced share under 0.6 of their words; only the latent space leads to them."""
    import random
    r = random.Random(21)
    plain = [f"w{i}" for i in range(400)]
    items = [([f"topic{k}x{j}" for j in range(12)], [f"answer{k}x{j}" for j in range(4)]) for k in range(15)]

    def wording(k):
        return " ".join(f"{word} {r.choice(plain)}" for word in items[k][0])

    benchmark = spark.createDataFrame([(k, f"{wording(k)} {' '.join(r.choices(plain, k=4))}. {' '.join(items[k][1])}") for k in range(15)], "item_id long, text string")
    rows = []
    for i in range(150):
        before, after = (" ".join(r.choices(plain, k=r.randrange(5, 120))) for _ in range(2))
        rows.append((i, f"{before} {wording(i % 15)} {' '.join(r.choices(plain, k=3))} {' '.join(items[i % 15][1])} {after}"))
    rows += [(1000 + i, " ".join(r.choices(plain, k=150))) for i in range(1500)]
    # the topic without the answer is no copy, nor is the answer alone
    rows += [(3000 + k, " ".join(r.choices(plain, k=40)) + " " + wording(k)) for k in range(15)] + [(4000 + k, " ".join(items[k][1])) for k in range(15)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got, without = ({x.key: x.item_ids for x in decontaminate.found_items(docs, benchmark, cosine=c).collect()} for c in (decontaminate.COSINE, 2.0))
    assert sum(got[i] == [i % 15] for i in range(150)) >= 0.9 * 150
    assert sum(bool(without[i]) for i in range(150)) <= 0.1 * 150
    assert all(not found for i, found in got.items() if i >= 1000)


def test_latent_space_is_fitted_to_the_corpus_too(spark):
    """What the documents are about, in words that no item has, has directions of its own in the space."""
    import numpy as np
    topics = [[f"topic{k}x{j}" for j in range(20)] for k in range(3)]
    docs = spark.createDataFrame([(i, " ".join(topics[i % 3])) for i in range(300)], "doc_id long, text string").withColumn("text", F.col("text").cast("binary"))
    benchmark = spark.createDataFrame([(f"item{i} " * 3 + f"other{i}",) for i in range(5)], "text string").withColumn("text", F.col("text").cast("binary"))
    weights = spark.sparkContext.broadcast(np.ones(decontaminate.TERMS, np.float32))
    space = decontaminate.fitted(docs.select("text"), benchmark, weights, 128, 16, 8)
    assert np.allclose(space.T @ space, np.diag(np.diag(space.T @ space)), atol=1e-3)
    for words in [*topics, ["item1", "item1", "item1", "other1"]]:
        v = np.zeros(decontaminate.DIMENSIONS)
        np.add.at(v, decontaminate.dimensions_of(decontaminate.words_of([" ".join(words).encode()])[0]), 1)
        assert np.linalg.norm(v @ space) > 0.95 * np.linalg.norm(v)


def test_stretches_without_rare_words_are_dropped_before_words_are_counted():
    """Few stretches of common words reach the count, and all that hold what a match needs come out of it."""
    random = np.random.RandomState(5)
    common_words, rare = [f"w{i}" for i in range(30)], [f"r{i}" for i in range(400)]
    texts = [" ".join([*(common_words[(10 * k + i) % 30] for i in range(10)), *random.choice(rare, 8)]).encode() for k in range(12)]
    weights = np.ones(decontaminate.TERMS, np.float32)
    weights[decontaminate.terms_of(decontaminate.words_of([" ".join(common_words).encode()])[0])] = 0.01
    items = decontaminate.Items(list(range(12)), texts, np.zeros((decontaminate.DIMENSIONS, 4), np.float32), weights, 0.6)
    plain = [" ".join(random.choice(common_words, 18)).encode() for _ in range(200)]
    h, first = decontaminate.words_of([*plain, *texts])
    known, words = items.known(h)
    assert known.all() and np.array_equal(items.vocabulary[words], h)
    (_, members, _, postings), = items.groups
    begin, item_of, times, needed, bounds = postings
    seen = []
    for text, (i, j) in enumerate(zip(first[:-1], first[1:])):
        own = set(words[i:j].tolist())
        total = np.zeros(len(needed), int)
        for w in own:
            np.add.at(total, item_of[begin[w]:begin[w + 1]], times[begin[w]:begin[w + 1]])
        looked_up = int((np.diff(begin)[words[i:j]] > 0).sum())
        seen += [(text, m) for m in np.flatnonzero(total >= needed) if looked_up >= needed.min()]
    found = [(int(r), int(m)) for row, item in decontaminate.overlapping(words, first[:-1], first[1:], postings) for r, m in zip(row, item)]
    assert sorted(found) == sorted(seen) and {(200 + k, k) for k in range(12)} <= set(found)
    passed = np.logical_and.reduce([np.add.reduceat(often[words], first[:-1]) >= least for often, least in bounds])
    assert passed[200:].all() and passed[:200].sum() < 20
