"""Benchmark decontamination by latent semantic retrieval.

1. TF-IDF: document frequencies of hashed terms over all passages (stretches of PASSAGE words) of all documents.
   A term's weight is the square of its idf, so that words of every passage hardly count.
2. Latent space: a randomised SVD of the matrix A of passages over their terms, of the corpus (all passages of all
   documents) and of the benchmark. Tasks sum G = A'(A W) for a fixed Gaussian W, an array of DIMENSIONS x (rank + EXTRA)
   whatever the number of passages; as A'A is symmetric, G (W'G)^-1 G' gives its leading eigenvectors without a second
   pass. The space has the benchmark's directions and the corpus's at right angles to them, so that frequent terms of the
   corpus cannot push the queries out of it. What lies outside counts in a window's length only.
3. Search: windows of a document, of about an item's length and a third of it apart, against all items of that length,
   by cosine; those of `cosine` at least are candidates. An item's cosine with itself is scaled to 1, whatever share of
   it the space holds. A window of which too little weight is in the benchmark's words is not
   multiplied.
4. Exact candidates beside the cosine, which is blind to words that copies of the item have made frequent and to edits
   that add rare words: every window whose surroundings can hold `loose` of an item's words (each as often as the item
   has it). Of an item's n words, rarest first, all but t - k are looked up, t being `loose` of n and k half of it: where
   t words are held, k of those are. So no window that could pass the check is missed, whatever the weights.
5. Check: longest common subsequence of words between an item and the surroundings of a window. A document has the item
   if that is `lcs` of the item's words at least, or if it is `loose` at least and the item's answer (its last sentence)
   is there in order, as in a paraphrase that keeps the answer. For what the latent space finds `reworded` is enough in place
   of `loose`: there the words that carry the item's weight agree, though most of the others may have been replaced.

Words are lower-cased (A-Z) and split at blanks and ASCII punctuation. The benchmark is the query set, collected and
broadcast, `max_items` at most (more is an error).

Results for special cases: a document with a null, blank or clean text has no items; an item without words matches
nothing; equal items each match; equal rows get equal rows; a null doc_id comes back null, a null item_id is left out.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgcard.llm import common

TERM_BITS, DIMENSION_BITS, PASSAGE, RANK, CORPUS_RANK, EXTRA = 18, 15, 64, 128, 16, 8
COSINE, LCS, LOOSE, REWORDED, MAX_ITEMS = 0.6, 0.8, 0.6, 0.4, 100_000
TERMS, DIMENSIONS = 1 << TERM_BITS, 1 << DIMENSION_BITS
_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_PLAIN = bytes.maketrans(_PUNCTUATION, b" " * len(_PUNCTUATION))
RESULT = "key long, item_ids array<long>, n_items int, score double"


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each text's words begin."""
    w = common.Words([x.translate(_PLAIN) for x in texts], lower=True)
    return w.hashes(), w.first


def terms_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - TERM_BITS)).astype(np.int64)


def passages_of(first: np.ndarray) -> np.ndarray:
    """Place of the first word of each passage: whole texts in stretches of PASSAGE words."""
    size = np.diff(first)
    n = -(-size // PASSAGE)
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(first[:-1], n) + step * PASSAGE


def scaled(rows: np.ndarray, at: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """rows[at] * scale without a second copy."""
    out = rows.take(at, 0)
    out *= scale
    return out


def rows_sum(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts, axis=0) if len(starts) else np.zeros((0, values.shape[1]), values.dtype)


def frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Passages with each term, and passages in all."""

    @common.lean
    def count(batches):
        common.cache("decontaminate")
        total = np.zeros(TERMS + 1, np.int64)
        for batch in batches:
            texts = common.texts_of(batch.column("text"))
            for i, j in common.slices(texts):
                h, first = words_of(texts[i:j])
                starts = passages_of(first)
                passage = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(h)))
                pairs = np.sort(passage << TERM_BITS | terms_of(h))
                pairs = pairs[np.diff(pairs, prepend=-1) != 0]
                total[:TERMS] += np.bincount(pairs & (TERMS - 1), minlength=TERMS)
                total[TERMS] += len(starts)
        yield common.array_parts(total, 1)

    total = common.summed(docs.select("text").mapInArrow(count, common.PARTS), np.int64, (TERMS + 1,))
    return total[:TERMS], int(total[TERMS])


def dimensions_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - DIMENSION_BITS)).astype(np.int64)


def latent(passages: DataFrame, weights, rank: int, extra: int) -> np.ndarray:
    """DIMENSIONS x rank: orthonormal directions of the passages' space. weights: broadcast, of each term."""
    width = rank + extra

    def random():
        return np.random.RandomState(7).standard_normal((DIMENSIONS, width)).astype(np.float32)

    @common.lean
    def product(batches):
        common.cache("decontaminate")
        total, w = np.zeros((DIMENSIONS, width), np.float32), random()
        for batch in batches:
            texts = common.texts_of(batch.column("text"))
            for i, j in common.slices(texts, common.SLICE >> 2):
                h, first = words_of(texts[i:j])
                starts, d = passages_of(first), dimensions_of(h)
                if not len(d):
                    continue
                scale = weights.value[terms_of(h)][:, None]
                y = rows_sum(scaled(w, d, scale), starts)
                own = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(d)))
                order = np.argsort(d.astype(np.uint16), kind="stable")  # a radix sort
                d = d[order]
                at = np.flatnonzero(np.diff(d, prepend=-1))
                total[d[at]] += rows_sum(scaled(y, own[order], scale[order]), at)
        yield common.array_parts(total)

    g = common.summed(passages.mapInArrow(product, common.PARTS), np.float32, (DIMENSIONS, width)).astype(float)
    used = np.flatnonzero(np.abs(g).sum(1))
    g, w = g[used], random()[used].astype(float)
    # eigenvectors of A'A out of its product with the random matrix: G (W'G)^-1 G' = (G C)(G C)', C C' = (W'G)^-1
    core = w.T @ g
    value, vector = np.linalg.eigh((core + core.T) / 2)
    good = value > max(value.max(initial=0), 0) * 1e-6
    out = np.zeros((DIMENSIONS, rank), np.float32)
    if good.any():
        u, s, _ = np.linalg.svd(g @ (vector[:, good] / np.sqrt(value[good])), full_matrices=False)
        keep = min(rank, int((s > s[0] * 1e-3).sum()))
        out[used, :keep] = u[:, :keep]
    return out


def fitted(docs: DataFrame, benchmark: DataFrame, weights, rank: int, corpus_rank: int, extra: int) -> np.ndarray:
    """Latent space of the column text of both: the benchmark's directions, then those of the corpus at right angles to them."""
    own, corpus = latent(benchmark, weights, rank, extra), latent(docs, weights, corpus_rank, extra)
    for _ in range(2):
        corpus = corpus - own @ (own.T @ corpus)
    u, s, _ = np.linalg.svd(corpus, full_matrices=False)
    return np.concatenate([own, u[:, s > 1e-2]], axis=1).astype(np.float32)


def lcs_length(a: list[int], b: list[int]) -> int:
    """Longest common subsequence, one bit for each entry of a."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        hit = row & where.get(x, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


class Items:
    """Benchmark items by length of their windows, and what scores a window against them."""

    def __init__(self, ids: list[int | None], texts: list[bytes], space: np.ndarray, weights: np.ndarray, least: float):
        self.space, self.weights = space, weights
        h, first = words_of(texts)
        self.vocabulary = np.unique(h)
        self.may_know = np.zeros(TERMS, bool)
        self.may_know[terms_of(self.vocabulary)] = True
        self.words, self.answers, self.ids, groups = [], [], [], {}
        for key, text, i, j in zip(ids, texts, first[:-1].tolist(), first[1:].tolist()):
            if i == j:
                continue
            n = 8
            while n < j - i:
                n += n >> 1
            groups.setdefault(n, []).append(len(self.ids))
            tail = [x for x in text.replace(b"\n", b". ").split(b". ") if x.translate(_PLAIN).split()]
            self.words.append(h[i:j].tolist())
            self.answers.append(words_of([tail[-1]])[0].tolist() if len(tail) > 1 else self.words[-1])
            self.ids.append(key)
        self.groups = []
        for n, members in sorted(groups.items()):
            own = [np.array(self.words[m], np.uint64) for m in members]
            v = np.stack([self.vectors(x).sum(0) for x in own])
            held = np.maximum(np.einsum("ij,ij->i", v, v), 1e-30)
            length = np.array([np.sqrt((weights[terms_of(x)] ** 2).sum()) for x in own])
            self.groups.append((n, np.array(members), (v * (length / held)[:, None]).astype(np.float32), self.postings(own, least)))

    def known(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words are in the vocabulary, and the places there of those that are."""
        likely = np.flatnonzero(self.may_know[terms_of(hashes)])
        near = np.searchsorted(self.vocabulary, hashes[likely])
        found = self.vocabulary[np.minimum(near, len(self.vocabulary) - 1)] == hashes[likely] if len(self.vocabulary) else np.zeros(0, bool)
        known = np.zeros(len(hashes), bool)
        known[likely[found]] = True
        return known, near[found]

    def postings(self, own: list[np.ndarray], least: float) -> tuple[np.ndarray, ...]:
        """Where the entries of each word of the vocabulary begin; of each entry the item and how often it has the word
        among those looked up; of each item how many of those a match holds at least; and bounds (how often an item has the
        word among its rarest, how many of those a match holds): all but k - m of an item's words looked up hold m of any k."""
        rows, needed = [], []
        bounds = [(np.zeros(len(self.vocabulary), np.int64), []) for _ in range(2)]
        for m, x in enumerate(own):
            t = max(1, math.ceil(least * len(x) - 1e-9))
            k = (t + 1) // 2
            looked_up = x[np.lexsort((x, -self.weights[terms_of(x)]))][:len(x) - t + k]
            looked_up = np.searchsorted(self.vocabulary, looked_up)
            rows += [(at, m, times) for at, times in Counter(looked_up.tolist()).items()]
            needed.append(k)
            for (most, least_held), held in zip(bounds, (1, (k + 1) // 2)):
                at, times = np.unique(looked_up[:len(looked_up) - k + held], return_counts=True)
                most[at] = np.maximum(most[at], times)
                least_held.append(held)
        word, item, times = np.array(sorted(rows), np.int64).T
        bounds = [(most, min(least_held)) for most, least_held in bounds]
        return np.searchsorted(word, np.arange(len(self.vocabulary) + 1)), item, times, np.array(needed), bounds

    def vectors(self, hashes: np.ndarray) -> np.ndarray:
        return scaled(self.space, dimensions_of(hashes), self.weights[terms_of(hashes)][:, None])


def windows_of(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of windows of width words a third of it apart that cover every text; the last ends with it."""
    size, step = np.diff(first), max(1, width // 3)
    n = np.where(size > 0, 1 + -(-np.maximum(size - width, 0) // step), 0)
    own = np.repeat(np.arange(len(size)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = first[:-1][own] + np.minimum(k * step, np.maximum(size - width, 0)[own])
    return start, np.minimum(start + width, first[1:][own]), own


def candidates(h: np.ndarray, first: np.ndarray, items: Items, cosine: float):
    """(text, item, window start, window end, whether the latent space found it) of likely matches."""
    square = items.weights[terms_of(h)].astype(float) ** 2
    known, near = items.known(h)
    whole, shared = (np.concatenate([[0.0], np.cumsum(x)]) for x in (square, square * known))
    place = np.concatenate([[0], np.cumsum(known)])
    for width, members, queries, postings in items.groups:
        start, end, own = windows_of(first, width)
        length = whole[end] - whole[start]
        likely = np.flatnonzero((shared[end] - shared[start] >= (0.9 * cosine) ** 2 * length) & (place[end] > place[start]) & (length > 0))
        for i in range(0, len(likely), 1 << 12):
            part = likely[i:i + (1 << 12)]
            n = end[part] - start[part]
            v = rows_sum(items.vectors(h[spread(start[part], n)]), np.cumsum(n) - n) / np.sqrt(length[part])[:, None].astype(np.float32)
            for k in range(0, len(members), 512):
                row, item = np.nonzero(v @ queries[k:k + 512].T >= cosine)
                yield from zip(own[part][row].tolist(), members[k + item].tolist(), start[part][row].tolist(), end[part][row].tolist(), repeat(True))
        low, high = surroundings(first, start, end, own)
        for row, item in overlapping(near, place[low], place[high], postings):
            yield from zip(own[row].tolist(), members[item].tolist(), start[row].tolist(), end[row].tolist(), repeat(False))


def spread(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin[i], begin[i] + 1, ... n[i] of them, for each i in turn."""
    return np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())


def surroundings(first: np.ndarray, start: np.ndarray, end: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words around windows begin and end: half a window more on both sides, within the text."""
    around = end - start >> 1
    return np.maximum(first[own], start - around), np.minimum(first[own + 1], end + around)


def overlapping(words: np.ndarray, low: np.ndarray, high: np.ndarray, postings, most: int = 1 << 20):
    """(stretch, item) arrays: all stretches low to high of words (places in the vocabulary) that hold as many of an
    item's looked up words as a match needs; a word that the stretch has counts as often as the item has it."""
    begin, item_of, times, needed, bounds = postings
    held = [(np.concatenate([[0], np.cumsum(often[words])]), least) for often, least in bounds]
    few = np.flatnonzero(np.logical_and.reduce([total[high] - total[low] >= least for total, least in held]))
    low, high = low[few], high[few]
    fan = np.diff(begin)[words]
    place = np.concatenate([[0], np.cumsum(fan > 0)])
    words, a, b = words[fan > 0], place[low], place[high]
    fan = fan[fan > 0]
    order = np.argsort(words.astype(np.uint16) if len(begin) <= 1 << 16 else words, kind="stable")  # a radix sort
    before = np.full(len(words), -1)
    before[order[1:]] = np.where(words[order[1:]] == words[order[:-1]], order[:-1], -1)
    likely = np.flatnonzero(b - a >= needed.min())
    cost = np.concatenate([[0], np.cumsum(fan)])
    part = np.cumsum(cost[b[likely]] - cost[a[likely]] + len(needed)) // most
    for rows in np.split(likely, np.flatnonzero(np.diff(part)) + 1) if len(likely) else ():
        n = b[rows] - a[rows]
        at, row = spread(a[rows], n), np.repeat(np.arange(len(rows)), n)
        once = before[at] < a[rows][row]
        at, row = at[once], row[once]
        entry = spread(begin[words[at]], fan[at])
        total = np.bincount(np.repeat(row, fan[at]) * len(needed) + item_of[entry], times[entry], len(rows) * len(needed))
        row, item = np.nonzero(total.reshape(len(rows), -1) >= needed)
        yield few[rows[row]], item


def found_items(docs: DataFrame, benchmark: DataFrame, rank: int = RANK, corpus_rank: int = CORPUS_RANK,
                extra: int = EXTRA, cosine: float = COSINE, lcs: float = LCS, loose: float = LOOSE, reworded: float = REWORDED, max_items: int = MAX_ITEMS, id_col: str = "doc_id",
                text_col: str = "text", item_col: str = "item_id", item_text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row of docs: key, item_ids found in it, n_items, score (largest share of an item's words in common order), and
    the columns keep."""
    sc = docs.sparkSession.sparkContext
    docs = docs.select(common.id_or_last(id_col).alias("key"), F.col(text_col).cast("string").cast("binary").alias("text"),
                       *(F.col(c).alias(f"keep_{c}") for c in keep))
    rows = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text).cast("string").cast("binary").alias("t")).limit(max_items + 1).collect()
    if len(rows) > max_items:
        raise ValueError(f"more than {max_items} items; raise max_items")
    rows = sorted((r["i"] is None, r["i"] or 0, bytes(r["t"] or b"")) for r in rows)
    df, n = frequencies(docs)
    weights = (np.log((n + 1) / (df + 1)) ** 2).astype(np.float32)
    queries = benchmark.select(F.col(item_text).cast("string").cast("binary").alias("text"))
    space = fitted(docs.select("text"), queries, sc.broadcast(weights), rank, corpus_rank, extra)
    held = sc.broadcast(Items([None if none else i for none, i, _ in rows], [t for *_, t in rows], space, weights, min(lcs, loose)))
    wide = [(f.name, f.dataType.simpleString()) for f in docs.schema if f.name.startswith("keep_")]

    @common.lean
    def search(batches):
        common.cache("decontaminate")
        items = held.value
        for batch in common.small(batches):
            texts = common.texts_of(batch.column("text"))
            found: list[set[int]] = [set() for _ in texts]
            score = np.zeros(len(texts))
            for i, j in common.slices(texts, common.SLICE >> 1):
                h, first = words_of(texts[i:j])
                flat = h.tolist()
                bounds = first.tolist()
                for own, item, start, end, by_space in candidates(h, first, items, cosine):
                    if item in found[i + own]:
                        continue
                    words = items.words[item]
                    around = end - start >> 1
                    near = flat[max(bounds[own], start - around):min(bounds[own + 1], end + around)]
                    have = set(words)
                    enough = min(reworded, loose) if by_space else loose
                    if sum(x in have for x in near) < min(lcs, enough) * len(words) - 1e-9:
                        continue
                    share = lcs_length(words, near) / len(words)
                    score[i + own] = max(score[i + own], share)
                    answer = items.answers[item]
                    if share >= lcs or share >= enough and len(answer) < len(words) and lcs_length(answer, near) == len(answer):
                        found[i + own].add(item)
            ids = [sorted(items.ids[k] for k in x if items.ids[k] is not None) for x in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(ids, pa.list_(pa.int64())), pa.array([len(x) for x in found], pa.int32()),
                 pa.array(score), *(batch.column(f) for f, _ in wide)], names=["key", "item_ids", "n_items", "score", *(f for f, _ in wide)])

    out = docs.mapInArrow(search, ", ".join([RESULT, *(f"{f} {d}" for f, d in wide)]))
    return out.select("key", "item_ids", "n_items", "score", *(F.col(f"keep_{c}").alias(c) for c in keep))


def query(spark, sf_dir: str) -> DataFrame:
    out = found_items(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return out.select(common.id_or_null("key").alias("doc_id"), (F.col("n_items") > 0).alias("contaminated"), "n_items", "item_ids", "score")
