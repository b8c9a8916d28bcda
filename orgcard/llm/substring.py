"""Substring dedup over words: count-min prefilter, then exact grouping of the windows it estimates repeated.

A window is `width` consecutive words of one document. Its anchor is the `gram`-word sequence inside it with the least
hash, a function of the window's words alone. Whatever repeats a window repeats its anchor, so the count of the anchor,
and still more its count-min estimate, never falls short of the window's: a window whose anchor is estimated once is
unique, and no repeated window is lost. Anchors are some 14 times fewer than windows.

1. Each chunk of documents counts its anchors in `depth` sketch rows and sends the cells it touched; the partition
   sketches are merged range by range and each chunk learns which of its cells hold more than one.
2. Windows whose anchor has such a cell in every row are sent as 128-bit hashes and grouped exactly.
3. Each chunk removes the words that a repeated window covers.

Every count covers all documents. The sketch grows with the bytes of text, so the share of needless candidates does not.

Results for special cases: a null or blank text has no words and the digest of the empty string; documents shorter than
a window keep everything; equal rows (same id or not) repeat each other; a null id comes back null.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgcard.llm import chunks, common

WIDTH, GRAM, DEPTH = 35, 8, 2
RESULT = "key long, n_words long, n_removed long, kept_sha256 string, kept binary"
WINDOWS = 100  # kind of the runs that hold windows; kinds below it are sketch rows


class Windows:
    """Windows of a chunk: place of the first word, place and hash of the anchor; prefix sums of the words' hashes."""

    def __init__(self, texts: list[bytes], width: int, gram: int):
        self.texts, self.parts, base = texts, [], 0
        firsts = [np.zeros(1, np.int64)]
        starts, places, grams = [], [], []
        for i, j in common.slices(texts):
            w = common.Words(texts[i:j])
            h = w.hashes()
            if len(h) >= width:
                sums = common.sums_of(h)
                at = np.arange(len(h) - gram + 1)
                g = common.span_hash(sums, at, at + gram)
                place = common.anchors(g, width - gram + 1)
                begin = np.arange(len(place))
                own = w.text_of()
                inside = own[begin] == own[begin + width - 1]
                starts.append(begin[inside] + base)
                places.append(place[inside] + base)
                grams.append(g[place[inside]])
                self.parts.append((base, sums))
            firsts.append(w.first[1:] + base)
            base += len(h)
        self.first = np.concatenate(firsts)
        self.start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        self.place = np.concatenate(places) if starts else np.zeros(0, np.int64)
        self.anchor = np.concatenate(grams) if grams else np.zeros(0, np.uint64)

    def hashes(self, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of the windows that begin at the sorted places start."""
        out = [np.zeros(len(start), np.uint64), np.zeros(len(start), np.uint64)]
        for (base, sums), after in zip(self.parts, [*(b for b, _ in self.parts[1:]), 1 << 62]):
            i, j = np.searchsorted(start, [base, after])
            at = start[i:j] - base
            up, down = common.powers(len(sums))
            out[0][i:j] = common.span_hash(sums, at, at + width)
            half = at + width // 2
            left = (sums[half] - sums[at]) * down[at]
            right = (sums[at + width] - sums[half]) * down[half]
            out[1][i:j] = common.mix(common.mix(left) + np.uint64(3) * common.mix(right ^ np.uint64(width)))
        return tuple(out)


def cells(anchor: np.ndarray, row: int, bits: int) -> np.ndarray:
    return common.mix(anchor + common.seeded(row + 1, 7)[row]) >> np.uint64(64 - bits)


def removed(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, depth: int = DEPTH,
            chunk_bytes: int = common.CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: key, n_words, n_removed, kept_sha256 and kept, the remaining words joined by a space."""
    docs = docs.select(common.id_or_last(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    layout = chunks.Layout(chunks.text_size(docs), chunk_bytes)
    bits = layout.bits
    shift = max(0, bits - (layout.ranges - 1).bit_length())
    wide = 64 - (layout.ranges - 1).bit_length() if layout.ranges > 1 else 63
    held = chunks.dealt(docs, layout)

    def sketch(t: pa.Table) -> pa.Table:
        w, chunk = Windows(common.texts_of(t["text"]), width, gram), t["chunk"][0].as_py()
        places = w.anchor[np.unique(w.place, return_index=True)[1]]
        rows = []
        for row in range(depth):
            values, counts = chunks.counted(cells(places, row, bits))
            rows += chunks.run_rows(row, chunk, values, counts, shift)
        return chunks.arrow(rows, chunks.RUNS)

    def candidates(w: Windows, answers: pa.Table) -> np.ndarray:
        grams, index = np.unique(w.anchor, return_inverse=True)
        often = np.ones(len(grams), bool)
        for row in range(depth):
            c = cells(grams, row, bits)
            values = np.unique(c)
            often &= chunks.answered(answers, row, values, shift)[np.searchsorted(values, c)]
        return w.start[often[index]]

    def windows(t: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(t):
            return chunks.arrow([], chunks.RUNS + ", more binary")
        w = Windows(common.texts_of(t["text"]), width, gram)
        one, two = w.hashes(candidates(w, answers), width)
        order, first, counts = grouped(one, two)
        keys, more = one[order[first]], two[order[first]]
        ranges = (keys >> np.uint64(wide)).astype(np.int64)
        at = np.flatnonzero(np.diff(ranges, prepend=-1))
        return chunks.arrow([(int(ranges[i]), WINDOWS, t["chunk"][0].as_py(), common.pack_sorted(keys[i:j]),
                              common.pack(counts[i:j]), common.pack(more[i:j]))
                             for i, j in zip(at, [*at[1:], len(keys)])], chunks.RUNS + ", more binary")

    def apply(t: pa.Table, answers: pa.Table) -> pa.Table:
        texts = common.texts_of(t["text"])
        if not texts:
            return chunks.arrow([], RESULT)
        w = Windows(texts, width, gram)
        start = candidates(w, answers)
        one, two = w.hashes(start, width)
        order, first, _ = grouped(one, two)
        got = chunks.answered(answers, WINDOWS, one[order[first]], wide)
        hit = np.zeros(len(start), bool)
        hit[order] = np.repeat(got, np.diff(first, append=len(order)))
        change = np.zeros(w.first[-1] + 1, np.int32)
        np.add.at(change, start[hit], 1)
        np.add.at(change, start[hit] + width, -1)
        gone = np.cumsum(change[:-1]) > 0
        out = []
        for key, text, i, j in zip(t["key"].to_pylist(), texts, w.first[:-1], w.first[1:]):
            words, lost = text.split(), gone[i:j]
            n = int(lost.sum())
            kept = b" ".join(words if not n else [x for x, off in zip(words, lost.tolist()) if not off])
            out.append((key, len(words), n, hashlib.sha256(kept).hexdigest(), kept))
        return chunks.arrow(out, RESULT)

    answers = held.groupBy("chunk").applyInArrow(sketch, chunks.RUNS).groupBy("range", "kind").applyInArrow(
        chunks.repeated, chunks.BITS)
    by_chunk = lambda x: x.groupBy("chunk")
    found = by_chunk(held).cogroup(by_chunk(answers)).applyInArrow(windows, chunks.RUNS + ", more binary")
    found = found.groupBy("range").applyInArrow(same_windows, chunks.BITS)
    return by_chunk(held).cogroup(by_chunk(answers.unionByName(found))).applyInArrow(apply, RESULT)


def grouped(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the windows by hash, where each distinct one begins in it, and its count, 2 at most."""
    order = np.lexsort((two, one))
    a, b = one[order], two[order]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
    return order, first, np.minimum(np.diff(first, append=len(a)), 2).astype(np.uint8)


def same_windows(runs: pa.Table) -> pa.Table:
    """chunks.repeated() on 128-bit values."""
    if not len(runs):
        return chunks.arrow([], chunks.BITS)
    at = runs["range"][0].as_py()
    ones = [common.unpack_sorted(x.as_py()) for x in runs["data"]]
    one, two = np.concatenate(ones), np.concatenate([common.unpack(x.as_py(), np.uint64) for x in runs["more"]])
    counts = np.concatenate([common.unpack(x.as_py(), np.uint8) for x in runs["counts"]])
    order, first, _ = grouped(one, two)
    total = np.add.reduceat(counts[order].astype(np.int64), first)
    often = np.zeros(len(one), bool)
    often[order] = np.repeat(total > 1, np.diff(first, append=len(order)))
    out, i = [], 0
    for chunk, x in zip(runs["chunk"].to_pylist(), ones):
        out.append((chunk, WINDOWS, at, np.packbits(often[i:i + len(x)]).tobytes()))
        i += len(x)
    return chunks.arrow(out, chunks.BITS)


def query(spark, sf_dir: str) -> DataFrame:
    out = removed(common.table(spark, sf_dir, "documents"))
    return out.select(common.id_or_null("key").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(text, '[^\x20\x09-\x0D]+') END AS w
  FROM documents),
s AS (SELECT r, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
h AS (SELECT s.r, s.i, array_to_string(d.w[s.i:s.i + 34], ' ') AS k FROM s JOIN d USING (r)),
c AS (SELECT k FROM h GROUP BY k HAVING count(*) > 1),
g AS (SELECT DISTINCT h.r, h.i + o.j AS i FROM h JOIN c USING (k), (SELECT unnest(range(35)) AS j) o),
e AS (SELECT r, list(i) AS gone, count(*) AS n FROM g GROUP BY r),
k AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed,
         CASE WHEN n IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda x: NOT list_contains(gone, x)), lambda x: w[x]) END AS kept
  FROM d LEFT JOIN e USING (r))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256
FROM k
"""
