"""Suffix-array dedup over bytes: distributed merge sort of suffixes that knows common prefixes.

Removed is each byte inside a string of `length` bytes that also starts in a document with a smaller id. Sorted are the
suffixes at anchors: every string of `length` bytes holds an anchor, the `gram`-byte string in it with the least hash,
chosen by its content alone, so equal strings have anchors at equal offsets (a sparse suffix array).

1. Equal texts: all but those with the least id go whole; the rest go on with the least id.
2. Distinguishing prefixes: each chunk sends the sorted hashes of its anchors' first `gram` bytes and learns which occur
   in more than one place; an anchor whose prefix occurs once distinguishes itself and is not sent.
3. Each chunk sorts its remaining suffixes (text after the anchor, then text before it), front-codes them (common prefix
   length with the one before, then the rest) and sends them by range of the order; equal contexts are sent once. Ranges
   are cut at quantiles of the texts' bytes.
4. Each range merges its runs with a loser tree that keeps, for each run, the known common prefix with the last output:
   runs that differ there are ordered without a look at the bytes, equal ones are compared behind the known prefix. It
   hands on the prefix lengths, so neighbours that share an anchor form a group, in which strings of `length` bytes that
   contain the anchor are matched exactly and get their least id.
5. Each chunk removes what is covered by strings whose least id is smaller than the document's. It gets the order of its own
   contexts back beside the answers, so that they are found and sorted once.

Results for special cases: a null text is empty; texts shorter than `length` keep everything; equal ids are not smaller
than each other; a null id counts as larger than every other and comes back null.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgcard.llm import chunks, common

LENGTH, GRAM = 50, 16
# Ranges for the root of the chunks, and contexts of whole groups that a range matches at a time.
SPREAD, CONTEXTS = 16, 1 << 14
RESULT = "key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
RUN = "range int, chunk int, prefixes binary, lengths binary, bytes binary, rights binary, least binary, most binary"
FACTS = "chunk int, kind int, range int, data binary"
FACT = np.dtype([("entry", "<u4"), ("low", "u1"), ("high", "u1"), ("least", "<i8")])
HASHES, MATCHES, ORDER = 0, 1, 2


class Anchors:
    """Anchors of a chunk's texts: place in data, first and last start of a string that has it, owner, and prefix hash."""

    def __init__(self, texts: list[bytes], length: int, gram: int):
        self.data = b"".join(texts)
        self.begin = np.cumsum([0, *map(len, texts)])
        got = [[] for _ in range(4)]
        for i, j in common.slices(texts):
            base = self.begin[i]
            buf = np.frombuffer(self.data, np.uint8)[base:self.begin[j]]
            if len(buf) < length:
                continue
            at = np.arange(len(buf) - gram + 1)
            grams = common.span_hash(common.byte_sums(buf), at, at + gram)
            place = common.anchors(grams, length - gram + 1)
            start = np.arange(len(place))
            own = np.searchsorted(self.begin[i:j + 1] - base, start, side="right") - 1
            inside = start + length <= (self.begin[i + 1:j + 1] - base)[own]
            start, place, own = start[inside], place[inside], own[inside]
            if not len(start):
                continue
            first = np.flatnonzero(np.diff(place, prepend=-1) | np.diff(own, prepend=-1))
            last = np.append(first[1:], len(start)) - 1
            for x, y in zip(got, (place[first] + base, start[first] + base, start[last] + base, grams[place[first]])):
                x.append(y)
        self.place, self.low, self.high = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in got[:3])
        self.hash = np.concatenate(got[3]) if got[3] else np.zeros(0, np.uint64)
        self.owner = np.searchsorted(self.begin, self.place, side="right") - 1


def sort_key(a: Anchors, which: np.ndarray, length: int) -> tuple[list[bytes], np.ndarray]:
    """Strings to be sorted, text from the anchor on and then that before it backwards, and the length of the first."""
    data, right = a.data, a.high[which] + length - a.place[which]
    back = data[::-1]
    n = len(data)
    return [data[p:p + r] + back[n - p:n - p + p - low]
            for p, r, low in zip(a.place[which].tolist(), right.tolist(), a.low[which].tolist())], right


def classes(strings: list[bytes], right: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order by string, the first of each class of equal contexts in it, and the least and largest id of each class."""
    order = np.array(sorted(np.argsort(right, kind="stable").tolist(), key=strings.__getitem__), np.int64)  # equal strings by right
    new = [True] + [strings[i] != strings[j] or right[i] != right[j] for i, j in zip(order[1:].tolist(), order[:-1].tolist())]
    first = np.flatnonzero(new) if len(order) else np.zeros(0, np.int64)
    ids = keys[order]
    return order, first, np.minimum.reduceat(ids, first) if len(first) else ids, np.maximum.reduceat(ids, first) if len(first) else ids


def shared_prefixes(strings: list[bytes]) -> np.ndarray:
    """Common prefix length of each string with the one before it; 0 for the first."""
    if len(strings) < 2:
        return np.zeros(len(strings), np.uint8)
    width = max(map(len, strings))
    rows = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in strings), np.uint8).reshape(-1, width)
    same = rows[1:] == rows[:-1]
    n = np.where(same.all(1), width, same.argmin(1))
    lens = np.fromiter(map(len, strings), np.int64, len(strings))
    return np.concatenate([[0], np.minimum(n, np.minimum(lens[1:], lens[:-1]))]).astype(np.uint8)


def front_coded(strings: list[bytes]) -> tuple[bytes, bytes, bytes]:
    lcp = shared_prefixes(strings)
    lens = np.fromiter(map(len, strings), np.int64, len(strings)).astype(np.uint8)
    rest = b"".join(x[n:] for x, n in zip(strings, lcp.tolist()))
    return common.pack(lcp), common.pack(lens), common.pack(np.frombuffer(rest, np.uint8))


def decoded(prefixes: bytes, lengths: bytes, rest: bytes) -> tuple[list[bytes], list[int]]:
    lcp, lens = common.unpack(prefixes, np.uint8).tolist(), common.unpack(lengths, np.uint8).tolist()
    data, at, out, last = common.unpack(rest, np.uint8).tobytes(), 0, [], b""
    for n, size in zip(lcp, lens):
        last = last[:n] + data[at:at + size - n]
        at += size - n
        out.append(last)
    return out, lcp


def differ_at(x: bytes, y: bytes, n: int) -> int:
    """Common prefix length of two strings that share their first n bytes."""
    width = 8  # most differ soon
    while (a := x[n:n + width]) == (b := y[n:n + width]) and len(a) == width:
        n, width = n + width, 32
    end = len(a) if len(a) < len(b) else len(b)
    unlike = int.from_bytes(a[:end], "big") ^ int.from_bytes(b[:end], "big")
    return n + end - (unlike.bit_length() + 7 >> 3)


class LoserTree:
    """Merges sorted runs. Each loser is kept with its common prefix length with the last string that beat it, which on
    its path is the last output; a longer known prefix wins unseen, equal ones are compared from there on."""

    def __init__(self, runs: list[tuple[list[bytes], list[int]]]):
        self.runs, self.size = runs, 1 << max(0, len(runs) - 1).bit_length()
        self.at = [0] * self.size
        self.head = [runs[i][0][0] if i < len(runs) and runs[i][0] else None for i in range(self.size)]
        self.lose = [(0, 0)] * self.size
        self.top = self._build(1)

    def _build(self, node: int) -> tuple[int, int]:
        if node >= self.size:
            return node - self.size, 0
        win, lose = self._match(*self._build(2 * node), *self._build(2 * node + 1))
        self.lose[node] = lose
        return win

    def _match(self, a: int, n: int, b: int, m: int):
        """(run, prefix) of the winner and the loser out of two runs with their prefixes with the same last string."""
        x, y = self.head[a], self.head[b]
        if y is None:
            return (a, n), (b, 0)
        if x is None:
            return (b, m), (a, 0)
        if n != m:
            return ((a, n), (b, m)) if n > m else ((b, m), (a, n))
        p = differ_at(x, y, n)
        if p == len(x) or p < len(y) and x[p] < y[p]:
            return (a, n), (b, p)
        return (b, m), (a, p)

    def __iter__(self):
        """(run, index in it, common prefix length with the string before) in order."""
        head, lose, runs, at, size = self.head, self.lose, self.runs, self.at, self.size
        run, n = self.top
        while head[run] is not None:
            yield run, at[run], n
            at[run] += 1
            strings, lcp = runs[run]
            if at[run] < len(strings):
                head[run], n = strings[at[run]], lcp[at[run]]
            else:
                head[run], n = None, 0
            node, x = (run + size) >> 1, head[run]
            while node:  # as in _match; a run that has ended has a prefix of 0
                b, m = lose[node]
                if n < m:
                    lose[node], run, n, x = (run, n), b, m, head[b]
                elif n == m and (y := head[b]) is not None:
                    if x is None:
                        lose[node], run, x = (run, 0), b, y
                    else:
                        p = differ_at(x, y, n)
                        if p == len(x) or p < len(y) and x[p] < y[p]:
                            lose[node] = (b, p)
                        else:
                            lose[node], run, x = (run, p), b, y
                node >>= 1


def class_starts(*keys: np.ndarray) -> np.ndarray:
    """Where one of the keys differs from the one before it."""
    return np.logical_or.reduce([np.concatenate([[True], key[1:] != key[:-1]]) for key in keys])


def matches(strings: list[bytes], right: np.ndarray, ids: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """For each string of length bytes in some contexts: entry, offset of its start from the context's, least id among
    equal strings at the same anchor of the group."""
    lens = np.fromiter(map(len, strings), np.int64, len(strings))
    left = lens - right
    # the text in page order: what was before the anchor, turned round again, and what follows it
    texts = [x[r:][::-1] + x[:r] for x, r in zip(strings, right.tolist())]
    begin = np.cumsum(np.append(0, lens))
    buf = np.frombuffer(b"".join(texts), np.uint8)
    n = lens - length + 1
    entry = np.repeat(np.arange(len(strings)), n)
    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = begin[entry] + offset
    one = common.span_hash(common.byte_sums(buf, 1), at, at + length)
    two = common.span_hash(common.byte_sums(buf, 2), at, at + length) ^ common.mix((left[entry] - offset).astype(np.uint64) + common.mix(group[entry].astype(np.uint64)))
    # the order of the classes does not matter: one number for both hashes is sorted, unless different pairs share one
    mixed = one + common.mix(two)
    order = np.argsort(mixed)
    new = class_starts(one[order], two[order])
    if np.count_nonzero(new) != np.count_nonzero(class_starts(mixed[order])):
        order = np.lexsort((two, one))
        new = class_starts(one[order], two[order])
    first = np.flatnonzero(new)
    least = np.empty(len(order), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(ids[entry][order], first), np.diff(first, append=len(order)))
    return entry, offset, least


def merged(t: pa.Table, gram: int, length: int) -> pa.Table:
    """One range: its runs merged, the strings of each group matched, and what each chunk needs to know sent back."""
    if not len(t):
        return chunks.arrow([], FACTS)
    at = t["range"][0].as_py()
    rows = t.to_pylist()
    if at < 0:
        return chunks.arrow([(r["chunk"], ORDER, at, r["bytes"]) for r in rows], FACTS)
    runs = [decoded(r["prefixes"], r["lengths"], r["bytes"]) for r in rows]
    order = np.array(list(LoserTree(runs)), np.int64).reshape(-1, 3)
    run, index, group = order[:, 0], order[:, 1], np.cumsum(order[:, 2] < gram)
    taken = lambda name, dtype: [common.unpack(r[name], dtype) for r in rows]
    rights, low, top = taken("rights", np.uint8), taken("least", np.int64), taken("most", np.int64)
    base = np.cumsum([0, *map(len, rights)])[run] + index
    right, ids, most = (np.concatenate(x)[base] for x in (rights, low, top))
    # a context without a neighbour that shares its anchor matters only if this chunk has it more than once
    useful = (np.bincount(group)[group] > 1) | (ids < most)
    run, index, group, right, ids, most = (x[useful] for x in (run, index, group, right, ids, most))
    if not len(run):
        return chunks.arrow([], FACTS)
    cuts = np.flatnonzero(np.diff(group, prepend=-1))
    cuts = cuts[np.flatnonzero(np.diff(cuts // CONTEXTS, prepend=-1))]
    found = []
    for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(run)]):
        strings = [runs[r][0][k] for r, k in zip(run[i:j].tolist(), index[i:j].tolist())]
        entry, offset, least = matches(strings, right[i:j].astype(np.int64), ids[i:j], group[i:j], length)
        useful = least < most[i:j][entry]
        found.append((entry[useful] + i, offset[useful], least[useful]))
    entry, offset, least = (np.concatenate(x) for x in zip(*found))
    if not len(entry):
        return chunks.arrow([], FACTS)
    new = np.flatnonzero(np.concatenate([[True], (np.diff(entry) != 0) | (np.diff(offset) != 1) | (np.diff(least) != 0)]))
    facts = np.zeros(len(new), FACT)
    facts["entry"], facts["low"], facts["least"] = index[entry[new]], offset[new], least[new]
    facts["high"] = offset[np.append(new[1:], len(entry)) - 1]
    owner = run[entry[new]]
    order = np.argsort(owner, kind="stable")
    out = []
    for k in np.unique(owner):
        own = facts[order[np.searchsorted(owner[order], k):np.searchsorted(owner[order], k, side="right")]]
        out.append((rows[k]["chunk"], MATCHES, at, common.pack(own.view(np.uint8))))
    return chunks.arrow(out, FACTS)


def texts_in_order(t: pa.Table) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Texts of a chunk, their ids, and which of them are the first of their kind.

    Spark hands a chunk over in another order each time, as blocks arrive; places in its texts are sent from one stage to a
    later one, so they count in the order of id and text."""
    texts, keys = common.texts_of(t["text"]), t["key"].to_numpy()
    order = sorted(np.argsort(keys, kind="stable").tolist(), key=lambda i: (keys[i], texts[i]))
    keys, least = keys[order], t["least"].to_numpy()[order]
    return [texts[i] for i in order], keys, np.flatnonzero(keys == least)


def ordered(answers: pa.Table) -> list[np.ndarray]:
    """What a chunk sent to itself: first byte and owner of its contexts in order, the first of each class, and its range."""
    for kind, data in zip(answers["kind"].to_pylist(), answers["data"].to_pylist()):
        if kind == ORDER:
            out, at = [], 0
            while at < len(data):
                n = int.from_bytes(data[at:at + 8], "little")
                out.append(common.unpack(data[at + 8:at + 8 + n], np.int64))
                at += 8 + n
            return out
    return [np.zeros(0, np.int64)] * 4


def splitters(docs: DataFrame, ranges: int) -> list[int]:
    """Quantiles of the six bytes in the middle of each text: where the sorted order is cut into ranges of like size."""
    middle = F.expr("substring(cast(text as binary), greatest(1, octet_length(text) div 2), 6)")
    value = F.conv(F.rpad(F.hex(middle), 12, "0"), 16, 10).cast("long")
    got = docs.agg(F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 10_000)).first()[0] if ranges > 1 else []
    return sorted(set(got or []))


def removed(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, chunk_bytes: int = common.CHUNK,
            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: key, n_bytes, n_removed, n_spans, kept_sha256 and kept, the remaining bytes concatenated."""
    docs = docs.select(common.id_or_last(id_col).alias("key"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    layout = chunks.Layout(chunks.text_size(docs), chunk_bytes, SPREAD)
    bits = min(62, layout.bits + 3)
    shift = max(0, bits - (layout.ranges - 1).bit_length())
    cuts = splitters(docs, layout.ranges)
    digest = F.sha2(F.col("text").cast("binary"), 256)
    least = docs.groupBy(digest.alias("digest")).agg(F.min("key").alias("least"))
    docs = docs.withColumn("digest", digest).join(least, "digest").select("key", "text", "least")
    held = chunks.dealt(docs, layout, "least")
    by_chunk = lambda x: x.groupBy("chunk")

    def kept_texts(t: pa.Table) -> tuple[list[bytes], np.ndarray, np.ndarray, Anchors]:
        """What texts_in_order() gives, and the anchors of the first ones."""
        texts, keys, first = texts_in_order(t)
        return texts, keys, first, Anchors([texts[i] for i in first], length, gram)

    def prefixes(t: pa.Table) -> pa.Table:
        _, _, _, a = kept_texts(t)
        values, counts = chunks.counted(a.hash >> np.uint64(64 - bits))
        return chunks.arrow(chunks.run_rows(HASHES, t["chunk"][0].as_py(), values, counts, shift), chunks.RUNS)

    def contexts(t: pa.Table, answers: pa.Table):
        texts, keys, first, a = kept_texts(t)
        cells = a.hash >> np.uint64(64 - bits)
        values = np.unique(cells)
        which = np.flatnonzero(chunks.answered(answers, HASHES, values, shift)[np.searchsorted(values, cells)])
        strings, right = sort_key(a, which, length)
        owner = keys[first][a.owner[which]] if len(which) else np.zeros(0, np.int64)
        order, begin, low, top = classes(strings, right, owner)
        heads = order[begin]
        key = np.fromiter((int.from_bytes(strings[i][:6], "big") for i in heads), np.int64, len(heads))
        return texts, keys, first, a, which, strings, right, order, begin, low, top, heads, np.searchsorted(cuts, key, side="right")

    def runs(t: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(t):
            return chunks.arrow([], RUN)
        _, _, _, a, which, strings, right, order, begin, low, top, heads, ranges = contexts(t, answers)
        at, chunk = np.flatnonzero(np.diff(ranges, prepend=-1)), t["chunk"][0].as_py()
        out = [(int(ranges[i]), chunk, *front_coded([strings[k] for k in heads[i:j]]),
                common.pack(right[heads[i:j]].astype(np.uint8)), common.pack(low[i:j]), common.pack(top[i:j]))
               for i, j in zip(at, [*at[1:], len(heads)])]
        # for the chunk itself: its contexts in order, and the classes and ranges they are in
        members = which[order]
        own = [common.pack(x.astype(np.int64)) for x in (a.low[members], a.owner[members], begin, ranges)]
        if len(members):
            out.append((-1 - chunk, chunk, b"", b"", b"".join(len(x).to_bytes(8, "little") + x for x in own), b"", b"", b""))
        return chunks.arrow(out, RUN)

    def apply(t: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(t):
            return chunks.arrow([], RESULT)
        texts, keys, first = texts_in_order(t)
        whole = b"".join(texts[i] for i in first)
        edge = np.cumsum([0, *(len(texts[i]) for i in first)])
        starts, owners, begin, ranges = ordered(answers)
        base = {int(r): int(i) for i, r in zip(np.flatnonzero(np.diff(ranges, prepend=-1)), ranges[np.diff(ranges, prepend=-1) != 0])}
        change = np.zeros(len(whole) + 1, np.int32)
        size = np.diff(begin, append=len(starts))
        for kind, r, data in zip(answers["kind"].to_pylist(), answers["range"].to_pylist(), answers["data"].to_pylist()):
            if kind != MATCHES:
                continue
            facts = common.unpack(data, np.uint8).view(FACT)
            cls = facts["entry"].astype(np.int64) + base[r]
            n = size[cls]
            member = np.repeat(begin[cls], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            fact = np.repeat(np.arange(len(facts)), n)
            hit = facts["least"][fact] < keys[first][owners[member]]
            member, fact = member[hit], fact[hit]
            np.add.at(change, starts[member] + facts["low"][fact], 1)
            np.add.at(change, starts[member] + facts["high"][fact] + length, -1)
        gone = np.cumsum(change[:-1]) > 0
        where = {int(i): k for k, i in enumerate(first)}
        buf, out = np.frombuffer(whole, np.uint8), []
        for i, (key, text) in enumerate(zip(keys.tolist(), texts)):
            if i in where:
                own = slice(edge[where[i]], edge[where[i] + 1])
                lost = gone[own]
                kept = buf[own][~lost].tobytes()
                spans = int(np.count_nonzero(np.diff(lost.astype(np.int8), prepend=0) == 1))
            else:
                kept, spans = (b"", 1) if len(text) >= length else (text, 0)
            out.append((key, len(text), len(text) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
        return chunks.arrow(out, RESULT)

    answers = by_chunk(held).applyInArrow(prefixes, chunks.RUNS).groupBy("range", "kind").applyInArrow(
        chunks.repeated, chunks.BITS)
    sent = by_chunk(held).cogroup(by_chunk(answers)).applyInArrow(runs, RUN)
    found = sent.groupBy("range").applyInArrow(lambda t: merged(t, gram, length), FACTS)
    return by_chunk(held).cogroup(by_chunk(answers.unionByName(found))).applyInArrow(apply, RESULT)


def query(spark, sf_dir: str) -> DataFrame:
    out = removed(common.table(spark, sf_dir, "documents"))
    return out.select(common.id_or_null("key").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
