"""Token ids of every document, packed best-fit-decreasing into rows of a fixed length and written as binary.

Each document becomes its tokens and an end token. A document longer than a row is split into pieces that lose nothing.
A task packs what it has read in batches of about `batch_tokens`: longest piece first, each into the row whose free
space fits it most tightly, found by descending a segment tree over free space. Nothing is shuffled.

A packed row has `ids` (little-endian unsigned integers, 2 bytes each if the vocabulary allows, else 4, padded with the
end token to the full length, so rows stack to a matrix), `n_tokens`, and for its segments `doc_ids`, `piece_starts`
(offset of the piece in its document's tokens), `cu_seqlens` (cumulative lengths, from 0) and `resets` (where positions
start again at 0).

Results for special cases: a null or empty text is the end token alone; a null id stays null in `doc_ids`; equal rows are
packed each; empty tables give no rows. Rows are the same on a rerun with the same input splits.
"""

from __future__ import annotations

import base64
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgcard.llm import common

RANKS, LENGTH, BATCH, CACHE = "/opt/tokenizers/byte_bpe_50k.tiktoken", 2048, 1 << 22, 1 << 21
# Fixed value: the split pattern that belongs to the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ROWS = "ids binary, n_tokens int, doc_ids array<long>, piece_starts array<long>, cu_seqlens array<int>, resets array<int>"


class Encoder:
    """Token ids of texts. The split pattern never joins what stands before a blank with the blank if a visible character
    follows it, so texts are cut there and each distinct unit is tokenised once while the cache holds it."""

    def __init__(self, ranks: bytes):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks.splitlines() if x)}
        self.end, self.dtype = len(table), np.uint16 if len(table) < 1 << 16 else np.uint32
        self.encode = tiktoken.Encoding("rows", pat_str=PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.forget()

    def forget(self):
        self.known, self.begin, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.arena = np.zeros(0, self.dtype)

    def units(self, texts: list[bytes]):
        """Buffer, start and end of each unit, and the number of units before each text."""
        data = b"".join(texts)
        buf = np.frombuffer(data, np.uint8)
        at = np.cumsum([0, *map(len, texts)])
        blank = common.BLANK[buf]
        cut = np.zeros(len(buf) + 1, bool)
        if len(buf) > 2:
            before, here, after = buf[:-2], buf[1:-1], buf[2:]
            cut[1:-2] = (here == 0x20) & ~blank[2:] & ((after < 0x80) | (before < 0x80) & ~blank[:-2])
        cut[at] = True
        start = np.flatnonzero(cut[:-1])
        return data, start, np.append(start[1:], len(buf)), np.searchsorted(start, at)

    def ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, each followed by the end token, and where each text begins."""
        data, start, end, first = self.units(texts)
        if len(start):
            keys = common.span_hash(common.byte_sums(np.frombuffer(data, np.uint8)), start, end)
            distinct, sample, index = np.unique(keys, return_index=True, return_inverse=True)
            place = np.searchsorted(self.known, distinct)
            new = np.ones(len(distinct), bool)
            inside = place < len(self.known)
            new[inside] = self.known[place[inside]] != distinct[inside]
            if len(self.known) + new.sum() > CACHE:
                self.forget()
                new[:] = True
            got = [self.encode(data[a:b].decode("utf-8", "replace")) for a, b in zip(start[sample[new]].tolist(), end[sample[new]].tolist())]
            sizes = np.fromiter(map(len, got), np.int32, len(got))
            begins = len(self.arena) + np.cumsum(sizes) - sizes
            at = np.searchsorted(self.known, distinct[new])
            self.known, self.size = np.insert(self.known, at, distinct[new]), np.insert(self.size, at, sizes)
            self.begin = np.insert(self.begin, at, begins)
            self.arena = np.concatenate([self.arena, np.fromiter(chain.from_iterable(got), self.dtype, int(sizes.sum()))])
            entry = np.searchsorted(self.known, distinct)[index]
            begin, size = self.begin[entry], self.size[entry].astype(np.int64)
        else:
            begin = size = np.zeros(0, np.int64)
        total = np.concatenate([[0], np.cumsum(size)])
        own = np.repeat(np.arange(len(texts)), np.diff(first))
        out = np.full(int(total[-1]) + len(texts), self.end, self.dtype)
        at = np.repeat(total[:-1] + own, size) + (step := np.arange(total[-1]) - np.repeat(total[:-1], size))
        out[at] = self.arena[np.repeat(begin, size) + step]
        return out, total[first] + np.arange(len(texts) + 1)


class Spaces:
    """Open rows by free space, with a segment tree over 0..length that finds the least space that fits."""

    def __init__(self, length: int):
        self.leaves = 1 << length.bit_length()
        self.count, self.rows = [0] * (2 * self.leaves), [[] for _ in range(length + 1)]

    def put(self, space: int, row: int):
        self.rows[space].append(row)
        node = self.leaves + space
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(space, row) with the least space of need at least, and that row is no longer open."""
        node, count = self.leaves + need, self.count
        while not count[node]:
            while node & 1:  # a right child: the next larger spaces are beside an ancestor
                node >>= 1
            if not node:
                return None
            node += 1
            if not node & (node - 1):
                return None
        while node < self.leaves:
            node = 2 * node if count[2 * node] else 2 * node + 1
        space = node - self.leaves
        while node:
            count[node] -= 1
            node >>= 1
        return space, self.rows[space].pop()


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of indexes of pieces, each row's sizes adding up to length at most."""
    spaces, rows = Spaces(length), []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = spaces.take(sizes[i])
        if found is None:
            found = (length, len(rows))
            rows.append([])
        rows[found[1]].append(i)
        spaces.put(found[0] - sizes[i], found[1])
    return rows


def encoder(ranks: bytes) -> Encoder:
    """One for each worker and vocabulary, so that its cache lasts."""
    held, key = common.cache("packing"), hash(ranks)
    if key not in held:
        held.clear()
        held[key] = Encoder(ranks)
    return held[key]


def packed_rows(pieces: list[tuple[int | None, int, np.ndarray]], length: int, end: int, dtype) -> pa.RecordBatch:
    columns: list[list] = [[] for _ in range(6)]
    for row in best_fit_decreasing([len(x[2]) for x in pieces], length):
        own = [pieces[i] for i in row]
        ends = np.cumsum([0, *(len(x[2]) for x in own)]).tolist()
        ids = np.full(length, end, dtype)
        ids[:ends[-1]] = np.concatenate([x[2] for x in own])
        for column, value in zip(columns, (ids.astype(ids.dtype.newbyteorder("<")).tobytes(), ends[-1], [x[0] for x in own],
                                           [x[1] for x in own], ends, ends[:-1])):
            column.append(value)
    kinds = [pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
    names = [x.strip().split(" ")[0] for x in ROWS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def packed(docs: DataFrame, length: int = LENGTH, batch_tokens: int = BATCH, ranks_path: str = RANKS,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packed rows of all documents; see above. The rank file is read here and broadcast, a few MB at most."""
    with open(ranks_path, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    docs = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).cast("string").cast("binary").alias("text"))

    @common.lean
    def pack(batches):
        e = encoder(ranks.value)
        pieces, held = [], 0
        for batch in common.small(batches):
            keys, texts = batch.column("key").to_pylist(), common.texts_of(batch.column("text"))
            for i, j in common.slices(texts, common.SLICE >> 1):
                ids, begin = e.ids(texts[i:j])
                for key, a, b in zip(keys[i:j], begin.tolist(), begin[1:].tolist()):
                    pieces += [(key, at - a, ids[at:min(at + length, b)]) for at in range(a, b, length)]
                held += len(ids)
                if held >= batch_tokens:
                    yield packed_rows(pieces, length, e.end, e.dtype)
                    pieces, held = [], 0
        if pieces:
            yield packed_rows(pieces, length, e.end, e.dtype)

    return docs.mapInArrow(pack, ROWS)


def query(spark, sf_dir: str) -> DataFrame:
    return packed(common.table(spark, sf_dir, "documents"))
