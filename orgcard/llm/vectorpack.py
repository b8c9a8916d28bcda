"""Examples of instruction data packed into sequences under three limits at once: tokens, segments, loss-bearing tokens.

An example is a list of parts, each a text that bears loss (an answer) or not (a prompt). Its tokens are those of its
parts, one part after the other, and an end token, which bears loss as the last part does. Packing is vector bin packing
by the dot-product heuristic: with the demand of a piece and the free room of the open sequence both as shares of the
limits, the next piece is, of those that fit, the one with the greatest sum over the dimensions of average demand x demand
x room; of equals the longest, then the one that came first. A sequence that nothing fits any more is closed.

With `cut`, examples may be cut anywhere: the best piece that does not fit gives the sequence as much as it holds, and the
rest waits as a piece of its own. A sequence that ends short of the token limit then gives back what it has beyond a
power of two, as sequences of such lengths need no padding. Without `cut`, only what exceeds a limit by itself is cut and
sequences are padded. Either way every token lies in exactly one piece.

A task packs what it has read in batches of about `batch_tokens`, and what an unfinished sequence holds goes on to the
next batch; nothing is shuffled. Pieces that need the same are one row of the search, so a step costs as many cells as
there are different needs in a batch.

Results for special cases: a null or empty text has no tokens, a null loss flag is false, an example without parts is
the end token alone, bearing loss; a null id stays null; equal rows are packed each; empty tables give no rows; other
columns are not read. Rows are the same on a rerun with the same input splits.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgcard.llm import common

TOKENIZER, END = "byte_bpe_50k.json", 1
TOKENS, SEGMENTS, LOSS, BATCH = 2048, 256, 2048, 1 << 21
UNITS, ARENA = 1 << 21, 1 << 24  # of a worker's cache: 30 MB and 32 MB at most, but for what one slice of text adds
PIECES = ("doc_id long, start long, length long, doc_tokens long, loss_tokens long, sequence_id long, segment int, "
          "offset long, ids binary")


class Tokens:
    """Token ids of texts. The tokenizer's split never joins what stands before a blank with the blank if a visible
    character follows it, so texts are cut there and each distinct unit is tokenised once while the cache holds it."""

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.forget()

    def forget(self):
        self.known, self.begin, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.arena = np.zeros(0, self.dtype)

    def encode(self, units: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch(units, add_special_tokens=False)]

    def learn(self, keys: np.ndarray, units: list[str]):
        """Adds units, all new, by ascending keys to the cache."""
        found = self.encode(units)
        size = np.fromiter(map(len, found), np.int32, len(found))
        new = np.fromiter(chain.from_iterable(found), self.dtype, int(size.sum()))
        begin = len(self.arena) + np.cumsum(size) - size
        place = np.searchsorted(self.known, keys)
        self.known, self.size = np.insert(self.known, place, keys), np.insert(self.size, place, size)
        self.begin, self.arena = np.insert(self.begin, place, begin), np.concatenate([self.arena, new])

    def missing(self, keys: np.ndarray) -> np.ndarray:
        place = np.searchsorted(self.known, keys)
        new = np.ones(len(keys), bool)
        inside = place < len(self.known)
        new[inside] = self.known[place[inside]] != keys[inside]
        return new

    def ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text begins (one more at the end)."""
        data = b"".join(texts)
        at = np.cumsum([0, *map(len, texts)])
        if not data:
            return np.zeros(0, self.dtype), np.zeros(len(texts) + 1, np.int64)
        buf = np.frombuffer(data, np.uint8)
        cut = np.zeros(len(buf) + 1, bool)
        if len(buf) > 2:
            before, after = buf[:-2], buf[2:]
            cut[1:-2] = (buf[1:-1] == 0x20) & ~common.BLANK[after] & ((after < 0x80) | (before < 0x80) & ~common.BLANK[before])
        cut[at] = True
        start = np.flatnonzero(cut[:-1])
        end = np.append(start[1:], len(buf))
        keys = common.span_hash(common.byte_sums(buf), start, end)
        distinct, sample, index = np.unique(keys, return_index=True, return_inverse=True)
        new = self.missing(distinct)
        if new.any():
            if len(self.known) + new.sum() > UNITS or len(self.arena) > ARENA:
                self.forget()
                new[:] = True
            self.learn(distinct[new], [data[a:b].decode("utf-8", "replace") for a, b in zip(start[sample[new]].tolist(), end[sample[new]].tolist())])
        entry = np.searchsorted(self.known, distinct)[index]
        size = self.size[entry]
        total = np.concatenate([[0], np.cumsum(size)])
        out = self.arena[np.repeat(self.begin[entry] - total[:-1], size) + np.arange(total[-1])]
        return out, total[np.searchsorted(start, at)]


class Example:
    """Its id, all its token ids, and the number of loss-bearing ones before each place (None: all bear loss)."""

    __slots__ = ("key", "ids", "loss")

    def __init__(self, key: int | None, ids: np.ndarray, loss: np.ndarray | None):
        self.key, self.ids, self.loss = key, ids, loss

    def lost(self, a: int, b: int) -> int:
        return b - a if self.loss is None else int(self.loss[b] - self.loss[a])

    def reach(self, a: int, b: int, tokens: int, loss: int) -> int:
        """The greatest end of a piece from a that has at most so many tokens and loss-bearing tokens."""
        if self.loss is None:
            return min(b, a + min(tokens, loss))
        return min(b, a + tokens, int(np.searchsorted(self.loss, self.loss[a] + loss, "right")) - 1)


Piece = tuple[Example, int, int]


class Pool:
    """Waiting pieces by what they need, as (tokens, loss)."""

    def __init__(self):
        self.place: dict[tuple[int, int], int] = {}
        self.need, self.count, self.pieces, self.left = np.zeros((2, 64)), np.zeros(64, np.int64), [], 0

    def put(self, piece: Piece):
        e, a, b = piece
        need = (b - a, e.lost(a, b))
        at = self.place.get(need)
        if at is None:
            at = self.place[need] = len(self.pieces)
            if at == len(self.count):
                self.need, self.count = np.concatenate([self.need] * 2, axis=1), np.concatenate([self.count, np.zeros_like(self.count)])
            self.need[:, at] = need
            self.pieces.append([])
        self.pieces[at].append(piece)
        self.count[at] += 1
        self.left += 1

    def take(self, at: int) -> Piece:
        self.count[at] -= 1
        self.left -= 1
        return self.pieces[at].pop(0 if len(self.pieces[at]) < 64 else -1)

    def best(self, pull: np.ndarray, room: tuple[float, float]) -> int | None:
        """Row of the waiting piece within the room with the greatest dot product."""
        n = len(self.pieces)
        need = self.need[:, :n]
        fits = (self.count[:n] > 0) & (need[0] <= room[0]) & (need[1] <= room[1])
        if not fits.any():
            return None
        score = np.where(fits, pull @ need, -1.0)
        at = int(score.argmax())
        ties = np.flatnonzero(score == score[at])
        return at if len(ties) == 1 else int(ties[need[0, ties].argmax()])


class Packer:
    """Sequences out of the examples that are given to it, batch by batch."""

    def __init__(self, tokens: int, segments: int, loss: int, cut: bool):
        self.tokens, self.segments, self.loss, self.cut = tokens, segments, loss, cut
        self.held: list[Piece] = []

    def pieces(self, e: Example):
        """An example whole, or in as few pieces as the limits allow."""
        a, n = 0, len(e.ids)
        while a < n:
            b = e.reach(a, n, self.tokens, self.loss)
            yield e, a, b
            a = b

    def sequences(self, examples: list[Example], last: bool):
        """Closed sequences as lists of pieces; unless these are the last examples, an unfinished one is held back."""
        pool = Pool()
        for piece in self.held:
            pool.put(piece)
        for e in examples:
            for piece in self.pieces(e):
                pool.put(piece)
        self.held = []
        if not pool.left:
            return
        n = len(pool.pieces)
        average = (pool.need[:, :n] * pool.count[:n]).sum(axis=1) / pool.left
        while pool.left:
            row, room = self.fill(pool, average)
            if not pool.left and not last and room[0] and len(row) < self.segments:
                self.held = row
                return
            yield self.trimmed(row, pool)

    def fill(self, pool: Pool, average: np.ndarray) -> tuple[list[Piece], tuple[int, int]]:
        """A sequence and the room that is left in it."""
        row: list[Piece] = []
        room = (self.tokens, self.loss)
        limit = np.array(room, float)
        while pool.left and room[0] and len(row) < self.segments:
            # Every piece is one segment, so that dimension adds the same to all scores.
            pull = average * np.array(room) / limit**3
            at = pool.best(pull, room)
            if at is None:
                if not self.cut or (at := pool.best(pull, (np.inf, np.inf))) is None:
                    break
                e, a, b = pool.take(at)
                middle = e.reach(a, b, *room)
                if middle == a:
                    pool.put((e, a, b))
                    break
                pool.put((e, middle, b))
                piece = (e, a, middle)
            else:
                piece = pool.take(at)
            row.append(piece)
            e, a, b = piece
            room = (room[0] - (b - a), room[1] - e.lost(a, b))
        return row, room

    def trimmed(self, row: list[Piece], pool: Pool) -> list[Piece]:
        """The sequence without what it has beyond a power of two, which goes back to the pool."""
        used = sum(b - a for _, a, b in row)
        beyond = used - (1 << used.bit_length() - 1) if self.cut and used < self.tokens else 0
        while beyond:
            e, a, b = row.pop()
            middle = max(a, b - beyond)
            beyond -= b - middle
            if middle > a:
                row.append((e, a, middle))
            pool.put((e, middle, b))
        return row


def batch_of(rows: list[list[Piece]], first: int) -> pa.RecordBatch:
    """Pieces of some sequences, numbered from first on."""
    columns: list[list] = [[] for _ in range(9)]
    for i, row in enumerate(rows):
        offset = 0
        for k, (e, a, b) in enumerate(row):
            values = (e.key, a, b - a, len(e.ids), e.lost(a, b), first + i, k, offset, e.ids[a:b].astype("<u4").tobytes())
            for column, value in zip(columns, values):
                column.append(value)
            offset += b - a
    kinds = [pa.int64()] * 6 + [pa.int32(), pa.int64(), pa.binary()]
    names = [x.split(" ")[0] for x in PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def tokens_of(definition: str) -> Tokens:
    """One for each worker and tokenizer, so that its cache lasts."""
    held, key = common.cache("vectorpack"), hash(definition)
    if key not in held:
        held.clear()
        held[key] = Tokens(definition)
    return held[key]


def read_examples(t: Tokens, batch: pa.RecordBatch, end: int):
    """Lists of the examples of a batch, about a slice of text at a time."""
    keys = batch.column("key").to_pylist()
    parts, flags = batch.column("texts"), batch.column("flags")
    counts = np.array([x or 0 for x in parts.value_lengths().to_pylist()], np.int64)
    texts, bears = common.texts_of(parts.flatten()), np.array([bool(x) for x in flags.flatten().to_pylist()], bool)
    first = np.concatenate([[0], np.cumsum(counts)])
    weight = [b"" if a == b else texts[a] if b == a + 1 else b"".join(texts[a:b]) for a, b in zip(first.tolist(), first[1:].tolist())]
    for i, j in common.slices(weight, 2 * common.SLICE):
        a, b = int(first[i]), int(first[j])
        ids, begin = t.ids(texts[a:b])
        out = []
        for k in range(i, j):
            lo, hi = int(first[k]) - a, int(first[k + 1]) - a
            own = np.append(ids[begin[lo]:begin[hi]], t.dtype(end))
            mine = bears[a + lo:a + hi]
            loss = None
            if not mine.all():
                each = np.append(np.repeat(mine, np.diff(begin[lo:hi + 1])), mine[-1])
                loss = np.concatenate([[0], np.cumsum(each)])
            out.append(Example(keys[k], own, loss))
        yield out


def packed(examples: DataFrame, definition: str, id_col: str = "doc_id", parts: Column | None = None, tokens: int = TOKENS,
           segments: int = SEGMENTS, loss: int = LOSS, cut: bool = True, end: int = END, batch_tokens: int = BATCH) -> DataFrame:
    """PIECES of all examples. `definition` is a tokenizer's JSON, a few MB, and is broadcast; `parts` is an array of
    structs (text, loss), by default the column text, bearing loss. A piece has its first token's place in its example
    (start), its example's tokens (doc_tokens), its sequence, and its place there (segment, and offset in tokens)."""
    if min(tokens, segments, loss) < 1:
        raise ValueError("limits are at least 1")
    shared = examples.sparkSession.sparkContext.broadcast(definition)
    parts = F.array(F.struct(F.col("text").alias("text"), F.lit(True).alias("loss"))) if parts is None else parts
    examples = examples.select(F.col(id_col).cast("long").alias("key"), F.coalesce(parts, F.array().cast("array<struct<text:string,loss:boolean>>")).alias("parts"))
    examples = examples.select("key", F.transform("parts", lambda x: x["text"].cast("string").cast("binary")).alias("texts"),
                               F.transform("parts", lambda x: F.coalesce(x["loss"], F.lit(False))).alias("flags"))

    def pack(batches):
        t, packer = tokens_of(shared.value), Packer(tokens, segments, loss, cut)
        number = TaskContext.get().partitionId() << 33
        waiting, held = [], 0

        def closed(last: bool):
            nonlocal number
            rows = list(packer.sequences(waiting, last))
            number += len(rows)
            return batch_of(rows, number - len(rows))

        for batch in common.small(batches):
            for some in read_examples(t, batch, end):
                waiting += some
                held += sum(len(x.ids) for x in some)
                if held >= batch_tokens:
                    yield closed(False)
                    waiting, held = [], 0
        yield closed(True)

    return examples.mapInArrow(pack, PIECES)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path(TOKENIZER), encoding="utf-8") as f:
        definition = f.read()
    out = packed(common.table(spark, sf_dir, "documents"), definition)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "segment", "loss_tokens")
