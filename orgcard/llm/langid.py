"""Language ID by unigram pieces, summed over all segmentations.

Each language has a probability for every piece of one fixed public vocabulary (byte pieces make every text
segmentable). The probability of a word is the sum over all its segmentations, by the forward algorithm; words are
independent, so a text's log-probability is the sum over its words, and each distinct word of a batch is scored once for
all languages together. Prediction and score are the arg-max and the posterior under equal priors.

Learning is expectation-maximisation over all segmentations, on at most `docs_a_language` labelled documents of each
language, chosen by a hash of the id; at most `max_languages` languages (more is an error). Everything else covers all
documents and whole texts. Words longer than `SEGMENT` bytes are scored in stretches of that length.

Results for special cases: `und` with score 0 where the text is null, has no letter, or nothing was learned; equal rows
get equal rows; a null lang is not learned from; ties go to the first language by name; a null id is held out or not by
the crc32 of the empty string and comes back null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orgcard.llm import common

MODEL, DOCS, MAX_LANGUAGES, SEGMENT, ROUNDS, SMOOTH = "/opt/tokenizers/piece_bpe_32k.model", 400, 1000, 32, 3, 0.1
KNOWN = 1 << 20
AT_A_TIME = 1 << 14  # words whose segmentations are held at a time


def pieces_of(path: str) -> list[bytes]:
    """The vocabulary as byte strings, a leading blank marking a word's begin, together with all single bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {bytes([i]) for i in range(256)}
    for i in range(model.vocab_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            data = model.id_to_piece(i).replace("▁", " ").encode()
            if b" " not in data[1:] and len(data) <= SEGMENT:
                found.add(data)
    return sorted(found)


class Trie:
    """Transitions of the pieces' prefixes, and the piece that ends at each node or -1."""

    def __init__(self, pieces: list[bytes]):
        table: list[dict[int, int]] = [{}]
        ends = {}
        for k, piece in enumerate(pieces):
            node = 0
            for c in piece:
                if c not in table[node]:
                    table[node][c] = len(table)
                    table.append({})
                node = table[node][c]
            ends[node] = k
        self.next = np.zeros((len(table), 256), np.int32)
        for node, moves in enumerate(table):
            for c, to in moves.items():
                self.next[node, c] = to
        self.piece = np.full(len(table), -1, np.int32)
        for node, k in ends.items():
            self.piece[node] = k
        self.longest = max(map(len, pieces))


class Lattice:
    """Edges (from, to, piece) between the byte boundaries of words, ordered so that sums run from left to right."""

    def __init__(self, trie: Trie, words: list[bytes]):
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.begin = np.cumsum(sizes + 1) - sizes - 1  # boundary before each word's first byte
        buf = np.frombuffer(b"".join(x + b"\0" for x in words), np.uint8)
        self.size, self.last = len(buf), self.begin + sizes
        stop = np.repeat(self.last, sizes + 1)
        offset = np.arange(len(buf)) - np.repeat(self.begin, sizes + 1)
        at = np.flatnonzero(np.arange(len(buf)) < stop)
        node, start, edges, n = np.zeros(len(at), np.int32), at, [], 0
        while len(at) and n < trie.longest:
            node = trie.next[node, buf[at]]
            n += 1
            live = node > 0
            node, start = node[live], start[live]
            at = start + n
            whole = trie.piece[node] >= 0
            edges.append((start[whole], at[whole], trie.piece[node[whole]]))
            more = at < stop[start]
            node, start, at = node[more], start[more], at[more]
        self.source, self.target, self.piece = (np.concatenate(x) for x in zip(*edges)) if edges else (np.zeros(0, np.int64),) * 3
        self.offset = offset

    def _steps(self, ends: np.ndarray):
        """Edge indexes in groups of equal offset of one end, and within a group by that end."""
        order = np.lexsort((ends, self.offset[ends]))
        depth = self.offset[ends[order]]
        at = np.flatnonzero(np.diff(depth, prepend=-1))
        return [order[i:j] for i, j in zip(at, [*at[1:], len(order)])]

    def _sums(self, p: np.ndarray, origin: np.ndarray, source: np.ndarray, target: np.ndarray, steps) -> np.ndarray:
        out = np.zeros((self.size, p.shape[1]))
        out[origin] = 1.0
        for e in steps:
            to = target[e]
            first = np.flatnonzero(np.diff(to, prepend=-1))
            out[to[first]] = np.add.reduceat(out[source[e]] * p[self.piece[e]], first, axis=0)
        return out

    def forward(self, p: np.ndarray) -> np.ndarray:
        """Sum over all segmentations up to each boundary, for each column of p."""
        return self._sums(p, self.begin, self.source, self.target, self._steps(self.target))

    def backward(self, p: np.ndarray) -> np.ndarray:
        return self._sums(p, self.last, self.target, self.source, self._steps(self.source)[::-1])

    def expected(self, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece over all segmentations of the words, counts times each; one column."""
        ahead, behind = self.forward(p[:, None])[:, 0], self.backward(p[:, None])[:, 0]
        weight = np.repeat(counts / ahead[self.last], self.last - self.begin + 1)
        use = ahead[self.source] * p[self.piece] * behind[self.target] * weight[self.source]
        return np.bincount(self.piece, weights=use, minlength=len(p))


def stretches(w: common.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words cut to SEGMENT - 1 bytes: start, end, whether a word begins here, and the text of each."""
    size = w.end - w.start
    own = w.text_of()
    n = -(-size // (SEGMENT - 1))
    if n.max(initial=0) <= 1:
        return w.start, w.end, np.ones(len(size), bool), own
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = np.repeat(w.start, n) + step * (SEGMENT - 1)
    return start, np.minimum(start + SEGMENT - 1, np.repeat(w.end, n)), step == 0, np.repeat(own, n)


def learned(texts: list[bytes], trie: Trie, n_pieces: int, rounds: int = ROUNDS, smooth: float = SMOOTH) -> np.ndarray:
    """Piece probabilities of one language."""
    seen: dict[bytes, int] = {}
    for text in texts:
        w = common.Words([text])
        data = w.buf.tobytes()
        for a, b, first in zip(*(x.tolist() for x in stretches(w)[:3])):
            word = b" " + data[a:b] if first else data[a:b]
            seen[word] = seen.get(word, 0) + 1
    p = np.full(n_pieces, 1 / n_pieces)
    if seen:
        lattice, counts = Lattice(trie, list(seen)), np.array(list(seen.values()), float)
        for _ in range(rounds):
            used = lattice.expected(p, counts) + smooth
            p = used / used.sum()
    return p


def trie_of(pieces: list[bytes]) -> Trie:
    held = common.cache("langid")
    if held.get("pieces") is not pieces:
        held.clear()
        held["pieces"], held["trie"] = pieces, Trie(pieces)
    return held["trie"]


def sampled(docs: DataFrame, docs_a_language: int) -> DataFrame:
    """(lang, text) of so many rows of each language at most. Equal rows are one; rows that share an id or have none are told
    apart by their texts."""
    docs = docs.select("lang", "key", F.xxhash64("text").alias("mark"), "text")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("key"), "key", "mark"))
    rows = ["lang", "key", "mark"]
    chosen = docs.select(*rows).distinct().withColumn("rank", rank).where(F.col("rank") <= docs_a_language).select(*rows)
    return docs.join(F.broadcast(chosen), rows).groupBy(*rows).agg(F.any_value("text").alias("text")).select("lang", F.col("text").cast("binary").alias("text"))


def fit(docs: DataFrame, pieces, rounds: int = ROUNDS, docs_a_language: int = DOCS, max_languages: int = MAX_LANGUAGES):
    """(languages, probabilities by piece and language) from docs (key, text, lang), all labelled."""
    sample = sampled(docs, docs_a_language)

    def one(t: pa.Table) -> pa.Table:
        held = pieces.value
        p = learned(common.texts_of(t["text"]), trie_of(held), len(held), rounds)
        return pa.table({"lang": pa.array([t["lang"][0].as_py()]), "p": pa.array([p.tobytes()], pa.binary())})

    rows = sample.groupBy("lang").applyInArrow(one, "lang string, p binary").limit(max_languages + 1).collect()
    if len(rows) > max_languages:
        raise ValueError(f"more than {max_languages} languages; raise max_languages")
    rows = sorted((r["lang"], r["p"]) for r in rows)
    return [x for x, _ in rows], np.stack([np.frombuffer(bytes(p)) for _, p in rows], axis=1) if rows else np.zeros((len(pieces.value), 0))


class Scorer:
    """Log-probabilities of texts, languages by column; distinct words are scored once while the cache holds them."""

    def __init__(self, trie: Trie, p: np.ndarray):
        self.trie, self.p = trie, p
        self.known, self.value = np.zeros(0, np.uint64), np.zeros((0, p.shape[1]), np.float32)

    def score(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros((len(texts), self.p.shape[1]))
        w = common.Words(texts)
        start, end, begins, own = stretches(w)
        if not len(start):
            return out
        keys = common.span_hash(common.byte_sums(w.buf), start, end) ^ np.where(begins, np.uint64(0), np.uint64(0xABCDEF12345))
        distinct, sample, index = np.unique(keys, return_index=True, return_inverse=True)
        value = np.zeros((len(distinct), self.p.shape[1]), np.float32)
        place = np.minimum(np.searchsorted(self.known, distinct), max(0, len(self.known) - 1))
        have = self.known[place] == distinct if len(self.known) else np.zeros(len(distinct), bool)
        value[have] = self.value[place[have]]
        new, data = np.flatnonzero(~have), w.buf.tobytes()
        for i in range(0, len(new), AT_A_TIME):
            at = sample[new[i:i + AT_A_TIME]]
            words = [b" " + data[a:b] if f else data[a:b] for a, b, f in zip(start[at].tolist(), end[at].tolist(), begins[at].tolist())]
            lattice = Lattice(self.trie, words)
            value[new[i:i + AT_A_TIME]] = np.log(lattice.forward(self.p)[lattice.last])
        if len(self.known) + len(new) > KNOWN:
            self.known, self.value = distinct, value
        else:
            at = np.searchsorted(self.known, distinct[new])
            self.known, self.value = np.insert(self.known, at, distinct[new]), np.insert(self.value, at, value[new], axis=0)
        for k in range(out.shape[1]):
            out[:, k] = np.bincount(own, weights=value[index, k], minlength=len(texts))
        return out


def identified(docs: DataFrame, model_path: str = MODEL, docs_a_language: int = DOCS, rounds: int = ROUNDS,
               max_languages: int = MAX_LANGUAGES, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
               keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: key, held_out, lang_pred, score, and the columns keep. Vocabulary and probabilities are broadcast: pieces
    times languages, whatever the number of documents."""
    sc = docs.sparkSession.sparkContext
    text = F.col(text_col).cast("string")
    crc = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    docs = docs.select(common.id_or_last(id_col).alias("key"), (crc % 4 == 2).alias("held_out"), text.alias("text"),
                       F.col(lang_col).cast("string").alias("lang"), *(F.col(c).alias(f"keep_{c}") for c in keep))
    pieces = sc.broadcast(pieces_of(model_path))
    names, p = fit(docs.where(~F.col("held_out") & F.col("lang").isNotNull() & F.col("text").isNotNull()), pieces,
                   rounds, docs_a_language, max_languages)
    model = sc.broadcast((names, p))
    wide = [(f.name, f.dataType.simpleString()) for f in docs.schema if f.name.startswith("keep_")]
    seen = docs.select("key", "held_out", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"),
                       F.col("text").cast("binary").alias("text"), *(f for f, _ in wide))

    @common.lean
    def predict(batches):
        names, p = model.value
        trie, held = trie_of(pieces.value), common.cache("langid")
        if held.get("model") is not p:
            held["model"], held["scorer"] = p, Scorer(trie, p)
        scorer = held["scorer"]
        for batch in common.small(batches):
            texts = common.texts_of(batch.column("text"))
            letters = batch.column("letters").to_numpy(zero_copy_only=False)
            best, score = np.zeros(len(texts), np.int64), np.zeros(len(texts))
            if names:
                for i, j in common.slices(texts, common.SLICE >> 1):
                    logs = scorer.score(texts[i:j])
                    best[i:j] = logs.argmax(1)
                    score[i:j] = 1 / np.exp(logs - logs.max(1, keepdims=True)).sum(1)
            sure = letters & bool(names)
            out = [batch.column("key"), batch.column("held_out"),
                   pa.array([names[b] if s else "und" for b, s in zip(best.tolist(), sure.tolist())], pa.string()),
                   pa.array(np.where(sure, score, 0.0)), *(batch.column(f) for f, _ in wide)]
            yield pa.RecordBatch.from_arrays(out, names=["key", "held_out", "lang_pred", "score", *(f for f, _ in wide)])

    out = seen.mapInArrow(predict, ", ".join(["key long, held_out boolean, lang_pred string, score double", *(f"{f} {d}" for f, d in wide)]))
    return out.select("key", "held_out", "lang_pred", "score", *(F.col(f"keep_{c}").alias(c) for c in keep))


def query(spark, sf_dir: str) -> DataFrame:
    out = identified(common.table(spark, sf_dir, "documents"))
    return out.select(common.id_or_null("key").alias("doc_id"), "held_out", "lang_pred", "score")
