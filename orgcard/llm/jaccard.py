"""N-gram Jaccard join: size-aware, with fixed-size subsets for small sets and inverted lists for large ones.

A document's set is its distinct shingles of `gram` words. Two sets link when 100 * intersection >= percent * union;
a link needs at least a(n) = ceil(percent * n / 100) common shingles, n being the size of either set.

All shingles have one global order, rare ones first: by the count of the shingle's cell in a sketch of all documents,
then by hash. Any order gives all links; a good one keeps what many documents share out of the keys.

* Small sets, n <= boundary: of the first n - a(n) + 2 shingles every subset of two is a key. Two linked sets have two
  common shingles among these (or one, where one is all that they need), so they share a key.
* Large sets, n > boundary: the first n - a(n) + 1 shingles are inverted lists that it scans; any linked set, small ones
  of fitting size included, stands in one of them. Lists without a large set make no pairs.
* The boundary has the least cost under the measured sizes: subsets of the small sets against entries of the lists times
  `scan`, the entries that a list is taken to make its reader look at.

Equal sets are one class with the least id, whatever their number. What shares a key is a candidate only if the bounds
allow a link: sizes, the key's places in both orders, the shorter head that the smaller set needs, and the most common
shingles that 16-bit marks of both heads admit. In a first round each key compares its sets with one pivot only; those that
became connected need no further comparison. What is then still in different components under a common key is taken pair
by pair, large keys in blocks, so components are exact. Pairs come out of a task only after the bounds. Verification takes
the whole texts and compares exact sets.

Results for special cases: a null or blank text has no set, links with nothing and is its own component; shorter texts
are one shingle; equal rows link; rows that share an id are one vertex; rows without an id are a vertex for each text,
larger than every id, and come back null. Ids are below NAMELESS.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgcard.llm import common

GRAM, PERCENT, CELL_BITS, SCAN, LARGEST, BLOCK, TASK_ROWS = 4, 85, 18, 8, 4096, 2048, 1 << 16
SETS = ("key long, n long, s1 long, s2 long, bits binary, range int, keys binary, owners binary, sizes binary, places binary")
FILTER = 1 << 22  # cells of the filter that keeps texts no pair asks for out of an exchange
LISTED, SUBSET = np.uint64(0x51ED27), np.uint64(0xA3B195)


NAMELESS = 1 << 62


def vertex(id_col: str, text_col: str):
    """The id, or for rows without one a number made of the text, from NAMELESS on."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NAMELESS) + F.shiftrightunsigned(F.xxhash64(F.col(text_col).cast("string")), 2))


def named(column: str):
    return F.when(F.col(column) < NAMELESS, F.col(column))


def shingles(texts: list[bytes], gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of texts (not yet distinct) and the text of each."""
    w = common.Words(texts, lower=True)
    size = np.diff(w.first)
    n = np.where(size >= gram, size - gram + 1, np.minimum(size, 1))
    own = np.repeat(np.arange(len(texts)), n)
    start = w.first[:-1][own] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    sums = common.sums_of(w.hashes())
    return common.span_hash(sums, start, np.minimum(start + gram, w.first[1:][own])), own


def cell(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def least_common(n: np.ndarray, percent: int) -> np.ndarray:
    return -(-percent * n // 100)


def sizes_and_counts(docs: DataFrame, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """How often each cell's shingles occur, and the number of sets by size (LARGEST and more together)."""

    @common.lean
    def count(batches):
        common.cache("jaccard")
        total = np.zeros((1 << CELL_BITS) + LARGEST + 1, np.int64)
        for batch in batches:
            texts = common.texts_of(batch.column("text"))
            for i, j in common.slices(texts):
                h, own = shingles(texts[i:j], gram)
                total[:1 << CELL_BITS] += np.bincount(cell(h), minlength=1 << CELL_BITS)
                total[1 << CELL_BITS:] += np.bincount(np.minimum(np.bincount(own, minlength=j - i), LARGEST), minlength=LARGEST + 1)
        yield common.array_parts(total)

    total = common.summed(docs.select("text").mapInArrow(count, common.PARTS), np.int64, ((1 << CELL_BITS) + LARGEST + 1,))
    return total[:1 << CELL_BITS], total[1 << CELL_BITS:]


def boundary_of(sizes: np.ndarray, percent: int, scan: float) -> int:
    """Largest size of a small set, by least total cost."""
    n = np.arange(len(sizes))
    lists = np.where(n > 0, n - least_common(n, percent) + 1, 0)
    subsets = (lists + 1) * lists / 2
    small = np.cumsum(sizes * subsets)
    large = (sizes * lists * scan)[::-1].cumsum()[::-1]
    return int(np.argmin(small + np.append(large[1:], 0)))


def set_rows(docs: DataFrame, counts, boundary: int, gram: int, percent: int, ranges: int) -> DataFrame:
    """Rows of SETS: one for each document (key, n and the set's signature), and keys in runs by range."""
    shift = np.uint64(64 - max(1, (ranges - 1).bit_length()))

    def keys_of(h: np.ndarray, size: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys, the index of their set and their place in its order; h holds each set's shingles in order, from begin on."""
        need = least_common(size, percent)
        head = size - need + 1
        scans = np.flatnonzero((size > boundary) | (100 * size >= percent * (boundary + 1)))
        n = head[scans]
        places = [np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        keys, owners = [common.mix(h[np.repeat(begin[scans], n) + places[0]] ^ LISTED) & ~np.uint64(1)], [np.repeat(scans, n)]
        for size_of in np.unique(size[(size > 1) & (size <= boundary)]):
            own = np.flatnonzero(size == size_of)
            width = int(min(size_of, size_of - least_common(size_of, percent) + 2))
            rows = h[begin[own][:, None] + np.arange(width)]
            i, j = np.triu_indices(width, 1)
            pair = common.mix(rows[:, i] + SUBSET) + common.mix(common.mix(rows[:, j]))
            keys.append((common.mix(pair) | np.uint64(1)).reshape(-1))
            owners.append(np.repeat(own, len(i)))
            places.append(np.zeros(len(own) * len(i), np.int64))
        return np.concatenate(keys), np.concatenate(owners), np.concatenate(places)

    def marks(head: np.ndarray) -> bytes:
        return np.sort(head.astype(np.uint16)).tobytes()  # the lower bits of each hash

    @common.lean
    def make(batches):
        common.cache("jaccard")
        for batch in batches:
            ids, texts = batch.column("key").to_numpy(), common.texts_of(batch.column("text"))
            rows, keys, owners, sizes, places = [], [], [], [], []
            for a, b in common.slices(texts):
                h, own = shingles(texts[a:b], gram)
                order = np.lexsort((h, counts.value[cell(h)], own))
                h, own = h[order], own[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
                h, own = h[new], own[new]
                size = np.bincount(own, minlength=b - a)
                begin = np.cumsum(size) - size
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(common.mix(h + common.seeded(k, 11)[k - 1]), dtype=np.uint64)]) for k in (1, 2)]
                s1, s2 = (common.mix(s[begin + size] - s[begin] + size.astype(np.uint64)) for s in sums)
                heads = begin + size - least_common(size, percent) + 1
                bits = [marks(h[i:j]) if n else None for i, j, n in zip(begin, heads, size)]
                rows += zip(ids[a:b].tolist(), size.tolist(), s1.view(np.int64).tolist(), s2.view(np.int64).tolist(), bits)
                k, o, p = keys_of(h, size, begin)
                places.append(p)
                keys.append(k)
                owners.append(ids[a:b][o])
                sizes.append(size[o])
            out = [(*r, *[None] * 5) for r in rows]
            if keys:
                k, o, n, p = (np.concatenate(x) for x in (keys, owners, sizes, places))
                order = np.argsort(k)
                k, o, n, p = k[order], o[order], n[order].astype(np.int32), p[order].astype(np.int32)
                part = (k >> shift).astype(np.int64)
                at = np.flatnonzero(np.diff(part, prepend=-1))
                out += [(*[None] * 5, int(part[i]), common.pack_sorted(k[i:j]), *(common.pack(x[i:j]) for x in (o, n, p)))
                        for i, j in zip(at, [*at[1:], len(k)])]
            kinds = [pa.int64()] * 4 + [pa.binary(), pa.int32()] + [pa.binary()] * 4
            names = [x.strip().split(" ")[0] for x in SETS.split(",")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 10, kinds)], names=names)

    return docs.mapInArrow(make, SETS)


def shared_keys(rows: DataFrame, boundary: int) -> DataFrame:
    """(bucket, owner, n, place) of the keys that several documents have, lists only if they hold a large set."""

    def meet(t: pa.Table) -> pa.Table:
        common.cache("jaccard")
        k = np.concatenate([common.unpack_sorted(x.as_py()) for x in t["keys"]])
        o = np.concatenate([common.unpack(x.as_py(), np.int64) for x in t["owners"]])
        n, p = (np.concatenate([common.unpack(x.as_py(), np.int32) for x in t[c]]) for c in ("sizes", "places"))
        order = np.argsort(k)
        k = k[order]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        count = np.diff(first, append=len(k))
        useful = (count > 1) & ((k[first] & np.uint64(1) == 1) | (np.maximum.reduceat(n[order], first) > boundary))
        keep = np.repeat(useful, count)
        order = order[keep]
        return pa.table({"bucket": pa.array(k[keep].view(np.int64)), "owner": pa.array(o[order]),
                         "n": pa.array(n[order], pa.int64()), "place": pa.array(p[order], pa.int64())})

    return rows.where("range is not null").select("range", "keys", "owners", "sizes", "places").groupBy("range").applyInArrow(
        meet, "bucket long, owner long, n long, place long")


def bitmap(marks: bytes) -> np.ndarray:
    """Four bits for each mark, a power of two of them and 64 at least."""
    bits = np.zeros(1 << min(16, max(6, (2 * len(marks) - 1).bit_length())), np.uint8)
    bits[np.frombuffer(marks, np.uint16) & (len(bits) - 1)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def admitted(heads: list[bytes | None], n: np.ndarray, own: np.ndarray, i: np.ndarray, j: np.ndarray, need: np.ndarray,
             percent: int) -> np.ndarray:
    """Which of the pairs (i, j) of rows the marks of their heads (heads[own]) allow `need` common shingles.

    Common shingles up to where the shorter head ends are in both heads, the others are behind that head. Each bit that
    only one head's bitmap has is a shingle that the other lacks; what passes that is counted by the marks themselves."""
    alike = least_common(n, percent)
    head = n - alike + 1
    out = np.ones(len(i), bool)
    p, q = own[i], own[j]
    maps = {k: bitmap(heads[k]) for k in np.unique(np.concatenate([p, q])).tolist() if heads[k]}
    width = np.array([len(maps[k]) if k in maps else 0 for k in range(len(heads))])
    both = np.minimum(width[p], width[q])
    behind = np.maximum(alike[i], alike[j]) - 1
    for size in np.unique(both[both > 0]):
        which = np.flatnonzero(both == size)
        used = np.unique(np.concatenate([p[which], q[which]]))
        folded = np.stack([np.bitwise_or.reduce(maps[k].reshape(-1, size), axis=0) for k in used.tolist()])
        for part in np.array_split(which, 1 + len(which) * int(size) // (1 << 21)):
            a, b = folded[np.searchsorted(used, p[part])], folded[np.searchsorted(used, q[part])]
            most = np.minimum(head[i[part]] - np.bitwise_count(a & ~b).sum(1), head[j[part]] - np.bitwise_count(b & ~a).sum(1))
            out[part] = most + behind[part] >= need[part]
    distinct: dict[int, tuple[np.ndarray, int]] = {}

    def marks_of(k: int) -> tuple[np.ndarray, int]:
        if k not in distinct:
            x = np.frombuffer(heads[k], np.uint16)
            distinct[k] = (u := np.unique(x)), len(x) - len(u)
        return distinct[k]

    known: dict[tuple[int, int], int] = {}
    for k in np.flatnonzero(out & (both > 0)).tolist():
        pair = int(p[k]), int(q[k])
        if pair not in known:
            (x, twice), (y, double) = marks_of(pair[0]), marks_of(pair[1])
            known[pair] = len(np.intersect1d(x, y, assume_unique=True)) + min(twice, double)
        out[k] = known[pair] + behind[k] >= need[k]
    return out


def paired(t: pa.Table, maps: pa.Table, star: bool, boundary: int, percent: int, at_once: int = 1 << 18) -> pa.Table:
    """Candidates (a, b), a the smaller set, out of whole blocks of keys: with star only those of each block's set that has
    most keys in common with others (degree), so of the one that was changed least. maps: the marks of each set."""
    none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    if not len(t):
        return none
    columns = [t[x].to_numpy() for x in ("bucket", "low", "high", "own", "rep", "n", "place", "c", "degree")]
    order = np.lexsort((columns[4], columns[5], columns[2], columns[1], columns[0]))
    bucket, low, high, own, rep, n, place, c, degree = (x[order] for x in columns)
    ids, at = np.unique(rep, return_inverse=True)
    known = dict(zip(maps["rep"].to_pylist(), maps["bits"].to_pylist()))
    bits = [known.get(k) for k in ids.tolist()]
    new = np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(new)))
    if star:
        group = np.repeat(np.arange(len(first)), size)
        pivot = np.lexsort((rep, -degree, group))[first]
        first, many = pivot, size
    else:
        many = np.repeat(first + size, size) - np.arange(len(new)) - 1
    begin, found = 0, set()
    total = np.cumsum(many)
    while begin < len(many):
        stop = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + at_once, side="right")))
        k = many[begin:stop]
        i, step = np.repeat(np.arange(begin, stop), k), np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        if star:  # rows of a block stand together, sorted by size: the smaller of the two comes first
            j = np.repeat(np.cumsum(size) - size, size)[total[begin] - many[begin]:total[stop - 1]] + step
            i, j = np.minimum(pivot[i], j), np.maximum(pivot[i], j)
        else:
            j = i + 1 + step
        begin = stop
        fine = (c[i] != c[j]) & (rep[i] != rep[j]) & (100 * n[i] >= percent * n[j]) & ((low[i] == high[i]) | (own[i] != own[j]))
        i, j = i[fine], j[fine]
        need = -(-percent * (n[i] + n[j]) // (100 + percent))
        listed = bucket[i] & 1 == 0
        short = n[i] - -(-2 * percent * n[i] // (100 + percent)) + 1
        reach = np.minimum(place[i], place[j]) + 1 + np.minimum(n[i] - place[i], n[j] - place[j]) - 1
        fine = ~listed | (n[j] > boundary) & (place[i] < short) & (reach >= need)
        i, j, need = i[fine], j[fine], need[fine]
        fine = admitted(bits, n, at, i, j, need, percent)
        found.update(zip(rep[i[fine]].tolist(), rep[j[fine]].tolist()))
    return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})


def asked_for(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text) of the documents (key, text) with the given ids. A filter of fixed size, a cell for each hash, keeps
    most other texts out of the exchange; it lets some through, the join none."""

    @common.lean
    def marks(batches):
        common.cache("jaccard")
        total = np.zeros(FILTER, np.uint32)
        for batch in batches:
            total[common.mix(batch.column("id").to_numpy().view(np.uint64)) & np.uint64(FILTER - 1)] = 1
        yield common.array_parts(total)

    seen = docs.sparkSession.sparkContext.broadcast(np.packbits(common.summed(ids.mapInArrow(marks, common.PARTS), np.uint32, (FILTER,)) > 0))

    @common.lean
    def likely(batches):
        common.cache("jaccard")
        cells = seen.value
        for batch in batches:
            at = common.mix(batch.column("id").to_numpy().view(np.uint64)) & np.uint64(FILTER - 1)
            yield batch.filter(pa.array((cells[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1 == 1))

    some = docs.select(F.col("key").alias("id"), "text").mapInArrow(likely, "id long, text binary")
    return some.join(ids, "id").select("id", "text")


def verified(pairs: DataFrame, texts: DataFrame, gram: int, percent: int, group_rows: int = 1000) -> DataFrame:
    """Those of the pairs (a, b) whose sets link. A pivot a comes with 64 partners at a time, and many pivots to a task's
    group, so neither a frequent pivot nor many rare ones make it large or slow."""
    many = pairs.groupBy("a").count().select("a", (F.col("count") / 64 + 1).cast("long").alias("blocks"))
    pairs = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("blocks")).alias("block"))
    asked = cut_pairs = common.cut(pairs)
    groups = max(1, cut_pairs.count() * 2 // group_rows)
    asked = asked.select(F.col("b").alias("id"), "a", "b", "block").unionByName(
        asked.select(F.col("a").alias("id"), "a", F.lit(None).cast("long").alias("b"), "block").distinct())
    held = asked.join(texts, "id").withColumn("group", F.pmod(F.xxhash64("a", "block"), F.lit(groups)))

    def compare(t: pa.Table) -> pa.Table:
        common.cache("jaccard")
        a, b, block = t["a"].to_numpy(), t["b"].to_pylist(), t["block"].to_numpy()
        pivots, others, out = {}, {}, []
        for i, (x, y, z) in enumerate(zip(a.tolist(), b, block.tolist())):
            (pivots if y is None else others).setdefault((x, z), []).append(i)
        texts = common.texts_of(t["text"])

        def set_of(i: int) -> np.ndarray:
            return np.unique(shingles([texts[i]], gram)[0])

        for at, members in others.items():
            for p in pivots.get(at, ()):
                x = set_of(p)
                for i in members:
                    y = set_of(i)
                    common_n = len(x) + len(y) - len(np.union1d(x, y))
                    if 100 * common_n >= percent * (len(x) + len(y) - common_n):
                        out.append((at[0], b[i]))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return common.cut(held.groupBy("group").applyInArrow(compare, "a long, b long").distinct())


def joined(docs: DataFrame, gram: int = GRAM, percent: int = PERCENT, scan: float = SCAN, boundary: int | None = None,
           block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: key, n_shingles, class_id (least id with an equal set) and component_id."""
    docs = docs.select(vertex(id_col, text_col).alias("key"), F.col(text_col).cast("string").cast("binary").alias("text"))
    counts, sizes = sizes_and_counts(docs, gram)
    if boundary is None:
        boundary = boundary_of(sizes, percent, scan)
    held = docs.sparkSession.sparkContext.broadcast(counts)
    ranges = max(1, int(np.ceil(counts.sum() / 2e6)))
    rows = common.stored(set_rows(docs, held, boundary, gram, percent, ranges))
    sets = rows.where("range is null").select("key", "n", "s1", "s2")
    classes = common.cut(sets.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("key").alias("rep")))
    member = common.cut(sets.join(classes, ["s1", "s2", "n"], "left").select("key", "n", F.coalesce("rep", "key").alias("rep")))

    of_owner = member.where("n > 0").select(F.col("key").alias("owner"), "rep").distinct()
    keys = shared_keys(rows, boundary).join(of_owner, "owner").select("bucket", "rep", "n", "place").distinct()
    # of rows that share an id but not the text there are no marks
    heads = rows.where("bits is not null").join(classes.select(F.col("rep").alias("key")).distinct(), "key").groupBy("key").agg(
        F.min("bits").alias("low"), F.max("bits").alias("high")).select(F.col("key").alias("rep"), F.when(F.col("low") == F.col("high"), F.col("low")).alias("bits"))
    degree = keys.groupBy("rep").agg(F.count("*").alias("degree"))
    keys, heads = common.stored(keys.join(degree, "rep")), common.stored(heads)
    tasks = max(1, keys.count() // TASK_ROWS)

    def pairing(star: bool):
        return lambda t, maps: paired(t, maps, star, boundary, percent)

    links, place = None, None
    for star in (True, False):
        now = keys.withColumn("c", F.col("rep")) if place is None else keys.join(
            place.select(F.col("id").alias("rep"), "component"), "rep", "left").withColumn("c", F.coalesce("component", "rep"))
        open_keys = now.groupBy("bucket").agg(F.count("*").alias("many"), F.min("c").alias("x"), F.max("c").alias("y"),
                                            F.min(F.struct(-F.col("degree"), F.col("rep"), F.col("n"))).alias("pivot")).where("x <> y")
        blocks = F.ceil(F.col("many") / block).cast("int")
        now = now.join(open_keys, "bucket").withColumn("own", F.pmod(F.xxhash64("rep"), blocks).cast("int"))
        now = now.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        # keys with one pivot go to one task, where a pair under many keys is found once; those of long sets to several
        salt = F.pmod("bucket", 1 + (F.col("pivot.n") / BLOCK).cast("long"))
        low, high = F.least("own", "other"), F.greatest("own", "other")
        now = now.select("bucket", low.alias("low"), high.alias("high"), "own", "rep", "n", "place", "c", "degree",
                         F.pmod(F.xxhash64("pivot.rep", low, high, salt), F.lit(tasks)).alias("task"))
        maps = now.select(F.col("task").alias("for_task"), F.col("rep").alias("of")).distinct().join(heads, F.col("of") == heads["rep"])
        pairs = now.groupBy("task").cogroup(maps.select("for_task", "rep", "bits").groupBy("for_task")).applyInArrow(pairing(star), "a long, b long")
        pairs = common.cut(pairs.distinct())
        ids = common.cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
        found = verified(pairs, common.stored(asked_for(docs, ids)), gram, percent)
        links = found if links is None else links.unionByName(found)
        place = common.cut(common.components(links))
    out = member.join(place.select(F.col("id").alias("rep"), "component"), "rep", "left")
    return out.select("key", F.col("n").alias("n_shingles"), F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    out = joined(common.table(spark, sf_dir, "documents"))
    return out.select(named("key").alias("doc_id"), "n_shingles", named("component_id").alias("component_id"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') END AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 3], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m USING (doc_id)
"""
