"""Helpers shared by the corpus operators: word spans, hashes, compact runs, shared storage, components.

Texts are handled as UTF-8 bytes in slices of whole documents, so that the arrays of a task stay small however long a
partition is. Hashes are functions of the content alone: every task and every rerun computes the same ones.
"""

from __future__ import annotations

import ctypes
import tempfile
import time
import uuid
import zipfile
from functools import wraps
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are held as arrays at a time, and that one chunk of a grouped operator holds on average.
SLICE, CHUNK = 1 << 20, 4 << 20
#: Stands for a null id inside the operators: larger than every other.
NO_ID = (1 << 63) - 1

_GOLDEN, _BASE, _LOW = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, (1 << 64) - 1
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all bits; distinct values stay distinct."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def seeded(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit values."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_GOLDEN) + np.uint64(seed * 0x1000193 & _LOW)) | np.uint64(1)


_BYTE = {seed: seeded(256, seed) for seed in (1, 2)}
_powers: dict[str, np.ndarray] = {}


def trim_heap():
    """Gives freed memory back to the system, where the C library has a call for it."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


_caches: dict[str, dict] = {}
_given_back = [0.0]


def give_back():
    """Gives what a worker has freed back to the system, in Arrow's pool and in the heap."""
    pa.default_memory_pool().release_unused()
    trim_heap()
    _given_back[0] = time.monotonic()


def cache(owner: str) -> dict:
    """What a worker keeps of one operator from task to task. Workers are used again by later stages, so what they keep of
    other operators is dropped first. What groups have freed is given back every second or so."""
    other = [name for name in _caches if name != owner]
    for name in other:
        del _caches[name]
    if other or time.monotonic() > _given_back[0] + 1:
        give_back()
    return _caches.setdefault(owner, {})


def lean(function):
    """For functions over the record batches of a task: at its end freed memory is given back, as Spark keeps the worker, idle or
    for other tasks."""

    @wraps(function)
    def run(batches):
        yield from function(batches)
        give_back()

    return run


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n at least."""
    if len(_powers.get("up", ())) < n:
        size = max(n, SLICE + (SLICE >> 2))
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["up"], _powers["down"]


def sums_of(values: np.ndarray) -> np.ndarray:
    """Prefix sums out of which span_hash() takes the hash of any span."""
    n = len(values)
    out = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(n)[0][:n], out=out[1:])
    return out


def byte_sums(buf: np.ndarray, seed: int = 1) -> np.ndarray:
    return sums_of(_BYTE[seed][buf])


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the values in [start, end), independent of where they stand."""
    down = powers(len(sums))[1]
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(_GOLDEN))


def texts_of(column) -> list[bytes]:
    """A text column of an Arrow table or batch as UTF-8 bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def small(batches, rows: int = 2048):
    """The record batches a task is given, in parts of so many rows, so that few texts are held as objects at a time."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def slices(texts: list[bytes], limit: int = SLICE):
    """Runs of whole texts, (from, to), of about limit bytes or one longer text."""
    begin, held = 0, 0
    for i, x in enumerate(texts):
        if held and held + len(x) > limit:
            yield begin, i
            begin, held = i, 0
        held += len(x) + 1
    if begin < len(texts):
        yield begin, len(texts)


class Words:
    """Word spans of some texts in one buffer: start, end of each word; first[i]..first[i+1] are the words of text i."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        data = b"\n" + b"\n".join(texts) + b"\n"
        self.buf = np.frombuffer(data.lower() if lower else data, np.uint8)
        blank = BLANK[self.buf]
        edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        self.start, self.end = edges[0::2], edges[1::2]
        at = np.cumsum([1, *(len(x) + 1 for x in texts)])
        self.first = np.searchsorted(self.start, at)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, seed: int = 1) -> np.ndarray:
        return span_hash(byte_sums(self.buf, seed), self.start, self.end)

    def text_of(self) -> np.ndarray:
        """Index of its text for each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def window_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each full window of width values."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


_PLACE = np.uint64((1 << 28) - 1)


def anchors(grams: np.ndarray, width: int) -> np.ndarray:
    """For each window of width grams the place of the one with the least hash, the first of equals.

    The place depends on the window's content alone, so equal windows have their anchor at the same offset."""
    ranked = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    return (window_min(ranked, width) & _PLACE).astype(np.int64)


def pack(values: np.ndarray) -> bytes:
    """A compressed array; sorted integers are best given as differences."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.tobytes())


def unpack(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).reshape(-1)


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=values.dtype.type(0)))


def unpack_sorted(data: bytes, dtype=np.uint64) -> np.ndarray:
    return np.cumsum(unpack(data, dtype), dtype=dtype)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a fresh one of this machine only where none is set, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        found = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder, with no lineage before them; for narrow tables."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The rows written as Parquet to the shared folder and read back; for wider tables."""
    path = f"{shared_dir(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_or_last(column: str):
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def id_or_null(column: str):
    return F.when(F.col(column) != NO_ID, F.col(column))


def n_chunks(text_bytes: int, size: int = CHUNK) -> int:
    return max(1, -(-text_bytes // size))


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id reachable, for every id in the undirected edges (a, b).

    Star contraction: each round links every neighbour of a vertex to its least neighbour, first the larger ones, then
    the smaller ones, until nothing changes; rounds grow with the logarithm of a component's size. Each round is one
    aggregation and one join that skewed vertices do not overload, as one side is unique."""
    pairs = F.array(F.struct(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    edges = cut(edges.where("a <> b").select(F.inline(pairs)).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.inline(F.array(
            F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))))
        edges = cut(small.where("u <> v").distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first())
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


PARTS = "block int, data binary"


def array_parts(values: np.ndarray, blocks: int = 16) -> pa.RecordBatch:
    """A task's array as rows of PARTS, for summed()."""
    rows = np.array_split(values.reshape(len(values), -1), blocks)
    return pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array([pack(x.reshape(-1)) for x in rows], pa.binary())],
                                      names=["block", "data"])


def summed(parts: DataFrame, dtype, like: tuple[int, ...]) -> np.ndarray:
    """Sum of the arrays of all tasks, of a fixed shape whatever the data; the sums are formed block by block in tasks."""
    dtype = np.dtype(dtype)

    def add(t: pa.Table) -> pa.Table:
        total = None
        for x in sorted(t["data"].to_pylist()):  # in one order, so that sums of floats are the same in every run
            x = unpack(x, dtype)
            total = x.copy() if total is None else total + x
        return pa.table({"block": t["block"].slice(0, 1).combine_chunks(), "data": pa.array([pack(total)], pa.binary())})

    rows = sorted((r["block"], bytes(r["data"])) for r in parts.groupBy("block").applyInArrow(add, PARTS).collect())
    return np.concatenate([unpack(x, dtype) for _, x in rows]).reshape(like) if rows else np.zeros(like, dtype)


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def hand_over(spark: SparkSession, rows: int | None = None) -> None:
    """So many rows go to a Python worker at a time (None: as many as the session is set to by default). Rows with whole texts
    are held on both sides, so fewer of them keep a task small; results do not depend on it."""
    if rows is None:
        spark.conf.unset(BATCH_ROWS)
    else:
        spark.conf.set(BATCH_ROWS, str(rows))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once for each application, so that it need not be installed there."""
    if (app := spark.sparkContext.applicationId) in _shipped:
        return
    root = Path(__file__).parents[1]
    file = Path(tempfile.mkdtemp(prefix="package-")) / f"{root.name}-{uuid.uuid4().hex}.zip"
    with zipfile.ZipFile(file, "w") as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, source.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(file))
    _shipped.add(app)
