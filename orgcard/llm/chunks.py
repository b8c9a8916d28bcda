"""Documents in chunks that ask about their content: sorted runs go out by range, one bit for each entry comes back.

A chunk is a set of documents chosen by a hash of id and text, about common.CHUNK bytes; only rows equal in both always
share one. A grouped operator makes of
each chunk sorted, compressed runs, one for each range of a key; all runs of a range meet in one task, which answers
each chunk with one bit (or run-length coded facts) for each entry it sent. Equal entries of a chunk are sent once, so
a text that a third of all documents share adds one entry a chunk to its range, and no group grows with a hot value.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgcard.llm import common

RUNS = "range int, kind int, chunk int, data binary, counts binary"
BITS = "chunk int, kind int, range int, data binary"


@dataclass
class Layout:
    """Numbers of chunks and ranges for some bytes of text. Ranges grow with the root of the chunks, so that both what a
    chunk sends to a range and what a range receives grow slowly."""

    text_bytes: int
    chunk_bytes: int = common.CHUNK
    spread: int = 4

    @property
    def chunks(self) -> int:
        return common.n_chunks(self.text_bytes, self.chunk_bytes)

    @property
    def ranges(self) -> int:
        return max(1, int(np.ceil(self.spread * np.sqrt(self.chunks))))

    @property
    def bits(self) -> int:
        """Width of a sketch row as a power of two: cells for each byte of text."""
        return max(16, int(self.text_bytes).bit_length())


def dealt(docs: DataFrame, layout: Layout, *cols: str) -> DataFrame:
    """Columns key and text (and cols) in chunks, by one exchange that every stage of a query shares."""
    chunk = F.pmod(F.xxhash64("key", F.col("text").cast("binary")), F.lit(layout.chunks)).cast("int")
    return docs.select("key", F.col("text").cast("binary").alias("text"), *cols, chunk.alias("chunk")).repartition(
        layout.chunks, "chunk")


def run_rows(kind: int, chunk: int, values: np.ndarray, counts: np.ndarray, shift: int) -> list[tuple]:
    """Rows of RUNS for sorted 64-bit values, cut where value >> shift changes the range."""
    ranges = (values >> np.uint64(shift)).astype(np.int64)
    at = np.flatnonzero(np.diff(ranges, prepend=-1))
    return [(int(ranges[i]), kind, chunk, common.pack_sorted(values[i:j]), common.pack(counts[i:j]))
            for i, j in zip(at, [*at[1:], len(values)])]


def arrow(rows: list[tuple], ddl: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [x.strip().split(" ") for x in ddl.split(",")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.table([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


def repeated(runs: pa.Table) -> pa.Table:
    """For one range and kind: of each chunk's entries, which have a count over one over all chunks together."""
    if not len(runs):
        return arrow([], BITS)
    at, kind = runs["range"][0].as_py(), runs["kind"][0].as_py()
    order = np.argsort(runs["chunk"].to_numpy(), kind="stable")
    runs = runs.take(pa.array(order))
    values = [common.unpack_sorted(x.as_py()) for x in runs["data"]]
    counts = np.concatenate([common.unpack(x.as_py(), np.uint8) for x in runs["counts"]])
    merged, place = np.unique(np.concatenate(values), return_inverse=True)
    often = (np.bincount(place, weights=counts, minlength=len(merged)) > 1)[place]
    out, i = [], 0
    for chunk, x in zip(runs["chunk"].to_pylist(), values):
        out.append((chunk, kind, at, np.packbits(often[i:i + len(x)]).tobytes()))
        i += len(x)
    return arrow(out, BITS)


def answered(bits: pa.Table, kind: int, values: np.ndarray, shift: int) -> np.ndarray:
    """Which of the sorted values that this chunk sent as this kind were repeated."""
    got = {r: d for k, r, d in zip(bits["kind"].to_pylist(), bits["range"].to_pylist(), bits["data"].to_pylist()) if k == kind}
    out = np.zeros(len(values), bool)
    ranges = (values >> np.uint64(shift)).astype(np.int64)
    at = np.flatnonzero(np.diff(ranges, prepend=-1))
    for i, j in zip(at, [*at[1:], len(values)]):
        if (data := got.get(int(ranges[i]))) is not None:
            out[i:j] = np.unpackbits(np.frombuffer(data, np.uint8), count=j - i).astype(bool)
    return out


def counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and 2 for those that occur more than once, else 1."""
    values = np.sort(values)
    first = np.flatnonzero(np.diff(values, prepend=~values[:1]) != 0) if len(values) else np.zeros(0, np.int64)
    return values[first], np.minimum(np.diff(first, append=len(values)), 2).astype(np.uint8)


def text_size(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length(F.col("text").cast("binary")))).first()[0] or 0
