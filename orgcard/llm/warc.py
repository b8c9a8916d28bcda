"""WARC records in ZIP packages: written by Spark tasks, read back by ranges without extraction.

An archive is a ZIP file with stored members: `archive/data.warc.gz`, one gzip member for each WARC record, and
`indexes/index.cdxj`, a line for each record with its offset and length. Archives are rows of a table in the shared
folder, bytes in blocks of `BLOCK`, so any store that Spark writes can hold them and a lost task is simply done again.

The reader works on anything that can read a range. It finds the end of central directory (and behind its locator the
ZIP64 one), walks the central directory with ZIP64 extra fields, resolves stored members through their local headers,
reads the index and then each record by its range alone.

Records with equal payloads of `least_bytes` at least are written once as `response`, by the smallest page_id; the
others are `revisit` records without payload that name it.

Results for special cases: a null html is an empty payload; equal rows with the smallest page_id are all responses; a
null page_id counts as larger than every other and comes back null; a null url leaves the target URI out.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgcard.llm import common

BLOCK, ARCHIVE = 1 << 20, 8 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVES = "name string, size long, blocks array<binary>"
RECORDS = "key long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(key: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{key}')}>"


def header_value(text: str) -> str:
    """A value on one line: control characters percent-encoded."""
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in text)


def record(key: int, url: str | None, payload: bytes, sha1: str, first: int | None, date: str) -> bytes:
    """One WARC record; first: the page that has the payload, if this one only refers to it."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if first is None else b"")
    lines = [("WARC-Type", "response" if first is None else "revisit"), ("WARC-Record-ID", record_id(key)), ("WARC-Date", date),
             ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
             ("WARC-Payload-Digest", f"sha1:{base32(bytes.fromhex(sha1))}"), ("WARC-Page-ID", str(key))]
    if url is not None:
        lines.append(("WARC-Target-URI", header_value(url)))
    if first is not None:
        lines += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(first)), ("WARC-Refers-To-Page-ID", str(first))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def packaged(records: list[bytes]) -> bytes:
    """A ZIP file of gzipped records and their index, both stored."""
    lines, at = [], 0
    for x in records:
        lines.append(json.dumps({"offset": at, "length": len(x)}))
        at += len(x)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, data in ((DATA, b"".join(records)), (INDEX, "\n".join(lines).encode())):
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data)
    return out.getvalue()


def write_archives(pages: DataFrame, least_bytes: int = 0, archive_bytes: int = ARCHIVE, date: str = "2024-01-01T00:00:00Z",
                   id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Archives (name, size, blocks) of a record for each row of pages."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    pages = pages.select(common.id_or_last(id_col).alias("key"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    pages = pages.withColumn("sha1", F.sha1("payload"))
    firsts = pages.groupBy("sha1").agg(F.min("key").alias("first"))
    pages = pages.join(firsts, "sha1")

    def archives(batches):
        held, size = [], 0

        def flush():
            data = packaged(held)
            name = hashlib.sha256(data).hexdigest() + ".wacz"
            blocks = [data[i:i + BLOCK] for i in range(0, len(data), BLOCK)]
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(data)], pa.int64()), pa.array([blocks], pa.list_(pa.binary()))],
                                              names=["name", "size", "blocks"])

        for batch in batches:
            for r in batch.to_pylist():
                known = r["first"] if len(r["payload"]) >= least_bytes and r["key"] != r["first"] else None
                x = gzip.compress(record(r["key"], r["url"], r["payload"], r["sha1"], known, date), 5, mtime=0)
                if held and size + len(x) > archive_bytes:
                    yield flush()
                    held, size = [], 0
                held.append(x)
                size += len(x)
        if held:
            yield flush()

    return pages.mapInArrow(archives, ARCHIVES)


class Blocks:
    """Reads ranges of bytes that lie in blocks of equal length."""

    def __init__(self, blocks: list[bytes], size: int, block: int = BLOCK):
        self.blocks, self.size, self.block = blocks, size, block

    def read(self, at: int, n: int) -> bytes:
        out = []
        while n > 0 and at < self.size:
            i, off = divmod(at, self.block)
            piece = self.blocks[i][off:off + n]
            out.append(piece)
            at, n = at + len(piece), n - len(piece)
        return b"".join(out)


def members(source) -> dict[str, tuple[int, int]]:
    """Offset and length of each stored member's bytes; source has size and read(at, n)."""
    tail_at = max(0, source.size - 65_557)  # the end record and the longest comment
    tail = source.read(tail_at, source.size - tail_at)
    end = len(tail)
    while True:  # a comment may hold the mark too: the right one's comment ends the file
        end = tail.rfind(b"PK\x05\x06", 0, end)
        if end < 0:
            raise ValueError("no end of central directory")
        if end + 22 <= len(tail) and end + 22 + struct.unpack_from("<H", tail, end + 20)[0] == len(tail):
            break
    count, size, at = struct.unpack_from("<HII", tail, end + 10)
    if count == 0xFFFF or size == 0xFFFFFFFF or at == 0xFFFFFFFF:
        mark, _, record_at = struct.unpack("<4sIQ", source.read(tail_at + end - 20, 16))
        if mark != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        wide = source.read(record_at, 56)
        if wide[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        count, size, at = struct.unpack_from("<QQQ", wide, 32)
    directory, found, i = source.read(at, size), {}, 0
    for _ in range(count):
        if directory[i:i + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, = struct.unpack_from("<H", directory, i + 10)
        packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", directory, i + 20)
        offset, = struct.unpack_from("<I", directory, i + 42)
        name = directory[i + 46:i + 46 + n_name].decode("utf-8", "replace")
        extra, j = directory[i + 46 + n_name:i + 46 + n_name + n_extra], 0
        while j + 4 <= len(extra):
            tag, n = struct.unpack_from("<HH", extra, j)
            if tag == 1:  # ZIP64: only the fields that do not fit, in this order
                wide = [x for x, in struct.iter_unpack("<Q", extra[j + 4:j + 4 + n // 8 * 8])]
                plain, packed, offset = (wide.pop(0) if x == 0xFFFFFFFF and wide else x for x in (plain, packed, offset))
            j += 4 + n
        if method == 0:
            local = source.read(offset, 30)
            if local[:4] != b"PK\x03\x04":
                raise ValueError(f"no local header of {name}")
            found[name] = offset + 30 + sum(struct.unpack_from("<HH", local, 26)), packed
        i += 46 + n_name + n_extra + n_comment
    return found


def fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}


def parsed(data: bytes) -> tuple:
    """A row of RECORDS from one gzip member."""
    head, _, rest = gzip.decompress(data).partition(b"\r\n\r\n")
    warc = fields(head)
    block = rest[:int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest, full = warc["warc-payload-digest"].removeprefix("sha1:"), int(fields(http)["content-length"])
    if warc["warc-type"] == "response" and (len(payload) != full or base32(hashlib.sha1(payload).digest()) != digest):
        raise ValueError(f"damaged record {warc['warc-record-id']}")
    refers = warc.get("warc-refers-to-page-id")
    return (int(warc["warc-page-id"]), warc.get("warc-target-uri"), warc["warc-type"], full, digest,
            int(refers) if refers is not None else None, payload if warc["warc-type"] == "response" else None)


def records(source):
    """Rows of RECORDS of one package, each read by its own range."""
    found = members(source)
    data, _ = found[DATA]
    for line in source.read(*found[INDEX]).decode().split("\n"):
        if line:
            entry = json.loads(line)
            yield parsed(source.read(data + entry["offset"], entry["length"]))


def read_archives(archives: DataFrame, rows_a_batch: int = 256) -> DataFrame:
    """Rows of RECORDS of archives (name, size, blocks)."""
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    names = [x.strip().split(" ")[0] for x in RECORDS.split(",")]

    def read(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                one, held = batch.slice(i, 1), []
                blocks = [x.as_buffer() for x in one.column("blocks")[0].values]
                source = Blocks([memoryview(b) for b in blocks], one.column("size")[0].as_py())
                for r in records(source):
                    held.append(r)
                    if len(held) == rows_a_batch:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)

    return archives.mapInArrow(read, RECORDS)


def query(spark, sf_dir: str) -> DataFrame:
    archives = common.stored(write_archives(common.table(spark, sf_dir, "pages")))
    return read_archives(archives).select(
        common.id_or_null("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        common.id_or_null("refers_to").alias("refers_to"))


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
s AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h, CAST(CAST(unhex(sha1(b)) AS BIT) AS VARCHAR) AS bits FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM s)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + list_sum(list_transform(range(5), lambda j: CAST(substr(bits, i * 5 + j + 1, 1) AS INTEGER) * CAST(pow(2, 4 - j) AS INTEGER)))::INTEGER, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""
