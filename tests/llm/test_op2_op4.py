"""Archives against an exact round trip; mixing against its targets and the plain apportionment rule."""

import base64
import hashlib
import io
import struct
import zipfile
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from orgcard.llm import common, mixing, warc


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows],
                                 "page_id long, url string, html string, key string, sha1 string")


def test_round_trip(spark):
    rows = [(i, f"http://a/{i}", f"<p>é {i % 7}</p>" * (i % 5)) for i in range(40)]
    rows += [(3, "http://a/3", rows[3][2]), (None, None, None), (99, "http://x/\n\r", None), (98, None, ""), (97, "u", "z" * (3 << 20))]
    archives = warc.write_archives(pages(spark, rows), archive_bytes=4000)
    held = archives.collect()
    got = {}
    for r in warc.read_archives(archives).collect():
        got.setdefault(r.key, []).append(r)
    first = {}
    for i, _, h in rows:
        i = common.NO_ID if i is None else i
        first[h or ""] = min(first.get(h or "", i), i)
    assert sum(map(len, got.values())) == len(rows)
    for i, _, h in rows:
        i, data = (common.NO_ID if i is None else i), (h or "").encode()
        for r in got[i]:
            assert r.payload_bytes == len(data) and r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
            assert r.record_type == ("response" if first[h or ""] == i else "revisit")
            assert r.refers_to == (None if first[h or ""] == i else first[h or ""])
            assert r.payload == (data if r.record_type == "response" else None)
    for a in held:  # a library agrees that they are sound ZIP files
        assert zipfile.ZipFile(io.BytesIO(b"".join(a.blocks))).testzip() is None


def test_smaller_ones_are_all_responses(spark):
    got = warc.read_archives(warc.write_archives(pages(spark, [(1, None, "a"), (2, None, "a"), (3, None, "bb"), (4, None, "bb")]), least_bytes=2))
    assert {r.key: r.record_type for r in got.collect()} == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_no_pages(spark):
    assert warc.read_archives(warc.write_archives(pages(spark, []))).collect() == []


def test_zip64_and_comment():
    data = bytearray(warc.packaged([warc.gzip.compress(warc.record(7, "u", b"hello", hashlib.sha1(b"hello").hexdigest(), None, "d"))]))
    end = data.rfind(b"PK\x05\x06")
    count, size, at = struct.unpack_from("<HII", data, end + 10)
    # the first member's sizes and offset moved to a ZIP64 field
    n_name, n_extra, _ = struct.unpack_from("<HHH", data, at + 28)
    packed, plain = struct.unpack_from("<II", data, at + 20)
    offset, = struct.unpack_from("<I", data, at + 42)
    extra = struct.pack("<HHQQQ", 1, 24, plain, packed, offset)
    entry = bytearray(data[at:at + 46 + n_name])
    struct.pack_into("<II", entry, 20, 0xFFFFFFFF, 0xFFFFFFFF)
    struct.pack_into("<H", entry, 30, len(extra))
    struct.pack_into("<I", entry, 42, 0xFFFFFFFF)
    directory = bytes(entry) + extra + bytes(data[at + 46 + n_name + n_extra:end])
    record = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, count, count, len(directory), at)
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, at + len(directory), 1)
    tail = struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 12) + b"PK\x05\x06 noise.."[:12].ljust(12)
    whole = bytes(data[:at]) + directory + record + locator + tail
    blocks = [whole[i:i + 64] for i in range(0, len(whole), 64)]
    got = list(warc.records(warc.Blocks(blocks, len(whole), 64)))
    assert [(r[0], r[2], r[3], r[6]) for r in got] == [(7, "response", 5, b"hello")]
    with pytest.raises(ValueError):
        warc.members(warc.Blocks([b"nothing"], 7))


def by_quotients(weights, seats):
    got = [0] * len(weights)
    for _ in range(seats):
        best = max(range(len(weights)), key=lambda i: (weights[i] / (2 * got[i] + 1), -i))
        got[best] += 1
    return got


@pytest.mark.parametrize("weights,seats", [([5.0, 2.0, 1.0], 17), ([1.0] * 7, 10), ([3.5, 0.0, 9.25, 1e-3], 40), ([1.0], 3), ([2.0, 2.0], 0)])
def test_sainte_lague(weights, seats):
    got = mixing.sainte_lague(weights, seats)
    assert sum(got) == seats
    assert sorted(zip(weights, got)) == sorted(zip(weights, by_quotients(weights, seats)))


@pytest.mark.parametrize("most", [1, 3])
def test_seats_of_shards_are_those_of_the_quotient_rule(spark, most):
    """Ties at the divisor, many shards of one block, and limits of each shard: seats add up and are the highest quotients."""
    cases = {}
    for blocks in ([7] * 40, [1] * 60, [1, 1, 1, 1000, 5, 5, 5, 5, 12, 0, 12], [9]):
        for wanted in {0, 1, 3, sum(blocks) // 7, sum(blocks) * most // 2, sum(blocks) * most - 1, sum(blocks) * most}:
            cases[f"{len(blocks)}-{wanted}"] = (blocks, wanted)
    shards = spark.createDataFrame([(s, i, b) for s, (blocks, _) in cases.items() for i, b in enumerate(blocks)], "source string, shard long, blocks long")
    seats = spark.createDataFrame([(s, wanted, sum(blocks)) for s, (blocks, wanted) in cases.items()], "source string, seats long, blocks long")
    got = {(r.source, r.shard): r.seats for r in mixing.by_divisor(shards, seats, most).collect()}
    assert len(got) == sum(len(blocks) for blocks, _ in cases.values())
    for s, (blocks, wanted) in cases.items():
        won = [got[s, i] for i in range(len(blocks))]
        highest = sorted((b / (2 * k + 1) for b in blocks for k in range(most * b)), reverse=True)[:wanted]
        assert sum(won) == wanted, (s, won)
        assert sorted((b / (2 * k + 1) for b, n in zip(blocks, won) for k in range(n)), reverse=True) == highest, (s, won)


def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == [187.5, 75.0, 37.5]
    got = mixing.targets([10, 1000, 1000], [5, 2, 1])
    assert got[0] == 30 and abs(sum(got) - 2010) < 1e-9 and abs(got[1] - 2 * got[2]) < 1e-9
    assert mixing.targets([], []) == [] and mixing.targets([0, 0], [5, 2]) == [0.0, 0.0]


def documents(spark, rows):
    return spark.createDataFrame([(i, t, s, "k", 3) for i, t, s in rows], "doc_id long, text string, source string, key string, size long")


def test_mix(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(i * 37 % 211)), ["b", "a", None, "Z", "é"][i % 5 if i % 3 else 0]) for i in range(900)]
    rows += [(5, rows[5][1], rows[5][2]), (None, "x y\tz", "tiny"), (901, None, "a"), (902, " \n", None), (903, "", "empty")]
    docs = documents(spark, rows)
    options = dict(block_tokens=8, shard_tokens=3000)
    out = mixing.mix(docs, **options).collect()
    again = mixing.mix(docs.repartition(5), **options).collect()
    key = lambda r: repr(tuple(r))
    assert sorted(out, key=key) == sorted(again, key=key) and len(out) == len(rows)
    total = defaultdict(lambda: [0, 0])
    for r in out:
        assert 0 <= r.taken <= 3 * r["size"]
        total[(r.source_size, r.target)][0] += r.taken
        total[(r.source_size, r.target)][1] += r["size"]
    for (size, target), (taken, sizes) in total.items():
        assert sizes == size and abs(taken - target) <= max(24, 0.02 * target)
    assert abs(sum(t for _, t in total) - sum(s for s, _ in total)) < 1e-6
    text = mixing.mix(docs, with_text=True, keep=("size",), **options).collect()
    words = defaultdict(int)
    for r in text:
        words[r.key] += len(r.text.split())
    six = mixing.mix(docs, most=6, weights=(1000, 1), **options).groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert any(r.target == 6 * r.source_size > 0 for r in six) and all(abs(r.taken - r.target) <= max(24, 0.02 * r.target) for r in six)
    assert words == {k: n for k, n in ((r.key, sum(x.taken for x in out if x.key == r.key)) for r in out) if n}
    assert mixing.mix(documents(spark, [])).collect() == []
    with pytest.raises(ValueError):
        mixing.mix(docs, max_sources=2)


def test_rows_of_one_id_are_spread_over_shards(spark):
    docs = documents(spark, [(None, f"words of text {i}", "a") for i in range(2000)])
    got = [r["count"] for r in docs.groupBy(F.pmod(mixing.place_of("doc_id", "text", 17), F.lit(8)).alias("shard")).count().collect()]
    assert len(got) == 8 and max(got) < 400
    out, again = (sorted(map(repr, mixing.mix(x, with_text=True, block_tokens=8, shard_tokens=500).collect())) for x in (docs, docs.repartition(7)))
    assert out == again
