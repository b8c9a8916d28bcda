"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

A source's target is its weight's share of all tokens, at most `most` times its size, the excess shared again by weight.
Each source's documents are dealt to shards of about `shard_tokens` tokens by a hash of id and text (a large source has many),
laid end to end in seeded order and cut into blocks of equal length, about `block_tokens`.

1. Seats (blocks to take) go to sources by highest quotients weight / (2 seats + 1); with very many seats that is done by
   the equivalent divisor, under which every source gets its rounded quotient.
2. A source's seats go to its shards likewise, in proportion to their blocks and at most `most` a block; all divisors are
   searched together by aggregations over the shard table, which never leaves the cluster, and seats that tie at the divisor
   go by highest quotient, then by a seeded order of the shards, until all are given.
3. In a shard every block is taken seats // blocks times and the rest are chosen by a seeded order.

Only per-source totals reach the driver, at most `max_sources` (more is an error, not a cut).

Results for special cases: a null or blank text has size 0 and takes 0; a null source is a source of its own, last in
order; equal rows count each for itself; a source without tokens has target 0. Reruns give the same rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orgcard.llm import common

WEIGHTS, MOST, BLOCK, SHARD, SEED, MAX_SOURCES = (5, 2, 1), 3, 64, 1 << 20, 17, 100_000
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: list[float], most: float = MOST) -> list[float]:
    """Share of all tokens by weight, at most `most` times a source's size; what is above is shared again."""
    target, free, rest = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        unit = rest / sum(weights[i] for i in sorted(free))
        above = [i for i in sorted(free) if weights[i] * unit > most * sizes[i]]
        for i in above or free:
            target[i] = float(most * sizes[i]) if above else weights[i] * unit
        if not above:
            break
        rest -= sum(target[i] for i in above)
        free -= set(above)
    return target


def sainte_lague(weights: list[float], seats: int) -> list[int]:
    """Seats by highest quotients weight / 1, / 3, / 5, ...; of equal quotients the first source's counts as higher."""
    w = np.asarray(weights, float)
    if not seats or not w.sum():
        return [0] * len(w)
    low, high = 0.0, 2 * w.max() * len(w) + 1  # a small divisor gives too many seats, a large one too few
    for _ in range(200):
        middle = (low + high) / 2
        if np.floor(w / middle + 0.5).sum() > seats:
            low = middle
        else:
            high = middle
    got = np.floor(w / high + 0.5).astype(np.int64)
    while got.sum() < seats:  # ties at the divisor
        got[np.argmax(w / (2 * got + 1))] += 1
    return got.tolist()


def source_key(column):
    """Sources as strings that keep null apart."""
    return F.when(column.isNull(), F.lit("")).otherwise(F.concat(F.lit("s"), column.cast("string")))


def by_divisor(shards: DataFrame, seats: DataFrame, most: int = MOST, seed: int = SEED, rounds: int = 8, grid: int = 24) -> DataFrame:
    """Column seats for shards (source, shard, blocks) such that those of a source add up to its own, by Sainte-Laguë with at
    most `most` seats a block. For every source the divisor is bracketed, and each round one aggregation tries a grid of
    divisors for all. Seats that tie at the divisor go to the highest quotients, of equal ones by a seeded order."""
    spark = shards.sparkSession
    n_shards = {r["source"]: r["n"] for r in shards.where("blocks > 0").groupBy("source").agg(F.count("*").alias("n")).collect()}
    table = {r["source"]: (r["seats"], r["blocks"]) for r in seats.collect()}
    # at the low end no source gets too few seats (rounding costs a shard half a seat at most), at the high end none too many
    bracket = {s: (b / (n + n_shards[s] / 2 + 1), 2.0 * b / n) if n else (1e300, 1e300) for s, (n, b) in table.items()}
    rest: dict[str, int] = {}

    def won(divisor):
        return F.least(F.floor(F.col("blocks") / divisor + 0.5), F.lit(most) * F.col("blocks"))

    for _ in range(rounds):
        tries = {s: np.geomspace(lo, hi, grid).tolist() for s, (lo, hi) in bracket.items()}
        tried = spark.createDataFrame([(s, *d) for s, d in tries.items()] or [("", *[1.0] * grid)],
                                      "source string, " + ", ".join(f"d{i} double" for i in range(grid)))
        got = shards.join(F.broadcast(tried), "source").groupBy("source").agg(
            *(F.sum(won(F.col(f"d{i}"))).alias(f"d{i}") for i in range(grid))).collect()
        for r in got:
            s, n = r["source"], table[r["source"]][0]
            if n:
                fits = next(i for i in range(grid) if r[f"d{i}"] <= n)
                bracket[s], rest[s] = (tries[s][max(0, fits - 1)], tries[s][fits]), n - r[f"d{fits}"]
        if not any(rest.values()):
            break
    ends = spark.createDataFrame([(s, lo, hi, rest.get(s, 0)) for s, (lo, hi) in bracket.items()] or [("", 1.0, 1.0, 0)],
                                 "source string, low double, high double, rest long")
    held = shards.join(F.broadcast(ends), "source").withColumn("seats", won(F.col("high"))).withColumn("more", won(F.col("low")) - F.col("seats"))
    if not any(rest.values()):
        return held.drop("low", "high", "rest", "more")
    # ranks of the seats between both ends, by counts of quotients and parts of the seeded order, so that no task ranks a whole source
    near = held.where("rest > 0 and more > 0").select("source", "shard", "rest", F.explode(F.transform(
        F.sequence(F.lit(1), F.col("more")), lambda i: F.col("blocks") / (2 * (F.col("seats") + i) - 1))).alias("quotient"))
    near = near.withColumn("own", F.xxhash64("source", "shard", F.lit(seed))).withColumn("part", F.shiftrightunsigned("own", 52))
    group = ["source", "quotient", "part"]
    order = Window.partitionBy("source").orderBy(F.desc("quotient"), "part").rowsBetween(Window.unboundedPreceding, -1)
    before = near.groupBy(*group).agg(F.count("*").alias("n")).select(*group, F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    place = F.col("before") + F.row_number().over(Window.partitionBy(*group).orderBy("own", "shard"))
    tied = near.join(before, group).withColumn("place", place).where("place <= rest").groupBy("source", "shard").agg(F.count("*").alias("tied"))
    return held.join(tied, ["source", "shard"], "left").withColumn("seats", F.col("seats") + F.coalesce("tied", F.lit(0))).drop(
        "low", "high", "rest", "more", "tied")


def chosen(blocks: int, seats: int, seed: int) -> np.ndarray:
    """How often each block of a shard is taken."""
    times = np.full(blocks, seats // blocks, np.int64)
    rank = common.mix(np.arange(blocks, dtype=np.uint64) + np.uint64(seed))
    times[np.argsort(rank, kind="stable")[:seats % blocks]] += 1
    return times


def place_of(id_col: str, text_col: str, seed: int):
    """Where a row stands in its source: rows of one id, or without one, are spread by their texts."""
    return F.xxhash64(common.id_or_last(id_col), F.col(text_col).cast("string"), F.lit(seed))


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST, block_tokens: int = BLOCK, shard_tokens: int = SHARD,
        seed: int = SEED, max_sources: int = MAX_SOURCES, with_text: bool = False, id_col: str = "doc_id",
        text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: key, size, source_size, target, taken. With with_text instead the mixed corpus: rows key, source, text
    and the columns keep, one for each time that words of a document are taken, with those words' text."""
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    docs = docs.select(common.id_or_last(id_col).alias("key"), source_key(F.col(source_col)).alias("source"),
                       size.alias("size"), place_of(id_col, text_col, seed).alias("own"), *([F.col(text_col).cast("binary").alias("text")] if with_text else []),
                       *(F.col(c).alias(f"keep_{c}") for c in (keep if with_text else ())))
    spark = docs.sparkSession
    totals = {r["source"]: r["n"] for r in docs.groupBy("source").agg(F.sum("size").alias("n")).limit(max_sources + 1).collect()}
    if len(totals) > max_sources:
        raise ValueError(f"more than {max_sources} sources; raise max_sources")
    names = sorted(totals, key=lambda s: (s == "", s))
    sizes = [totals[s] for s in names]
    target = targets(sizes, [float(weights[i % len(weights)]) for i in range(len(names))], most)
    info = F.broadcast(spark.createDataFrame(
        [(s, n, t, max(1, -(-n // shard_tokens))) for s, n, t in zip(names, sizes, target)],
        "source string, source_size long, target double, shards long"))
    dealt = docs.join(info, "source").withColumn("shard", F.pmod("own", F.col("shards")))
    shards = common.cut(dealt.groupBy("source", "shard").agg(F.sum("size").alias("tokens")).withColumn(
        "blocks", F.when(F.col("tokens") > 0, F.greatest(F.lit(1), F.round(F.col("tokens") / block_tokens))).otherwise(0).cast("long")))
    blocks = {r["source"]: r["n"] for r in shards.groupBy("source").agg(F.sum("blocks").alias("n")).collect()}
    worth = [t / n * blocks.get(s, 0) if n else 0.0 for s, n, t in zip(names, sizes, target)]
    quota = sainte_lague(worth, round(sum(worth)))
    seats = spark.createDataFrame([(s, min(q, most * blocks.get(s, 0)), blocks.get(s, 0)) for s, q in zip(names, quota)],
                                  "source string, seats long, blocks long")
    quotas = by_divisor(shards, seats, most, seed).select(F.col("source").alias("s"), F.col("shard").alias("h"), "tokens", "blocks", "seats")
    held = dealt.join(quotas, (F.col("source") == F.col("s")) & (F.col("shard") == F.col("h"))).drop("s", "h")
    wide = [(f.name, f.dataType.simpleString()) for f in docs.schema if f.name.startswith("keep_")]

    def select(t: pa.Table) -> pa.Table:
        common.cache("mixing")
        key, length = t["key"].to_numpy(), t["size"].to_numpy()
        own = common.mix(t["own"].to_numpy().view(np.uint64))
        order = np.lexsort((length, key, own))
        end = np.cumsum(length[order])
        tokens, n, seats = (t[c][0].as_py() for c in ("tokens", "blocks", "seats"))
        name = int(np.bitwise_xor.reduce(common.mix(np.frombuffer(t["source"][0].as_py().encode() or b"\0", np.uint8).astype(np.uint64) + np.arange(1, 1 + max(1, len(t["source"][0].as_py().encode())), dtype=np.uint64) * np.uint64(256))))
        times = chosen(n, seats, (name ^ t["shard"][0].as_py() * 0x9E3779B9 ^ seed) & ((1 << 64) - 1)) if n else np.zeros(0, np.int64)
        edge = np.arange(n + 1, dtype=np.int64) * tokens // max(n, 1)
        upto = np.concatenate([[0], np.cumsum(times * np.diff(edge))])
        at = lambda x: upto[b := np.clip(np.searchsorted(edge, x, side="right") - 1, 0, max(n - 1, 0))] + (x - edge[b]) * (times[b] if n else 0)
        if not with_text:
            taken = np.zeros(len(key), np.int64)
            taken[order] = at(end) - at(end - length[order])
            return t.select(["key", "size", "source_size", "target"]).append_column("taken", pa.array(taken, pa.int64()))
        rows, pieces = [], []
        texts = common.texts_of(t["text"])
        for i, stop in zip(order.tolist(), end.tolist()):
            begin = stop - int(length[i])
            if begin == stop:
                continue
            cover = np.repeat(times, np.diff(edge))[begin:stop] if n == 1 else times[np.searchsorted(edge, np.arange(begin, stop), side="right") - 1]
            if not cover.any():
                continue
            w = common.Words([texts[i]])
            for copy in range(1, int(cover.max()) + 1):
                have = np.concatenate([[False], cover >= copy, [False]])
                change = np.flatnonzero(have[1:] != have[:-1])
                rows.append(i)
                pieces.append("\n".join(w.buf[w.start[a]:w.end[b - 1]].tobytes().decode("utf-8", "replace")
                                        for a, b in zip(change[0::2], change[1::2])))
        out = t.select(["key", "source", *(f for f, _ in wide)]).take(pa.array(rows, pa.int64()))
        return out.append_column("text", pa.array(pieces, pa.string()))

    if with_text:
        out = held.groupBy("source", "shard").applyInArrow(select, ", ".join(
            ["key long", "source string", *(f"{f} {d}" for f, d in wide), "text string"]))
        return out.select("key", F.when(F.col("source") != "", F.substring("source", 2, 1 << 30)).alias("source"), "text",
                          *(F.col(f"keep_{c}").alias(c) for c in keep))
    return held.groupBy("source", "shard").applyInArrow(
        select, "key long, size long, source_size long, target double, taken long")


def query(spark, sf_dir: str) -> DataFrame:
    out = mix(common.table(spark, sf_dir, "documents"))
    return out.select(common.id_or_null("key").alias("doc_id"), "size", "source_size", "target", "taken")
