"""Greedy admission over logs of requests: domain guards, spacing of calls, caches with a time to live.

A request of a key is admitted if the last *admitted* one of its key is at least an interval ago; refused ones do
not count (Z06). A cache works by the same rule: a request is a miss, and stores, if what an earlier miss has stored is
as old as its time to live (R28).

Each admission depends on the one before, yet a hot key is not one task's work. The times of a key are cut into
blocks of BLOCK intervals. What a block does is a step function: from the earliest time at which its key may admit
again, to the last time admitted in the block. It has few steps, since chains of admissions that start apart soon meet. A
pass over the blocks' steps alone, in order of time, finds with what each block begins; then all blocks are folded
for themselves. Only steps meet by key, as a sorted stream that needs no memory."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventloom.session import ship
from eventloom.staging import staged

#: Intervals of a block.
BLOCK = 64
_NEVER, _ALWAYS = np.iinfo(np.int64).max, np.iinfo(np.int64).min


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows (key, block, ...) in tables of whole blocks, with where each block begins."""
    carry = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = (t if carry is None else pa.concat_tables([carry, t])).combine_chunks()
        begin = _begins(t)
        carry = t.slice(int(begin[-1])) if len(begin) else None
        if len(begin) > 1:
            yield t.slice(0, int(begin[-1])), begin[:-1]
    if carry is not None and carry.num_rows:
        yield carry, np.zeros(1, np.int64)


def _begins(t: pa.Table) -> np.ndarray:
    new = np.ones(t.num_rows, bool)
    if t.num_rows > 1:
        key, block = t.column("key").combine_chunks(), t.column("block").to_numpy()
        new[1:] = pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False) | (block[1:] != block[:-1])
    return np.flatnonzero(new)


def _next(t: pa.Table, begin: np.ndarray, gap: int, width: int) -> tuple[np.ndarray, ...]:
    """Of distinct times by block: times in the block, block numbers, one number for both, and the next time that may be admitted (its place, or that of the block's end)."""
    at = t.column("at").to_numpy()
    of = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(at))))
    rel = at - t.column("block").to_numpy() * width
    one = of * (width + 1) + rel
    return rel, of, one, np.searchsorted(one, of * (width + 1) + np.minimum(rel + gap, width))


def _steps(batches: Iterator[pa.RecordBatch], gap: int, width: int) -> Iterator[pa.RecordBatch]:
    """key, block, upto, last: entered with an earliest time of at most upto, the block's last admission is at last (null: none)."""
    for t, begin in _whole(batches):
        rel, of, _, nxt = _next(t, begin, gap, width)
        at, end = t.column("at").to_numpy(), np.append(begin[1:], len(rel))
        last = np.where(nxt < end[of], nxt, np.arange(len(rel)))
        while not np.array_equal(further := last[last], last):
            last = further
        first = np.zeros(len(rel), bool)
        first[begin] = True
        before = np.concatenate([[0], rel[:-1]])
        entry = np.flatnonzero(first | (before < rel[begin][of] + gap))
        final = np.ones(len(entry), bool)  # of entries that end alike, the last one
        final[:-1] = (of[entry][1:] != of[entry][:-1]) | (last[entry][1:] != last[entry][:-1])
        entry = entry[final]
        rows = np.concatenate([entry, begin])
        upto = np.concatenate([at[entry], np.full(len(begin), _NEVER)])
        ends = pa.array(at[last[rows]], mask=np.arange(len(rows)) >= len(entry))
        yield pa.RecordBatch.from_arrays([t.column("key").combine_chunks().take(pa.array(rows)), t.column("block").combine_chunks().take(pa.array(rows)), pa.array(upto), ends], names=["key", "block", "upto", "last"])


def _chain(batches: Iterator[pa.RecordBatch], gap: int) -> Iterator[pa.RecordBatch]:
    """key, block, free: the earliest time of admission as each block begins. Steps are sorted by key, block, upto."""
    key, block, free, after, done = object(), None, _ALWAYS, _ALWAYS, True
    for b in batches:
        out = []
        for k, n, upto, last in zip(*(b.column(c).to_pylist() for c in ("key", "block", "upto", "last")), strict=True):
            if k != key:
                key, block, after = k, None, int(_ALWAYS)
            if n != block:
                block, free, done = n, after, False
                out.append((k, n, free))
            if not done and free <= upto:
                done, after = True, free if last is None else last + gap
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), (b.schema.field("key").type, pa.int64(), pa.int64()), strict=True)], names=["key", "block", "free"])


def _fold(batches: Iterator[pa.RecordBatch], gap: int, width: int) -> Iterator[pa.RecordBatch]:
    """key, at, admitted, since (the admission that holds at that time), first (the key's first admission)."""
    for t, begin in _whole(batches):
        rel, of, one, nxt = _next(t, begin, gap, width)
        at, free = t.column("at").to_numpy(), t.column("free").to_numpy()
        end = np.append(begin[1:], len(rel))
        start = t.column("block").to_numpy()[begin] * width
        enter = np.where(free[begin] < start, 0, np.minimum(free[begin] - start, width))
        place = np.searchsorted(one, np.arange(len(begin)) * (width + 1) + enter)
        let, block = np.zeros(len(rel), bool), np.arange(len(begin))
        while len(place):
            inside = place < end[block]
            place, block = place[inside], block[inside]
            let[place] = True
            place = nxt[place]
        held = np.maximum.accumulate(np.where(let, np.arange(len(rel)), -1))
        own = held >= begin[of]
        since = np.where(own, at[held], free - gap)  # from a block before
        first = np.zeros(len(rel), bool)
        first[begin] = free[begin] == _ALWAYS  # nothing came before: the first time is admitted
        yield pa.RecordBatch.from_arrays([t.column("key").combine_chunks(), pa.array(at), pa.array(let), pa.array(since), pa.array(first)], names=["key", "at", "admitted", "since", "first"])


def _admissions(requests: DataFrame, per: list[str], at: Column, seconds: float, order: tuple[str, ...]) -> DataFrame:
    """requests with admitted, since, first."""
    spark = requests.sparkSession
    ship(spark)
    gap = int(round(seconds * 1_000_000))
    known = requests.withColumn("_at", F.unix_micros(at.cast("timestamp"))).withColumn("_key", F.to_json(F.struct(*per)))
    if gap <= 0:
        return known.withColumn("admitted", F.col("_at").isNotNull()).withColumn("since", F.timestamp_micros("_at")).withColumn("first", F.row_number().over(Window.partitionBy("_key").orderBy("_at", *order)) == 1).drop("_at", "_key")
    width, parts = BLOCK * gap, int(spark.conf.get("spark.sql.shuffle.partitions"))
    times = staged(known.filter("_at is not null").select(F.col("_key").alias("key"), F.expr(f"(_at - pmod(_at, {width}l)) div {width}l").alias("block"), F.col("_at").alias("at")).distinct(), "admission-times")
    by_block = lambda df: df.repartition(parts, "key", "block").sortWithinPartitions("key", "block", "at")
    steps = by_block(times).mapInArrow(partial(_steps, gap=gap, width=width), "key string, block long, upto long, last long")
    free = staged(steps.repartition(parts, "key").sortWithinPartitions("key", "block", "upto").mapInArrow(partial(_chain, gap=gap), "key string, block long, free long"), "admission-free")
    folded = by_block(times.join(free, ["key", "block"])).mapInArrow(partial(_fold, gap=gap, width=width), "key string, at long, admitted boolean, since long, first boolean")
    ranked = known.withColumn("_rn", F.row_number().over(Window.partitionBy("_key", "_at").orderBy(*order)))
    out = ranked.join(folded.select(F.col("key").alias("_key"), F.col("at").alias("_at"), F.col("admitted").alias("_let"), "since", F.col("first").alias("_first")), ["_key", "_at"], "left")
    own = F.col("_rn") == 1
    let = {"admitted": F.coalesce(F.col("_let") & own, F.lit(False)), "first": F.coalesce(F.col("_first") & own, F.lit(False)), "since": F.timestamp_micros("since")}
    return out.withColumns(let).drop("_key", "_at", "_let", "_rn", "_first")


def admitted(requests: DataFrame, per: list[str], at: Column, seconds: float, *order: str) -> DataFrame:
    """requests with admitted and since, the time of the admission that holds. Of requests of one time the first by order is
    admitted. A null in per is a key like any other, requests without a time are never admitted; with 0 seconds all are."""
    return _admissions(requests, per, at, seconds, order).drop("first")


def cached(requests: DataFrame, key: list[str], at: Column, ttl_seconds: float, *order: str) -> DataFrame:
    """requests with hit, stored_at (of the entry that answers) and evicts: a miss that finds an expired entry.

    It is an as-of join of requests with what misses store, where whether one is a miss depends on that join."""
    log = _admissions(requests, key, at, ttl_seconds, order)
    return log.withColumns({"hit": ~F.col("admitted") & F.col("since").isNotNull(), "evicts": F.col("admitted") & ~F.coalesce("first", F.lit(False))}).withColumnRenamed("since", "stored_at").drop("admitted", "first")


def spaced(calls: DataFrame, per: list[str], at: Column, seconds: float, *order: str) -> DataFrame:
    """calls with waited, the seconds that a limiter holds each back so that calls of a key go out seconds apart.

    The i-th call of a key goes out at the largest of at_j + (i - j) * gap over the calls j up to i. Largest values and
    counts of time buckets are carried on, so a key's log is sorted bucket by bucket."""
    gap = int(round(seconds * 1_000_000))
    width = max(1, 1024 * gap)
    known = calls.withColumn("_at", F.unix_micros(at.cast("timestamp"))).withColumn("_b", F.expr(f"(_at - pmod(_at, {width}l)) div {width}l"))
    inside = Window.partitionBy(*per, "_b").orderBy("_at", *order)
    known = known.withColumn("_i", F.row_number().over(inside).cast("long")).withColumn("_slack", F.col("_at") - F.col("_i") * gap)
    buckets = known.groupBy(*per, "_b").agg(F.count(F.lit(1)).alias("_n"), F.max("_slack").alias("_most"))
    before = Window.partitionBy(*per).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("_n").over(before), F.lit(0))
    carried = buckets.withColumn("_offset", offset).withColumn("_held", F.max(F.col("_most") - F.col("_offset") * gap).over(before)).select(*[F.col(p).alias(f"_k{i}") for i, p in enumerate(per)], F.col("_b").alias("_kb"), "_offset", "_held")
    same = F.col("_b") == F.col("_kb")
    for i, p in enumerate(per):
        same = same & F.col(p).eqNullSafe(F.col(f"_k{i}"))
    joined = known.join(carried, same)
    running = F.max("_slack").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    out = F.greatest(F.coalesce("_held", F.lit(int(_ALWAYS) // 2)), F.col("_running") - F.col("_offset") * gap) + (F.col("_offset") + F.col("_i")) * gap
    drop = ["_at", "_b", "_i", "_slack", "_offset", "_held", "_running", "_kb", *[f"_k{i}" for i in range(len(per))]]
    return joined.withColumn("_running", running).withColumn("waited", (out - F.col("_at")) / 1_000_000).drop(*drop)
