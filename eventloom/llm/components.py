"""Connected components of a distributed edge table (alternating large and small stars).

Edges are first contracted inside each task by union-find, which shortens long chains; what is
left is contracted in one task if it has at most LOCAL_EDGES edges, else the star rounds shuffle it. Nothing of the graph comes to the driver but one
row of counters a round."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import prepare, stage, unstage

#: Edges that one union-find holds at a time; a task with more contracts them in turns.
LOCAL_EDGES = 200_000


def _stars(edges: list[tuple]) -> list[tuple]:
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return [(x, r) for x in parent if (r := root(x)) != x]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def out(pairs):
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], names=["u", "v"])

    for b in batches:
        held += zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
        if len(held) > LOCAL_EDGES:
            held = _stars(held)
            if len(held) > LOCAL_EDGES // 2:
                yield out(held)
                held = []
    yield out(_stars(held))


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1000003)).first())


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v (longs). Returns node, root: every node of an edge but the roots, once, with the smallest node reachable."""
    prepare(edges.sparkSession)
    e = stage(edges.filter("u <> v").mapInArrow(_contract, "u long, v long").distinct(), "stars")
    before = _mark(e)
    if before[0] <= LOCAL_EDGES:  # few enough for one union-find to hold
        return e.coalesce(1).mapInArrow(_contract, "u long, v long").select(F.col("u").alias("node"), F.col("v").alias("root"))
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        joined = down.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        old, e = e, stage(small, "stars")
        unstage(old)
        now = _mark(e)
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
