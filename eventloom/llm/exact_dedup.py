"""Exact dedup by content sort.

Rows are range-partitioned by sampled splitters over their normalised text and sorted
(Spark's external sort), so equal texts stand next to each other; neighbours are then
compared in full and every run of equal texts is a group.

The splitters are drawn over (first bytes, hash, doc_id), not over whole texts: the sample
that Spark takes to the driver is then bounded in bytes, and a text that a third of all rows
share is still dealt over many partitions, since doc_id takes part. The runs that a
partition boundary cuts are joined again by a full comparison of the last text of one
partition with the first text of the next.

Defined results: a null text is the empty text; null doc_ids sort lowest and count as rows;
repeated rows are separate members of a group (the first of several rows with the largest
doc_id stays kept=true for all rows that carry that doc_id); an empty table gives no rows.
Input columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.llm.common import prepare, stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters of a text that take part in the splitters; longer common beginnings are split by hash.
PREFIX = 32
RUN_SHIFT = 33

_OUT = pa.schema([("doc_id", pa.int64()), ("text_sha256", pa.string()), ("part", pa.int32()), ("run", pa.int64()), ("edge", pa.int8()), ("edge_text", pa.string())])
_DDL = "doc_id long, text_sha256 string, part int, run long, edge byte, edge_text string"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the runs of equal neighbouring texts of a sorted partition. edge: 1 first row, 2 last row, with its text."""
    run, last, part, tail = 0, None, 0, None
    for b in batches:
        if not b.num_rows:
            continue
        norm, n = b.column("norm"), b.num_rows
        new = np.ones(n, bool)
        if n > 1:
            new[1:] = pc.not_equal(norm.slice(1), norm.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        first = last is None
        new[0] = not first and norm[0].as_py() != last
        number = run + np.cumsum(new)
        run, last, part = int(number[-1]), norm[n - 1].as_py(), b.column("part")[0].as_py()
        edge, text = [None] * n, [None] * n
        if first:
            edge[0], text[0] = 1, norm[0].as_py()
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_sha256"), b.column("part"), pa.array(number, pa.int64()), pa.array(edge, pa.int8()), pa.array(text, pa.string())], schema=_OUT)
        tail = (part, run, last)
    if tail:  # a row of its own, without a document
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.string()), pa.array([tail[0]], pa.int32()), pa.array([tail[1]], pa.int64()), pa.array([2], pa.int8()), pa.array([tail[2]], pa.string())], schema=_OUT)


def _ordered(docs: DataFrame, *more: Column) -> DataFrame:
    """Rows dealt by content and sorted: equal texts are neighbours, by rising doc_id."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    norm = docs.select(*more, docs["doc_id"].cast("long").alias("doc_id"), F.translate(F.coalesce(docs["text"], F.lit("")), UPPER, LOWER).alias("norm"))
    # Two hashes, so that different texts of one beginning do not alternate in the order of doc_id.
    keyed = norm.withColumns({"lead": F.substring("norm", 1, PREFIX), "mark": F.xxhash64("norm"), "other": F.xxhash64(F.lit(PREFIX), "norm")})
    return keyed.repartitionByRange(n, "lead", "mark", "other", "doc_id").sortWithinPartitions("lead", "mark", "other", "norm", "doc_id")


def _followed(spark, parts: list[int], edges: DataFrame) -> set[int]:
    """Partitions whose first text is the last one of the partition before: a full comparison of one pair a border.

    parts, in order, has a number for each partition with rows; edges: part, edge (1 first, 2 last), edge_text."""
    if len(parts) < 2:
        return set()
    follows = spark.createDataFrame([(b, a) for a, b in zip(parts, parts[1:])], "part int, prev int")
    heads = edges.filter("edge = 1").select("part", F.col("edge_text").alias("head"))
    tails = edges.filter("edge = 2").select(F.col("part").alias("prev"), F.col("edge_text").alias("tail"))
    return {r.part for r in follows.join(heads, "part").join(tails, "prev").filter("head = tail").select("part").collect()}


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, text_sha256, group (long): rows of equal normalised text share a group."""
    spark = docs.sparkSession
    prepare(spark)
    rows = _ordered(docs).select("doc_id", "norm", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), F.spark_partition_id().alias("part"))
    numbered = stage(rows.mapInArrow(_runs, _DDL), "exact-runs")

    # Bounded by the number of partitions, not by the table: one row for each, without texts.
    last_run = {r.part: r.run for r in numbered.filter("edge = 2").select("part", "run").collect()}
    parts = sorted(last_run)
    joined: dict[int, int] = {}
    same = _followed(spark, parts, numbered)
    if same:
        owner = {p: (p << RUN_SHIFT) + last_run[p] for p in parts}
        for a, b in zip(parts, parts[1:]):
            if b in same:
                joined[b] = owner[a]
                if last_run[b] == 0:
                    owner[b] = owner[a]
    own = F.shiftleft(F.col("part").cast("long"), RUN_SHIFT) + F.col("run")
    docs_only = numbered.filter("edge is null or edge = 1").select("doc_id", "text_sha256", "part", "run", own.alias("own"))
    if not joined:
        return docs_only.select("doc_id", "text_sha256", F.col("own").alias("group"))
    fixes = spark.createDataFrame(sorted(joined.items()), "part int, to long").withColumn("run", F.lit(0).cast("long"))
    return docs_only.join(F.broadcast(fixes), ["part", "run"], "left").select("doc_id", "text_sha256", F.coalesce("to", "own").alias("group"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256. The largest doc_id of equal texts stays.

    The sizes are summed per task before the shuffle, and the join back has one small row a
    group, which AQE splits where a group is hot."""
    g = groups(docs)
    per = g.groupBy("group").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return g.join(per, "group").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def _last_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last row of each run of equal texts of a sorted partition; the partition's own last row has edge 2 and its text."""
    held: pa.Table | None = None

    def out(t: pa.Table, edge: int | None, text: bool) -> Iterator[pa.RecordBatch]:
        n = t.num_rows
        cols = [t.column("row"), t.column("part"), pa.array([edge] * n, pa.int8()), t.column("norm") if text else pa.nulls(n, pa.string())]
        yield from pa.table(cols, names=["row", "part", "edge", "edge_text"]).to_batches()

    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        if held is None:
            head = t.slice(0, 1)
            yield from pa.table([pa.nulls(1, t.schema.field("row").type), head.column("part"), pa.array([1], pa.int8()), head.column("norm")], names=["row", "part", "edge", "edge_text"]).to_batches()
        else:
            t = pa.concat_tables([held, t])
        held = t.slice(t.num_rows - 1)
        if t.num_rows > 1:
            norm = t.column("norm").combine_chunks()
            yield from out(t.slice(0, t.num_rows - 1).filter(pc.not_equal(norm.slice(0, len(norm) - 1), norm.slice(1))), None, False)
    if held is not None:
        yield from out(held, 2, True)


def exact_filter(docs: DataFrame) -> DataFrame:
    """The rows that stay, one of each group of equal texts, with all their columns: one shuffle, no join of texts.

    Sorted by rising doc_id, the row to keep is the last of its run; the last row of a partition goes
    where the next partition goes on with its text. Of repeated rows with one doc_id, one stays."""
    spark = docs.sparkSession
    prepare(spark)
    rows = _ordered(docs, F.struct(*[docs[c] for c in docs.columns]).alias("row")).select("row", "norm", F.spark_partition_id().alias("part"))
    ddl = T.StructType([T.StructField("row", T.StructType(docs.schema.fields)), T.StructField("part", T.IntegerType()), T.StructField("edge", T.ByteType()), T.StructField("edge_text", T.StringType())])
    last = stage(rows.mapInArrow(_last_rows, ddl), "exact-last")
    parts = sorted(r.part for r in last.filter("edge = 2").select("part").collect())
    same = _followed(spark, parts, last)
    gone = [a for a, b in zip(parts, parts[1:]) if b in same]
    kept = last.filter(F.coalesce(F.col("edge") != 1, F.lit(True)))
    if gone:
        kept = kept.join(F.broadcast(spark.createDataFrame([(p, 2) for p in gone], "part int, edge byte")), ["part", "edge"], "left_anti")
    return kept.select("row.*")


ORACLE = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
g AS (SELECT doc_id, norm, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""
