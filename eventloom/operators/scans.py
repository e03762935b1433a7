"""Ordered folds over logs with few hot keys: positions, running totals, streaks, sliding windows, exact order statistics.

A window by key sorts the whole log of a key in one task. Here a log is range-partitioned by key and order, so that
a hot key spans many partitions; every fold is done inside the partitions, and what a partition hands on to the
next is carried over a table of one row for each key and partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventloom.staging import staged

PART = "_part"


def ranged(df: DataFrame, per: list[str], order: list[str]) -> DataFrame:
    """df with its range partition (_part) by key and order; rows that tie in both stand together."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return staged(df.repartitionByRange(parts, *per, *order).withColumn(PART, F.spark_partition_id()), "ranged")


def _match(per: list[str]) -> tuple[list[Column], Column]:
    """Keys under other names, and that they are the same (nulls, too)."""
    same = F.col(PART) == F.col("_p")
    for i, c in enumerate(per):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return [*[F.col(c).alias(f"_k{i}") for i, c in enumerate(per)], F.col(PART).alias("_p")], same


def running(log: DataFrame, per: list[str], order: list[str], **sums: Column) -> DataFrame:
    """A ranged log with running totals of each key up to and with the row, in order."""
    named, same = _match(per)
    inside = Window.partitionBy(*per, PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*per).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    totals = log.groupBy(*per, PART).agg(*[F.sum(c).alias(f"_sum_{k}") for k, c in sums.items()])
    carried = totals.select(*named, *[F.coalesce(F.sum(f"_sum_{k}").over(before), F.lit(0)).alias(f"_before_{k}") for k in sums])
    joined = log.withColumns({f"_in_{k}": F.sum(c).over(inside) for k, c in sums.items()}).join(carried, same)
    both = {k: F.col(f"_before_{k}") + F.coalesce(f"_in_{k}", F.lit(0)) for k in sums}
    return joined.withColumns(both).drop("_p", *[f"_k{i}" for i in range(len(per))], *[f"_{x}_{k}" for k in sums for x in ("before", "in")])


def numbered(log: DataFrame, per: list[str], order: list[str]) -> DataFrame:
    """A ranged log with position, from 1 in each key."""
    return running(log, per, order, position=F.lit(1).cast("long"))


def streaks(log: DataFrame, per: list[str], order: list[str], ok: str) -> DataFrame:
    """Per key: the failures since the last success, and the most in a row. The log is ranged.

    A partition hands on the failures at its end, or, where it has no success, all its rows and what it was handed."""
    inside = Window.partitionBy(*per, PART).orderBy(*order)
    island = F.sum(F.col(ok).cast("int")).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    failed = F.count_if(~F.col(ok)).alias("failed")
    runs = log.withColumn("_island", island).groupBy(*per, PART, "_island").agg(failed)
    parts = runs.groupBy(*per, PART).agg(F.max("failed").alias("most"), F.max("_island").alias("good"), F.sum("failed").alias("n"), F.max_by("failed", "_island").alias("trail"), F.coalesce(F.max(F.when(F.col("_island") == 0, F.col("failed"))), F.lit(0)).alias("lead"))
    by = Window.partitionBy(*per).orderBy(PART)
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    at = F.sum("n").over(upto)
    ends = F.last(F.when(F.col("good") > 0, F.col("trail") - F.col("at")), ignorenulls=True).over(upto)
    handed = parts.withColumn("at", at).withColumn("streak", F.col("at") + F.coalesce(ends, F.lit(0)))
    worst = F.greatest("most", F.coalesce(F.lag("streak").over(by), F.lit(0)) + F.col("lead"))
    return handed.withColumn("worst", worst).groupBy(*per).agg(F.max_by("streak", PART).alias("streak"), F.max("worst").alias("worst"))


def sliding(log: DataFrame, per: list[str], order: list[str], last: int, **folds: Column) -> DataFrame:
    """log with folds (aggregates) over the last so many rows of its key, the row itself included.

    Rows go to blocks of `last` positions, and once more to the next block as its past."""
    at = numbered(ranged(log, per, order), per, order).withColumn("_block", F.floor((F.col("position") - 1) / last))
    past = at.withColumn("_block", F.col("_block") + 1).withColumn("_past", F.lit(True))
    w = Window.partitionBy(*per, "_block").orderBy("position").rowsBetween(1 - last, 0)
    both = at.withColumn("_past", F.lit(False)).unionByName(past)
    return both.withColumns({k: c.over(w) for k, c in folds.items()}).filter("not _past").drop("_past", "_block", "position", PART)


def percentiles(df: DataFrame, by: str, value: str, points: list[float]) -> DataFrame:
    """Per key, nearest-rank percentiles at round-half-even(p * (n - 1)) as p50, p95 and so on; nulls do not count.

    Counts of the range partitions tell in which of them a rank lies; only those are sorted."""
    log = ranged(df.filter(F.col(value).isNotNull()).select(by, value), [by], [value])
    counts = log.groupBy(by, PART).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(by)
    before = F.coalesce(F.sum("_n").over(w.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = F.array(*[F.struct(F.lit(f"p{round(p * 100)}").alias("name"), F.bround(F.lit(p) * (F.col("_all") - 1), 0).cast("long").alias("rank")) for p in points])
    known = counts.withColumn("_before", before).withColumn("_all", F.sum("_n").over(w)).withColumn("_want", F.explode(rank))
    wanted = known.filter("_want.rank >= _before and _want.rank < _before + _n").select(F.col(by).alias("_by"), F.col(PART).alias("_p"), F.col("_want.name").alias("_name"), (F.col("_want.rank") - F.col("_before") + 1).alias("_i"))
    parts = wanted.select("_by", "_p").distinct()
    here = log.join(parts, F.col(by).eqNullSafe(F.col("_by")) & (F.col(PART) == F.col("_p")), "left_semi")
    sorted_ = here.withColumn("_rn", F.row_number().over(Window.partitionBy(by, PART).orderBy(value)))
    hit = sorted_.join(wanted, F.col(by).eqNullSafe(F.col("_by")) & (F.col(PART) == F.col("_p")) & (F.col("_rn") == F.col("_i")))
    return hit.groupBy(by).agg(*[F.max(F.when(F.col("_name") == f"p{round(p * 100)}", F.col(value))).alias(f"p{round(p * 100)}") for p in points])
