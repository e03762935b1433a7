"""Control-plane rules over small tables (T07-T09, P23, P27, Z07-Z10, A22-A33, G06-G09): due sources, queues, budgets, tasks, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.scoring import backoff
from eventloom.operators.analytics import ratio


def due(states: DataFrame, now: Column, limit: int | None = None) -> DataFrame:
    """Enabled sources whose next run is null or past, never run first."""
    out = states.filter(F.col("enabled") & (F.col("next_run_at").isNull() | (F.col("next_run_at") <= now))).orderBy(F.asc_nulls_first("next_run_at"), "provider")
    return out.limit(limit) if limit else out


def job_order(jobs: DataFrame) -> DataFrame:
    return jobs.orderBy("refresh_interval", F.desc("expected_volume"), "provider")


def eligible(queue: DataFrame, run: int) -> DataFrame:
    """Queued tasks that are not leased or cooling down, by priority and age."""
    ok = (F.col("state") == "queued") & (F.coalesce("lease_until", F.lit(-1)) < run) & (F.coalesce("cooldown_until", F.lit(-1)) <= run)
    return queue.filter(ok).orderBy(F.desc("priority"), "created_run", "task")


def enqueue(queue: DataFrame, tasks: DataFrame) -> DataFrame:
    """One task for each kind and target; a repeat raises the priority."""
    both = queue.select("task", "priority", "created_run").unionByName(tasks.select("task", "priority", "created_run"))
    return both.groupBy("task").agg(F.max("priority").alias("priority"), F.min("created_run").alias("created_run"))


def affordable(ordered: DataFrame, pool: float) -> DataFrame:
    """Tasks of a total order whose running cost stays in the pool; one window over a control-plane table."""
    w = Window.partitionBy("pool").orderBy(F.desc("priority"), "task").rowsBetween(Window.unboundedPreceding, 0)
    return ordered.withColumn("spent", F.sum("cost").over(w)).filter(F.col("spent") <= pool)


def retry_at(failed_at: Column, attempt: Column, base: float = 60, most: float = 600) -> Column:
    return F.timestamp_seconds(F.unix_timestamp(failed_at) + backoff(attempt, base, most))


def stale(records: DataFrame, ttl: dict[str, int], now: Column, limit: int = 50) -> DataFrame:
    """Entities past their kind's time to live (hours), oldest first."""
    hours = (F.unix_timestamp(now) - F.unix_timestamp("refreshed_at")) / 3600
    life = F.element_at(F.create_map(*[F.lit(x) for kv in ttl.items() for x in kv]), F.col("kind"))
    return records.withColumn("age", hours).filter(F.col("age") >= life).orderBy(F.desc("age"), "entity").limit(limit)


def feedback(outcomes: DataFrame) -> DataFrame:
    """Conditional ratios of predictions and outcomes."""
    ok = F.col("observed").cast("boolean")
    return outcomes.agg(
        F.count(F.lit(1)).alias("n"), ratio(F.count_if(F.col("band").eqNullSafe("auto") & ok), F.count_if(F.col("band") == "auto")).alias("auto_precision"),
        ratio(F.count_if(F.col("rolled_back")), F.count(F.lit(1))).alias("rollback_rate"), F.round(F.avg(F.abs(F.col("predicted") - ok.cast("double"))), 6).alias("mean_error"),
    )


def histogram(df: DataFrame, *keys: str) -> DataFrame:
    """Counts by each key on its own."""
    return df.groupingSets([[k] for k in keys], *keys).agg(F.count(F.lit(1)).alias("n"))


def run_metrics(runs: DataFrame, seconds: Column) -> DataFrame:
    """Throughput a minute, success rate and mean time of a run log."""
    return runs.agg(F.count(F.lit(1)).alias("runs"), ratio(F.count_if("ok"), F.count(F.lit(1))).alias("success_rate"), F.round(F.count(F.lit(1)) * 60 / seconds, 4).alias("per_minute"), F.round(F.avg("ms"), 4).alias("mean_ms"))


def daily_metrics(log: DataFrame) -> DataFrame:
    """Distinct domains, duplicate rate and reasons of a day."""
    return log.groupBy("day").agg(F.countDistinct("domain").alias("domains"), ratio(F.count_if(F.col("outcome") == "duplicate"), F.count(F.lit(1))).alias("duplicate_rate"), F.count_if(F.col("outcome") == "rejected").alias("rejected"))


def top_values(log: DataFrame, column: str, n: int = 5) -> DataFrame:
    """Most frequent values of an array column."""
    return log.select(F.explode(column).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(n)


def expand(sources: DataFrame, targets: DataFrame, on: list[str], kind: str, budget: int = 8) -> DataFrame:
    """Seeds that a dimension suggests for each source, at most `budget` each."""
    w = Window.partitionBy("source").orderBy(F.desc("confidence"), "target")
    return sources.join(targets, on).select("source", "target", F.lit(kind).alias("kind"), "confidence").filter("confidence >= 0.2").withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= budget).drop("rn")


def collapse(seeds: DataFrame) -> DataFrame:
    """One seed for each kind and target: the surest, with the other paths to it."""
    return seeds.groupBy("kind", "target").agg(F.max("confidence").alias("confidence"), F.max_by("source", F.struct("confidence", "source")).alias("source"), F.array_sort(F.collect_set("source")).alias("paths"))


def merge_evidence(e: DataFrame) -> DataFrame:
    """OR, maximum, union and first known of the evidence for a seed."""
    return e.groupBy("seed").agg(F.bool_or("reachable").alias("reachable"), F.max("confidence").alias("confidence"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("cities")))).alias("cities"), F.min_by("organizer", F.when(F.col("organizer").isNotNull(), F.col("ord"))).alias("organizer"))


def attendance(log: DataFrame, catalog: DataFrame, today: Column) -> DataFrame:
    """Last status of each user and record; registered for a past one is missed."""
    last = log.filter(F.col("type").isin("register", "attend")).groupBy("user_id", F.col("event_key").alias("key")).agg(F.max_by("type", F.struct("at", "type")).alias("last"))
    ended = F.coalesce("end_date", "start_date") < today
    return last.join(catalog.select("key", "start_date", "end_date"), "key").select("user_id", "key", F.when(F.col("last") == "attend", "attended").when(ended, "missed").otherwise("registered").alias("status"))


def steady(cycles: DataFrame, n: int = 3) -> DataFrame:
    """Whether a growth run has made no progress in its last n cycles."""
    w = Window.partitionBy("run").orderBy("cycle").rowsBetween(1 - n, 0)
    return cycles.select("run", "cycle", ((F.max("progress").over(w) == 0) & (F.count(F.lit(1)).over(w) == n)).alias("steady"))


def opportunities(known: DataFrame, universe: DataFrame, kind: str) -> DataFrame:
    """What the universe holds and the catalog does not."""
    return universe.join(known, "name", "left_anti").select(F.lit(kind).alias("kind"), "name")


def next_date(dates: DataFrame) -> DataFrame:
    """Last date plus the median positive gap of each series."""
    w = Window.partitionBy("id").orderBy("d")
    g = dates.select("id", "d", F.datediff("d", F.lag("d").over(w)).alias("gap")).groupBy("id").agg(F.max("d").alias("last"), F.percentile(F.when(F.col("gap") > 0, F.col("gap")), 0.5).alias("period"))
    return g.select("id", "last", F.date_add("last", F.round("period").cast("int")).alias("next"))
