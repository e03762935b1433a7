"""Access to the catalog, merges of small stores, and the rules that keep sources running, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.operators import scans
from eventloom.staging import staged


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """Adds n, the place in the order from 0 on. Rows are range-partitioned; only one count a partition passes the driver."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = staged(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "numbered")
    counts = sorted((r["_part"], r["count"]) for r in dealt.groupBy("_part").count().collect())
    starts, total = [], 0
    for part, n in counts:
        starts.append((part, total))
        total += n
    offset = F.broadcast(spark.createDataFrame(starts or [(0, 0)], "_part int, _from long"))
    w = Window.partitionBy("_part").orderBy(*order)
    return dealt.join(offset, "_part").withColumn("n", F.col("_from") + F.row_number().over(w) - 1).drop("_part", "_from")


def scan(catalog: DataFrame, size: int = 500) -> DataFrame:
    """The catalog in key order, with the number of the batch that a reader of `size` rows at a time gets a row in."""
    return numbered(catalog, "key").withColumn("batch", F.floor(F.col("n") / size)).drop("n")


def get_many(catalog: DataFrame, keys: DataFrame) -> DataFrame:
    """Stored rows of the wanted keys (key, ord), in the order asked for; missing ones drop out."""
    return keys.join(catalog, "key").orderBy("ord", "key")


def inbox_upsert(inbox: DataFrame, batch: DataFrame) -> DataFrame:
    """Candidates after a batch: first_seen stays, the version counts up, and a status that somebody has moved on is kept."""
    o, b = inbox.alias("o"), batch.alias("b")
    both = o.join(b, F.col("o.key") == F.col("b.key"), "full")
    was, comes = F.col("o.key").isNotNull(), F.col("b.key").isNotNull()
    keep = was & (F.col("o.status") != "new")
    pick = lambda c: F.when(comes, F.col(f"b.{c}")).otherwise(F.col(f"o.{c}"))
    return both.select(
        F.coalesce("o.key", "b.key").alias("key"), pick("url").alias("url"), F.coalesce("o.first_seen", "b.first_seen").alias("first_seen"), pick("last_seen").alias("last_seen"),
        F.when(was & comes, F.col("o.version") + 1).otherwise(F.coalesce("o.version", F.lit(1))).alias("version"), F.when(keep, F.col("o.status")).otherwise(pick("status")).alias("status"),
    )


def merge_detections(first: DataFrame, second: DataFrame) -> DataFrame:
    """Detections (page, type, url, confidence) of two detectors, one for each type and url, the first detector's before the second's."""
    both = first.withColumn("rank", F.lit(0)).unionByName(second.withColumn("rank", F.lit(1)))
    w = Window.partitionBy("page", "type", "url").orderBy("rank", F.desc("confidence"))
    return both.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn", "rank")


def merge_profile_fields(fields: DataFrame) -> DataFrame:
    """id, field, value, confidence from versions in order `ord`: a later known value takes over only if it is surer."""
    known = fields.filter("value is not null")
    return known.groupBy("id", "field").agg(F.min_by(F.struct("value", "confidence"), F.struct(-F.col("confidence"), F.col("ord"))).alias("x")).select("id", "field", "x.value", "x.confidence")


def prioritized(queries: DataFrame, retired: DataFrame, terms: list[str]) -> DataFrame:
    """Queries (ord, query) that are not retired, those with a gap's term first, else in their order."""
    gap = F.lit(False)
    for t in terms:
        gap = gap | F.contains(F.lower("query"), F.lit(t.lower()))
    return queries.join(retired.select("query").distinct(), "query", "left_anti").withColumn("later", (~gap).cast("int")).orderBy("later", "ord").drop("later")


def plan_stage(stages: DataFrame, pool: DataFrame, now: Column) -> DataFrame:
    """Of each cycle, the stage to run next, with its score and what it is granted (T14): of the eligible and affordable ones
    that of the highest score, the first on ties.

    stages: cycle, ord, stage, enabled, paused, cooldown_until, status, trigger (schedule, backlog, both), manual,
    last_run, next_run, retries, retry_max, priority, backlog, degraded, budgets (map of kind to what a run asks for).
    pool: cycle, kind, limit, consumed. A kind that the pool lacks has nothing left, but costs no score.

    A stage is affordable if all its kinds have something left; each kind of which less than half is left costs up to
    one point. Of a kind with less than a quarter left, half is granted; never more than is left."""
    asked = stages.select("cycle", "ord", F.explode_outer("budgets").alias("kind", "ask"))
    left = pool.select("cycle", "kind", F.greatest(F.lit(0), F.col("limit") - F.col("consumed")).alias("left"), F.col("limit"))
    part = F.coalesce(F.when(F.col("limit") != 0, F.col("left") / F.col("limit")), F.lit(1.0))
    has = asked.join(left, ["cycle", "kind"], "left").withColumn("left", F.coalesce("left", F.lit(0))).withColumn("part", part)
    ask = F.when(F.col("part") < 0.25, F.greatest(F.lit(1), F.ceil(F.col("ask") * 0.5))).otherwise(F.col("ask"))
    granted = F.when(F.col("kind").isNotNull(), F.struct("kind", F.least(ask, "left").cast("long").alias("n")))
    money = has.groupBy("cycle", "ord").agg(
        F.bool_and(F.col("kind").isNull() | (F.col("left") > 0)).alias("affordable"),
        F.sum(F.when(F.col("kind").isNotNull() & (F.col("part") < 0.5), (0.5 - F.col("part")) * 2.0).otherwise(0.0)).alias("penalty"),
        F.map_from_entries(F.array_compact(F.array_sort(F.collect_list(granted)))).alias("granted"),
    )
    resting = F.coalesce(F.col("cooldown_until") > now, F.lit(False)) | (F.col("status") == "dead_letter")
    waited = F.col("next_run").isNull() | (F.col("next_run") <= now)
    due = F.when(F.col("status") == "failed", (F.col("retries") < F.col("retry_max")) & waited).otherwise(~F.col("manual") & (waited | F.col("last_run").isNull()))
    wanted = F.when(F.col("trigger") == "schedule", due).when(F.col("trigger") == "backlog", F.col("backlog") > 0).otherwise(due | (F.col("backlog") > 0))
    overdue = F.when(F.col("next_run") < now, F.least(F.lit(2.0), (F.unix_timestamp(now) - F.unix_timestamp("next_run")) / 3600)).otherwise(0.0)
    score = F.col("priority") + F.least(F.lit(3.0), F.col("backlog") * 0.5) + overdue - F.col("penalty") - F.when(F.col("degraded"), 1.5).otherwise(0.0)
    ready = stages.join(money, ["cycle", "ord"]).filter(F.col("enabled") & ~F.col("paused") & ~resting & wanted & F.col("affordable"))
    best = ready.withColumn("score", score).groupBy("cycle").agg(F.max_by(F.struct("stage", "score", "granted"), F.struct("score", -F.col("ord"))).alias("x"))
    return best.select("cycle", "x.stage", F.bround("x.score", 3).alias("score"), "x.granted")


def reciprocal_ranks(hits: DataFrame, per: str, *order) -> DataFrame:
    """Hits with the rank within their query from 0 on and the score 1 / (rank + 1)."""
    rank = F.row_number().over(Window.partitionBy(per).orderBy(*order)) - 1
    return hits.withColumn("rank", rank).withColumn("score", 1 / (F.col("rank") + 1))


def sliding_latency(runs: DataFrame, per: str, order: str, value: str, last: int = 1000) -> DataFrame:
    """Mean and largest of the last so many values at every run."""
    return scans.sliding(runs.select(per, order, value), [per], [order], last, mean=F.avg(value), most=F.max(value)).drop(value)


def shares(counts: DataFrame, value: str, per: str | None = None) -> DataFrame:
    """Each row's share of its group's total, or of the grand total."""
    if per is None:
        total = counts.agg(F.sum(value).alias("_total"))
        return counts.crossJoin(F.broadcast(total)).withColumn("share", F.round(F.col(value) / F.col("_total"), 6)).drop("_total")
    return counts.withColumn("share", F.round(F.col(value) / F.sum(value).over(Window.partitionBy(per)), 6))


def provider_activity(states: DataFrame, now: Column, hours: int = 48) -> DataFrame:
    """active: the last success is fresh and the circuit is not open."""
    fresh = F.coalesce((F.unix_timestamp(now) - F.unix_timestamp("last_success")) <= hours * 3600, F.lit(False))
    return states.withColumn("active", fresh & (F.col("circuit") != "open"))


def job_order(jobs: DataFrame) -> DataFrame:
    """Shorter refresh interval first, then more expected records."""
    return jobs.orderBy("refresh_minutes", F.desc("expected"), "id")


def page_of(df: DataFrame, size: int, offset: int, *order: str) -> DataFrame:
    """One page by offset."""
    return df.orderBy(*order).offset(offset).limit(size)


def health_snapshot(runs: DataFrame, now: Column, threshold: int = 5) -> DataFrame:
    """Per provider, its health from its run log (P20). runs: provider, run (order), ok, latency_ms, at, quality, duplicates.

    The trend compares the later half of the runs with the earlier one, which is the shorter of an odd number. A failed run without a
    latency counts as a run, but leaves the running mean of latencies as it is: earlier values then weigh more."""
    per, order = ["provider"], ["run"]
    log = scans.ranged(runs, per, order)
    n = log.groupBy(F.col("provider").alias("_of")).agg(F.count(F.lit(1)).alias("total_runs"))
    timed = F.col("ok") | (F.coalesce("latency_ms", F.lit(0.0)) != 0)
    at = scans.numbered(log, per, order).withColumn("stretch", F.when(~timed & (F.col("position") > 1), F.ln(F.col("position") / (F.col("position") - 1))).otherwise(0.0))
    log = scans.running(at, per, order, stretched=F.col("stretch")).join(n, F.col("provider").eqNullSafe(F.col("_of")))
    later = F.col("position") > F.floor(F.col("total_runs") / 2)
    good = F.col("ok").cast("int")
    last_stretch = F.max("stretched").alias("all_stretch")
    g = log.groupBy("provider", "total_runs").agg(
        F.count_if("ok").alias("total_successes"), F.count_if(~F.col("ok")).alias("failures"), F.max(F.when(F.col("ok"), F.col("at"))).alias("last"),
        F.bround(F.avg("quality"), 4).alias("event_quality"), F.bround(F.avg("duplicates"), 4).alias("duplicate_pct"),
        F.avg(F.when(later, good)).alias("b"), F.avg(F.when(~later, good)).alias("a"), last_stretch,
        F.sum(F.when(timed, F.col("latency_ms") * F.exp(-F.col("stretched"))).otherwise(0.0)).alias("weighed"),
    )
    s = scans.streaks(scans.ranged(runs, per, order), per, order, "ok").select(F.col("provider").alias("_of"), F.col("streak").alias("retries"), "worst")
    j = g.join(s, F.col("provider").eqNullSafe(F.col("_of")))
    circuit = F.when(F.col("retries") >= threshold, "open").otherwise("closed")
    health = F.when(F.col("retries") == 0, "healthy").when(F.col("retries") >= threshold, "failing").otherwise("degraded")
    trend = F.when(F.col("b") > F.col("a") + 1e-9, "up").when(F.col("b") < F.col("a") - 1e-9, "down").otherwise("flat")
    hours = F.bround((F.unix_micros(now) - F.unix_micros(F.col("last").cast("timestamp"))) / 3_600_000_000, 3)
    return j.select(
        "provider", health.alias("health_status"), circuit.alias("circuit_state"), F.bround(F.col("total_successes") / F.col("total_runs"), 4).alias("uptime"),
        F.bround(F.col("weighed") * F.exp("all_stretch") / F.col("total_runs"), 2).alias("latency_ms"), hours.alias("freshness_hours"), "event_quality", "duplicate_pct", "failures", "retries", trend.alias("success_trend"), "total_runs", "total_successes",
    )


def rates(df: DataFrame, per: list[str], **parts: tuple[Column, Column]) -> DataFrame:
    """count_if(numerator) / count_if(denominator) to four places, 0 where there is nothing to divide by."""
    agg = [F.when(F.count_if(d) > 0, F.bround(F.count_if(n) / F.count_if(d), 4)).otherwise(0.0).alias(k) for k, (n, d) in parts.items()]
    return (df.groupBy(*per) if per else df).agg(*agg)


def tuning(metrics: DataFrame) -> DataFrame:
    """What auto-tuning would do, per row of duplicate_rate, promotion_rate, efficiency, found (P25)."""
    # The sentences and thresholds are fixed values.
    d, p, e = F.col("duplicate_rate"), F.col("promotion_rate"), F.col("efficiency")
    two = lambda c: F.format_string("%.2f", c)
    said = F.array_compact(F.array(
        F.when(d > 0.5, F.concat(F.lit("throttle expansion (duplicate_rate="), two(d), F.lit(")"))),
        F.when(p > 0.3, F.concat(F.lit("boost search frontier (promotion_rate="), two(p), F.lit(")"))),
        F.when((e < 0.1) & (F.col("found") > 0), F.concat(F.lit("low crawl efficiency ("), two(e), F.lit(") — tighten scope"))),
    ))
    return metrics.withColumn("recommendations", said)


def headlines(parts: list[tuple[str, DataFrame, int]]) -> DataFrame:
    """n, line: the first so many of each list (ord, line), in the order of the lists."""
    out = None
    for k, (lead, rows, most) in enumerate(parts):
        top = rows.orderBy("ord").limit(most).select(F.lit(k).alias("part"), "ord", F.concat(F.lit(lead), "line").alias("line"))
        out = top if out is None else out.unionByName(top)
    return out.orderBy("part", "ord")


def leased(tasks: DataFrame, now: Column, workers: int, attempts: int = 3) -> DataFrame:
    """Tasks with their state: dead after so many attempts, leased while a lease runs, cooling, else ready; of the ready
    ones the first `workers` by priority are taken (Z07)."""
    state = F.when(F.col("attempts") >= attempts, "dead").when(F.col("lease_until") > now, "leased").when(F.col("cool_until") > now, "cooling").otherwise("ready")
    judged = tasks.withColumn("state", state)
    taken = judged.filter("state = 'ready'").orderBy(F.desc("priority"), "id").limit(workers).select("id", F.lit(True).alias("taken"))
    return judged.join(F.broadcast(taken), "id", "left").withColumn("taken", F.coalesce("taken", F.lit(False)))


def review(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """A decision moves only what waits for review."""
    moved = candidates.join(decisions, "key", "left")
    to = F.when((F.col("state") == "manual_review") & F.col("approve"), "approved").when((F.col("state") == "manual_review") & ~F.col("approve"), "rejected").otherwise(F.col("state"))
    return moved.select("key", to.alias("state"), ((F.col("state") == "manual_review") & F.col("approve").isNotNull()).alias("moved"))


def strategy_score(expected: Column, present: Column) -> tuple[Column, Column]:
    """Share of the expected signals that are there, and the missing ones."""
    return F.when(F.size(expected) > 0, F.bround(F.size(F.array_intersect(expected, present)) / F.size(expected), 4)).otherwise(0.0), F.array_except(expected, present)


def retry_eligible(seeds: DataFrame, verdicts: DataFrame, run: int, most: int = 3, cooldown: int = 1) -> DataFrame:
    """Seeds to validate in a run, with what is known of them (P30): new ones, and those that are not given up and whose pause of
    `cooldown` runs since the last undecided verdict is over. After `most` undecided verdicts a seed is given up."""
    undecided = F.col("decision") == "insufficient"
    known = verdicts.groupBy("seed").agg(F.count_if(undecided).alias("attempts"), (F.max(F.when(undecided, F.col("run"))) + cooldown).alias("next_run"), F.max_by("decision", "run").alias("last_decision"))
    due = seeds.join(known, "seed", "left").withColumn("attempts", F.coalesce("attempts", F.lit(0)))
    return due.filter((F.col("attempts") < most) & (F.coalesce("next_run", F.lit(0)) <= run)).select("seed", "attempts", "last_decision")


def sandbox_preview(fetched: DataFrame, valid: Column, quality: Column, samples: int = 3) -> DataFrame:
    """Per source: what a run would bring, and whether it passes: something fetched and quality 0.3 or more."""
    judged = fetched.withColumn("_ok", valid).withColumn("_q", quality)
    w = Window.partitionBy("provider").orderBy(F.desc("_ok"), "key")
    top = judged.withColumn("_rn", F.row_number().over(w))
    g = top.groupBy("provider").agg(F.count(F.lit(1)).alias("fetched"), F.count_if("_ok").alias("valid"), F.bround(F.avg("_q"), 4).alias("quality"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("_rn") <= samples, F.col("key")))), ",").alias("samples"))
    return g.withColumn("passed", (F.col("fetched") > 0) & (F.col("quality") >= 0.3))
