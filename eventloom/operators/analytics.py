"""Coverage, gaps, trust, budgets and operations metrics over discovery and run logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.operators import scans

# Target universes, trust weights, crawl intervals by tier.
TARGET_CITIES = "Bangalore,Delhi,Mumbai,Hyderabad,Pune,Chennai,Kolkata,Ahmedabad,Jaipur,Chandigarh,Kochi,Goa,Noida,Gurgaon,Thiruvananthapuram".split(",")
TRUST = {"approval": 0.20, "sandbox": 0.15, "production": 0.20, "duplicate": 0.10, "freshness": 0.10, "richness": 0.15, "stability": 0.10}
INTERVALS = {"high": 6, "medium": 12, "low": 48}
STRUCTURED = ["rss", "atom", "ics", "google_calendar", "json_feed", "event_sitemap", "jsonld_event", "microdata_event", "opengraph_event"]
FRAMEWORK = ["next_data", "next_flight", "hydration_state", "embedded_json", "json_api", "graphql"]
COSTS = {"structured": 1, "framework": 2, "search": 3, "ai": 4}


def ratio(a: Column, b: Column, digits: int = 4) -> Column:
    """0 on an empty denominator."""
    return F.coalesce(F.bround(F.try_divide(a, b), digits), F.lit(0.0))


def coverage(spark, records: DataFrame, column: str, targets: list[str]) -> DataFrame:
    """target, covered: the universe against what the records hold."""
    seen = records.select(F.col(column).alias("target")).filter("target is not null and target <> ''").distinct().withColumn("_hit", F.lit(True))
    universe = spark.createDataFrame([(t,) for t in targets], "target string")
    return universe.join(seen, "target", "left").select("target", F.coalesce("_hit", F.lit(False)).alias("covered"))


def gaps(spark, records: DataFrame, targets: list[str], least: int = 20, thin: float = 0.05) -> DataFrame:
    """city, tech, observed, total, severity of under-covered targets."""
    w = F.greatest(F.lit(1), F.col("event_count"))
    counts = records.filter("city is not null and city <> ''").select("city", w.alias("w"), F.explode("technologies").alias("tech")).groupBy("city", "tech").agg(F.sum("w").alias("n"))
    totals = counts.groupBy("city").agg(F.sum("n").alias("total")).filter(F.col("total") >= least)
    grid = totals.crossJoin(F.broadcast(spark.createDataFrame([(t,) for t in targets], "tech string")))
    g = grid.join(counts, ["city", "tech"], "left").withColumn("observed", F.coalesce("n", F.lit(0)))
    g = g.filter(F.col("observed") <= F.greatest(F.lit(2.0), thin * F.col("total")))
    severity = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.bround(1.0 - F.col("observed") / (F.col("total") * thin + 1e-9), 4)))
    return g.select("city", "tech", "observed", "total", severity.alias("severity"))


def query_stats(records: DataFrame) -> DataFrame:
    """Per search query: domains, good, spam, duplicates, yield and what to do."""
    g = records.filter("search_query is not null").groupBy("search_query").agg(
        F.countDistinct("domain").alias("domains"), F.count_if(F.col("approved") | F.col("active")).alias("good"),
        F.count_if(F.col("onboarding_state") == "rejected").alias("spam"), F.count_if(F.col("onboarding_state") == "duplicate").alias("duplicates"),
    )
    g = g.withColumns({"yield_score": ratio(F.col("good"), F.col("domains")), "spam_rate": ratio(F.col("spam"), F.col("domains"))})
    action = F.when(F.col("spam_rate") >= 0.6, "retire").when((F.col("yield_score") >= 0.5) & (F.col("domains") >= 2), "boost").when((F.col("domains") >= 8) & (F.col("yield_score") < 0.2), "split").otherwise("keep")
    return g.withColumn("recommendation", action)


def query_overlap(records: DataFrame, least: float = 0.6) -> DataFrame:
    """Pairs of queries whose domain sets overlap, through shared domains."""
    d = records.filter("search_query is not null").select(F.col("search_query").alias("q"), "domain").distinct()
    n = d.groupBy("q").agg(F.count(F.lit(1)).alias("n"))
    a, b = d.alias("a"), d.alias("b")
    both = a.join(b, (F.col("a.domain") == F.col("b.domain")) & (F.col("a.q") < F.col("b.q"))).groupBy(F.col("a.q").alias("qa"), F.col("b.q").alias("qb")).agg(F.count(F.lit(1)).alias("k"))
    j = both.join(n.select(F.col("q").alias("qa"), F.col("n").alias("na")), "qa").join(n.select(F.col("q").alias("qb"), F.col("n").alias("nb")), "qb")
    return j.withColumn("jaccard", F.round(F.col("k") / (F.col("na") + F.col("nb") - F.col("k")), 4)).filter(F.col("jaccard") >= least).select("qa", "qb", "jaccard")


def freshness_of(hours: Column) -> Column:
    return F.when(hours.isNull() | (hours >= 720), 0.0).when(hours <= 24, 1.0).otherwise(F.bround(1.0 - (hours - 24) / 696, 4))


def domain_trust(records: DataFrame) -> DataFrame:
    """Seven means, their weighted total and a tier for each domain."""
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    reached = F.col("production_state").isin("active", "rolled_back")
    parts = {
        "approval": F.avg(F.col("approved").cast("double")),
        "sandbox": F.avg("sandbox_quality"),
        "production": F.coalesce(F.avg(F.when(reached, (F.col("production_state") == "active").cast("double"))), F.lit(0.0)),
        "duplicate": clamp(1 - F.avg("duplicate_rate")),
        "freshness": F.avg(freshness_of(F.col("freshness_hours"))),
        "richness": clamp(F.avg(F.least(F.lit(1.0), F.col("event_count") / 10.0))),
        "stability": clamp(F.avg(1.0 - F.coalesce(F.try_divide(F.col("crawl_failures"), F.col("crawl_attempts")), F.lit(0.0)))),
    }
    g = records.groupBy("domain").agg(F.count(F.lit(1)).alias("records"), *[F.bround(v, 3).alias(k) for k, v in parts.items()])
    g = g.withColumn("total", F.bround(sum((w * F.col(k) for k, w in TRUST.items()), F.lit(0.0)), 4))
    return g.withColumn("tier", F.when(F.col("total") >= 0.7, "high").when(F.col("total") >= 0.45, "medium").when(F.col("total") >= 0.2, "low").otherwise("dead"))


def budget(trust: DataFrame, daily: int = 100) -> DataFrame:
    """Crawl share by trust among domains that are not dead; the sum is one broadcast row, not a global window."""
    live = trust.filter("tier <> 'dead'")
    total = live.agg(F.sum("total").alias("_all"))
    w = F.bround(F.when(F.col("tier") == "dead", 0.0).otherwise(F.coalesce(F.try_divide(F.col("total"), F.col("_all")), F.lit(0.0))), 4)
    action = F.when(F.col("tier") == "high", "increase").when(F.col("tier") == "medium", "maintain").when(F.col("tier") == "low", "decrease").otherwise("stop")
    hours = F.when(F.col("tier") == "high", 6).when(F.col("tier") == "medium", 12).when(F.col("tier") == "low", 48)
    return trust.crossJoin(F.broadcast(total)).select("domain", "tier", action.alias("action"), hours.alias("interval_hours"), w.alias("weight"), F.bround(w * daily, 2).alias("crawls"))


def strategy_of(feed: Column) -> Column:
    return F.when(feed.isin(*STRUCTURED), "structured").when(feed.isin(*FRAMEWORK), "framework").when(feed == "ai_extracted", "ai").otherwise("search")


def strategies(records: DataFrame) -> DataFrame:
    """The cheapest strategy that yields events in each domain, and those to avoid."""
    n = F.greatest(F.col("event_count"), F.col("approved").cast("int"))
    per = records.groupBy("domain", strategy_of(F.col("feed_type")).alias("s")).agg(F.sum(n).alias("n"))
    cost = F.element_at(F.create_map(*[F.lit(x) for kv in COSTS.items() for x in kv]), F.col("s"))
    g = per.groupBy("domain").agg(F.min_by("s", F.when(F.col("n") > 0, cost)).alias("b"), F.collect_set(F.when(F.col("n") > 0, F.col("s"))).alias("effective"), F.max("n").alias("most"))
    best = F.when(F.col("most") > 0, F.col("b")).otherwise("search")
    order = F.element_at(F.create_map(*[F.lit(x) for kv in COSTS.items() for x in kv]), F.col("best_strategy"))
    every = F.array(*[F.struct(F.lit(k).alias("s"), F.lit(v).alias("c")) for k, v in COSTS.items()])
    avoid = F.transform(F.filter(every, lambda x: (x["c"] > order) & ~F.array_contains("effective", x["s"])), lambda x: x["s"])
    return g.withColumn("best_strategy", best).select("domain", "best_strategy", F.array_join(avoid, ",").alias("avoid"))


def discovery_kpis(records: DataFrame) -> DataFrame:
    a = F.count_if(F.col("approved") | F.col("active"))
    domains, queries = F.countDistinct("domain"), F.countDistinct("search_query")
    return records.agg(
        F.count(F.lit(1)).alias("records"), domains.alias("domains"), queries.alias("queries"), ratio(a, queries).alias("query_yield"),
        ratio(F.sum("event_count"), domains).alias("domain_yield"), ratio(F.sum("event_count"), F.sum("crawl_attempts")).alias("crawl_efficiency"),
        ratio(F.count_if("active"), F.count_if(F.col("production_state").isin("active", "rolled_back"))).alias("precision"), ratio(F.sum("crawl_attempts"), domains).alias("cost"),
    )


def calibration(outcomes: DataFrame, bins: int = 5) -> DataFrame:
    """Half-open bins of predicted confidence: size, mean prediction, observed rate, difference."""
    b = F.least(F.lit(bins - 1), F.floor(F.col("predicted") * bins)).cast("int")
    g = outcomes.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("predicted"), 6).alias("predicted"), F.round(F.avg(F.col("observed").cast("double")), 6).alias("observed"))
    return g.withColumn("delta", F.round(F.col("observed") - F.col("predicted"), 6))


def health_rollup(states: DataFrame) -> DataFrame:
    """Counts by health and by circuit, and the rates, as grouping sets."""
    return states.groupingSets([["health"], ["circuit"], []], "health", "circuit").agg(F.count(F.lit(1)).alias("n"), F.sum("runs").alias("runs"), ratio(F.sum("successes"), F.sum("runs")).alias("success_rate"))


def provider_state(runs: DataFrame) -> DataFrame:
    """Streaks, means and circuit state of every source from its ordered run log."""
    log = scans.ranged(runs.select("provider", "at", "run_id", "ok", "found"), ["provider"], ["at", "run_id"])
    sums = log.groupBy("provider").agg(F.count(F.lit(1)).alias("runs"), F.count_if("ok").alias("successes"), F.round(F.avg(F.when(F.col("ok"), F.col("found"))), 6).alias("avg_found"))
    streak = scans.streaks(log, ["provider"], ["at", "run_id"], "ok").withColumnRenamed("provider", "_of")
    both = sums.join(streak, F.col("provider").eqNullSafe(F.col("_of")))
    return both.select("provider", "runs", "successes", "streak", "worst", "avg_found", F.when(F.col("streak") >= 3, "open").otherwise("closed").alias("circuit"))
