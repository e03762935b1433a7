"""The facade's queries (P14-P17, F07, F20, G10, A09, A13): home page, feeds, browsing, details, reports.

Each is a small plan over the catalog; the home page is one pass with a section label for each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.scoring import OPTIONAL, completeness, source_score, trending
from eventloom.functions.text import normalize_city
from eventloom.operators.predicates import end, recently_added, this_month, this_weekend

# Title patterns of three sections.
TITLES = {"developer_festivals": r"(?i)devfest|dev ?fest|developer festival", "government_tech": r"(?i)\bgovern?ment\b|\bgovt\b|\bgov\b", "university_events": r"(?i)university|college|campus|student"}


def event_dto(df: DataFrame) -> DataFrame:
    """Public projection: dates as ISO text."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return df.select("key", "title", "description", "url", "city", "location", "is_online", iso("start_date"), iso("end_date"), "category", "is_free", "price", "provider")


def homepage(catalog: DataFrame, now: Column, per_section: int = 8, city: str | None = None) -> DataFrame:
    """section, rank, key: fifteen sections (and nearby), each with its own order, in one pass over the catalog."""
    today = F.to_date(now)
    up = end() >= today
    closing = (F.col("start_date") > today) & (F.col("start_date") <= F.date_add(today, 7))
    rules = {
        "upcoming": up, "ai_events": up & (F.col("category") == "ai"), "hackathons": up & (F.col("category") == "hackathon"), "conferences": up & (F.col("category") == "conference"),
        "meetups": up & (F.col("category") == "meetup"), "workshops": up & (F.col("category") == "workshop"), "startup_events": up & (F.col("category") == "startup"),
        **{n: up & F.col("title").rlike(p) for n, p in TITLES.items()},
        "recently_added": recently_added(now), "registration_closing": closing, "online_events": up & F.col("is_online"), "free_events": up & F.col("is_free"), "trending": F.col("start_date") >= today,
    }
    if city:
        rules["nearby_events"] = up & (F.lower(normalize_city(F.col("city"))) == F.lower(normalize_city(F.lit(city))))
    section = F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()])))
    hot = F.when(F.col("section") == "trending", -trending(now)).otherwise(0.0)
    new = F.when(F.col("section") == "recently_added", -F.unix_micros("first_seen_at")).otherwise(0)
    w = Window.partitionBy("section").orderBy(hot, new, "start_date", "key")
    return catalog.withColumn("section", section).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= per_section).select("section", "rank", "key")


def feed(catalog: DataFrame, name: str, now: Column, limit: int, city: str | None = None) -> DataFrame:
    """One of the eleven feeds; nearby needs a city."""
    today = F.to_date(now)
    up = end() >= today
    by_start = [F.col("start_date"), F.col("key")]
    plans = {
        "trending": (F.col("start_date") >= today, [F.desc("_trend"), F.col("key")]),
        "popular": (up, [(-(source_score(F.col("provider")) + completeness(*[F.col(c) for c in OPTIONAL]) / 6)).asc(), F.col("key")]),
        "newest": (F.lit(True), [F.desc("first_seen_at"), *by_start]), "closing": ((F.col("start_date") > today) & (F.col("start_date") <= F.date_add(today, 7)), by_start),
        "weekend": (this_weekend(today), by_start), "month": (this_month(today) & up, by_start), "online": (up & F.col("is_online"), by_start), "offline": (up & ~F.col("is_online"), by_start),
        "free": (up & F.col("is_free").eqNullSafe(F.lit(True)), by_start), "paid": (up & F.col("is_free").eqNullSafe(F.lit(False)), by_start),
    }
    if name == "nearby":
        if not city:
            raise ValueError("nearby needs a city")
        plans["nearby"] = (up & (F.lower(normalize_city(F.col("city"))) == F.lower(normalize_city(F.lit(city)))), by_start)
    rule, order = plans[name]
    df = catalog.withColumn("_trend", trending(now)) if name == "trending" else catalog
    return df.filter(rule).orderBy(*order).limit(min(limit, 10) if name == "trending" else limit)


def browse(catalog: DataFrame, dimension: str, value: str, enrichment: DataFrame | None = None) -> DataFrame:
    """All records of a dimension's value, past ones too."""
    plain = {"category": F.col("category") == value, "city": F.lower(normalize_city(F.col("city"))) == F.lower(normalize_city(F.lit(value))), "format": F.col("is_online") == (value == "online"), "provider": F.col("provider") == value}
    if dimension in plain:
        return catalog.filter(plain[dimension])
    arrays = {"topic": "topics", "technology": "technologies", "audience": "audiences"}
    if enrichment is None or dimension not in {*arrays, "difficulty"}:
        raise ValueError(f"no such dimension: {dimension}")
    rule = F.col("level") == value if dimension == "difficulty" else F.array_contains(arrays[dimension], value)
    return catalog.join(enrichment.filter(rule).select("key"), "key", "left_semi")


def analytics(catalog: DataFrame, enrichment: DataFrame, top: int = 5) -> tuple[DataFrame, DataFrame]:
    """(one row of totals, top topics)."""
    totals = catalog.agg(F.count(F.lit(1)).alias("events"), F.countDistinct("provider").alias("providers"), F.countDistinct("city").alias("cities"))
    topics = enrichment.select(F.explode("topics").alias("topic")).groupBy("topic").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "topic").limit(top)
    return totals, topics


def insights(profiles: DataFrame, vertices: DataFrame, top: int = 5) -> DataFrame:
    """list, rank, name, n: the five top lists of the community report."""
    p = profiles.join(vertices.select("id", "type", "name"), "id")
    lists = (
        p.filter("type = 'community'").select(F.lit("fastest_growing").alias("list"), "name", F.col("active").alias("n"))
        .unionByName(vertices.filter("type = 'city'").select(F.lit("most_active_cities").alias("list"), "name", F.col("events").alias("n")))
        .unionByName(p.filter("type = 'organization'").select(F.lit("most_active_organizers").alias("list"), "name", F.col("total").alias("n")))
        .unionByName(p.filter("type = 'event_series' and total >= 2").select(F.lit("recurring_series").alias("list"), "name", F.col("total").alias("n")))
        .unionByName(p.filter("type = 'community' and active = 0").select(F.lit("inactive_communities").alias("list"), "name", F.col("total").alias("n")))
    )
    w = Window.partitionBy("list").orderBy(F.desc("n"), "name")
    return lists.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def source_report(catalog: DataFrame, today: Column) -> DataFrame:
    """Per source: records, upcoming, categories, completeness."""
    return catalog.groupBy("provider").agg(
        F.count(F.lit(1)).alias("fetched"), F.count_if(end() >= today).alias("upcoming"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"),
        F.round(F.avg(completeness(*[F.col(c) for c in OPTIONAL]) / 6), 4).alias("completeness"),
    )


def batch_quality(valid: DataFrame, fetched: int, duplicates: int) -> DataFrame:
    """One row: half completeness, the rest what was valid and not a duplicate."""
    full = F.coalesce(F.avg(completeness(*[F.col(c) for c in OPTIONAL]) / 6), F.lit(0.0))
    n = max(fetched, 1)
    return valid.agg(F.bround(0.5 * full + 0.3 * F.count(F.lit(1)) / n + 0.2 * (1 - duplicates / n), 3).alias("quality"))
