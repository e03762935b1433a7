"""Scores as Column arithmetic: ranking, freshness, trending, confidences. Clocks are parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.functions.text import literal_map, normalize_city

# Weights and priors.
RANK_WEIGHTS = {"relevance": 0.40, "date": 0.20, "location": 0.15, "source": 0.10, "popularity": 0.10, "completeness": 0.05}
SOURCE_QUALITY = {"fossunited": 1.0, "hasgeek": 0.9, "devfolio": 0.9, "confs.tech": 0.8, "luma": 0.7, "gdg": 0.6, "cncf": 0.6}
TREND_WEIGHTS = {"source": 0.35, "freshness": 0.30, "popularity": 0.20, "updates": 0.15}
HALF_LIFE = 30


def relevance(title: Column, description: Column, category: Column, keywords: list[str], categories: list[str]) -> Column:
    """Mean of the signals that the query has: keyword hits in body and title, and the category."""
    signals = []
    if keywords:
        hay, t = F.lower(F.concat_ws(" ", title, F.coalesce(description, F.lit("")))), F.lower(title)
        hits = sum((F.contains(x, F.lit(k.lower())).cast("int") for k in keywords for x in (hay, t)), F.lit(0))
        signals.append(F.least(F.lit(1.0), hits / (2 * len(keywords))))
    if categories:
        signals.append(category.isin(*categories).cast("double"))
    return sum(signals[1:], signals[0]) / len(signals) if signals else F.lit(0.0)


def date_score(start: Column, today: Column) -> Column:
    days = F.datediff(start, today)
    return F.when(days < 0, 0.0).otherwise(1.0 / (1.0 + days / HALF_LIFE))


def location_score(city: Column, online: Column, wanted: str | None) -> Column:
    if not wanted:
        return F.lit(0.0)
    same = F.lower(normalize_city(city)) == F.lower(normalize_city(F.lit(wanted)))
    return F.when(F.coalesce(same, F.lit(False)), 1.0).when(online, 0.5).otherwise(0.0)


def source_score(provider: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(SOURCE_QUALITY), provider), F.lit(0.5))


def popularity(description: Column, is_free: Column, location: Column, end: Column) -> Column:
    text = F.coalesce(0.5 * F.least(F.lit(1.0), F.length(description) / 200), F.lit(0.0))
    return F.least(F.lit(1.0), text + F.when(is_free.isNotNull(), 0.25).otherwise(0.0) + F.when(F.coalesce(location, F.lit("")) != "", 0.15).otherwise(0.0) + F.when(end.isNotNull(), 0.10).otherwise(0.0))


def completeness(*cols: Column) -> Column:
    """Populated fields of the six optional ones."""
    return sum((c.isNotNull().cast("int") for c in cols), F.lit(0))


OPTIONAL = ("description", "city", "location", "end_date", "price", "is_free")


def six_terms(keywords: list[str], categories: list[str], city: str | None, today: Column) -> dict[str, Column]:
    c = F.col
    return {
        "relevance": relevance(c("title"), c("description"), c("category"), keywords, categories),
        "date": date_score(c("start_date"), today),
        "location": location_score(c("city"), c("is_online"), city),
        "source": source_score(c("provider")),
        "popularity": popularity(c("description"), c("is_free"), c("location"), c("end_date")),
        "completeness": completeness(*[c(x) for x in OPTIONAL]) / 6,
    }


def rank_score(keywords: list[str], categories: list[str], city: str | None, today: Column) -> Column:
    return sum((RANK_WEIGHTS[n] * v for n, v in six_terms(keywords, categories, city, today).items()), F.lit(0.0))


def decay(days: Column) -> Column:
    return 1.0 / (1.0 + F.greatest(F.lit(0.0), days) / HALF_LIFE)


def freshness(first_seen: Column, start: Column, version: Column, now: Column) -> Column:
    found = (F.unix_micros(now) - F.unix_micros(first_seen)) / 86_400_000_000
    ahead = F.datediff(start, F.to_date(now))
    near = F.when(ahead >= 0, decay(ahead.cast("double"))).otherwise(0.0)
    return F.bround(0.5 * decay(found) + 0.4 * near + F.when(version > 1, 0.1).otherwise(0.0), 4)


def trending(now: Column) -> Column:
    c = F.col
    parts = {
        "source": source_score(c("provider")),
        "freshness": freshness(c("first_seen_at"), c("start_date"), c("version"), now),
        "popularity": F.least(F.lit(1.0), completeness(*[c(x) for x in OPTIONAL]) / 6),
        "updates": F.least(F.lit(1.0), (c("version") - 1) / 3),
    }
    return F.bround(sum((TREND_WEIGHTS[n] * v for n, v in parts.items()), F.lit(0.0)), 4)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def present_mean(parts: list[tuple[float, Column]]) -> Column:
    """Weighted mean over the signals that are there."""
    top = sum((F.coalesce(w * v, F.lit(0.0)) for w, v in parts), F.lit(0.0))
    base = sum((F.when(v.isNotNull(), w).otherwise(0.0) for w, v in parts), F.lit(0.0))
    return F.when(base > 0, top / base).otherwise(0.0)


def backoff(attempt: Column, base: float, most: float) -> Column:
    return F.least(F.lit(most), base * F.pow(F.lit(2.0), attempt - 1))
