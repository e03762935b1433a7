"""Conjunctive catalog predicates, built once and pushed down by Catalyst."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.text import normalize_city


@dataclass(frozen=True)
class Query:
    """Empty means no constraint."""

    keywords: list[str] = field(default_factory=list)
    city: str | None = None
    categories: list[str] = field(default_factory=list)
    date_from: str | None = None
    date_to: str | None = None
    free_only: bool = False

    def __post_init__(self):
        if self.date_from and self.date_to and self.date_from > self.date_to:
            raise ValueError("date_from is after date_to")


def end() -> Column:
    return F.coalesce(F.col("end_date"), F.col("start_date"))


def overlaps(date_from: str | None, date_to: str | None) -> Column:
    out = F.lit(True)
    if date_from:
        out = out & (end() >= F.lit(date_from).cast("date"))
    if date_to:
        out = out & (F.col("start_date") <= F.lit(date_to).cast("date"))
    return out


def keyword_any(keywords: list[str]) -> Column:
    hay = F.lower(F.concat_ws(" ", "title", F.coalesce("description", F.lit(""))))
    return reduce(lambda a, b: a | b, [F.contains(hay, F.lit(k.lower())) for k in keywords])


def where(q: Query, *, active: bool = True, upcoming: str | None = None, canonical_city: bool = False, with_keywords: bool = True) -> Column:
    """The storage filter; with canonical_city the post-fusion one (both sides of the city normalised)."""
    out = overlaps(q.date_from, q.date_to)
    if active:
        out = out & (F.col("status") == "active")
    if q.city:
        same = F.lower(normalize_city(F.col("city"))) == F.lower(normalize_city(F.lit(q.city))) if canonical_city else F.lower("city") == F.lit(q.city.lower())
        out = out & F.col("city").isNotNull() & same
    if q.categories:
        out = out & F.col("category").isin(*q.categories)
    if q.free_only:
        out = out & F.col("is_free").eqNullSafe(F.lit(True))
    if upcoming:
        out = out & (end() >= F.lit(upcoming).cast("date"))
    if q.keywords and with_keywords:
        out = out & keyword_any(q.keywords)
    return out


def by_free(free: bool) -> Column:
    """Unknown prices match neither."""
    return F.col("is_free").eqNullSafe(F.lit(free))


def weekend(today: Column) -> tuple[Column, Column]:
    saturday = F.date_add(today, F.pmod(F.lit(5) - F.weekday(today), F.lit(7)))
    return saturday, F.date_add(saturday, 1)


def this_weekend(today: Column) -> Column:
    sat, sun = weekend(today)
    return (F.col("start_date") <= sun) & (end() >= sat)


def this_month(today: Column) -> Column:
    return F.trunc("start_date", "month") == F.trunc(today, "month")


def recently_added(now: Column, days: int = 7) -> Column:
    return F.col("first_seen_at") >= now - F.make_dt_interval(F.lit(days))


def quality_gate(df: DataFrame, today: Column) -> DataFrame:
    """Adds `reasons`: why a record is rejected; empty where it is valid."""
    return df.withColumn("reasons", F.array_compact(F.array(F.when(F.trim("title") == "", "empty title"), F.when(end() < today, "already ended"))))
