"""What is around an organiser, and what its pages say of it together (G04, M17, P33); records at the edge of the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.organizers import canonical_key
from eventloom.functions.text import normalize_city, refined_category
from eventloom.operators import dedup

# Kinds of vertices of social platforms.
SOCIAL = {"github": "github_org", "gitlab": "gitlab_org", "youtube": "youtube_channel", "discord": "discord", "telegram": "telegram", "linkedin": "linkedin_page", "notion": "notion_workspace"}


def _vertex(prefix: str, kind: str, value: Column, key: Column) -> Column:
    return F.struct(F.concat(F.lit(f"{prefix}:"), F.lower(F.trim(key))).alias("id"), F.lit(kind).alias("type"), value.alias("name"))


def relations(profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, type, name) and (source, type, target) of the ten rules around each organiser (G04), each once.

    profiles: id, parent_org, chapter, university, department, venue, and arrays series, sponsors, calendars, feeds, domains, and
    a map socials of platform to url. Sponsors point to the organiser, all others from it; a series recurs by itself."""
    some = lambda c: F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: x != "")
    one = lambda c: F.filter(F.array(F.col(c)), lambda x: x.isNotNull() & (x != ""))
    link = lambda values, prefix, kind, relation, own=canonical_key: F.transform(values, lambda v: F.struct(_vertex(prefix, kind, v, own(v)).alias("v"), relation.alias("type")))
    same = lambda v: v
    chapter = F.when(F.coalesce("chapter", F.lit("")) != "", "chapter_of").otherwise("belongs_to")
    socials = F.coalesce("socials", F.create_map().cast("map<string,string>"))
    kind = F.create_map(*[F.lit(x) for kv in SOCIAL.items() for x in kv])
    channels = F.transform(F.map_entries(socials), lambda e: F.struct(F.struct(F.concat(e["key"], F.lit(":"), F.lower(F.trim(e["value"]))).alias("id"), F.coalesce(F.try_element_at(kind, e["key"]), F.lit("website")).alias("type"), e["value"].alias("name")).alias("v"), F.lit("announces_on").alias("type")))
    every = F.concat(
        link(one("parent_org"), "org", "organization", chapter), link(one("university"), "uni", "university", F.lit("belongs_to")), link(one("department"), "dept", "department", F.lit("belongs_to")),
        link(some("series"), "series", "conference_series", F.lit("organizes")), link(some("sponsors"), "sponsor", "sponsor", F.lit("sponsors")), link(one("venue"), "venue", "venue", F.lit("hosts")),
        link(some("calendars"), "cal", "calendar", F.lit("uses_calendar"), same), link(some("feeds"), "feed", "feed", F.lit("uses_feed"), same), link(some("domains"), "web", "website", F.lit("announces_on"), same), channels,
    )
    found = profiles.select("id", F.explode(every).alias("x")).select("id", "x.v", "x.type")
    vertices = found.groupBy("v.id").agg(F.min("v.type").alias("type"), F.min("v.name").alias("name"))
    back = F.col("type") == "sponsors"
    edges = found.select(F.when(back, F.col("v.id")).otherwise(F.col("id")).alias("source"), "type", F.when(back, F.col("id")).otherwise(F.col("v.id")).alias("target"))
    again = found.filter("type = 'organizes'").select(F.col("v.id").alias("source"), F.lit("recurring").alias("type"), F.col("v.id").alias("target"))
    return vertices, edges.union(again).distinct()


def merge_profiles(fields: DataFrame, kinds: DataFrame) -> DataFrame:
    """id, field, value, confidence, kind of organisers from several pages.

    fields: id, ord, field, value, confidence; a null value is unknown and has no confidence. Of a field the surest value counts, the
    first on ties. kinds: id, ord, kind; the last one that is more than an organisation counts."""
    known = F.when(F.col("value").isNotNull(), F.coalesce("confidence", F.lit(0.0)))
    best = fields.groupBy("id", "field").agg(F.max_by(F.struct("value", known.alias("confidence")), F.struct(known.alias("c"), -F.col("ord"))).alias("x")).select("id", "field", "x.*")
    kind = kinds.groupBy("id").agg(F.coalesce(F.max_by("kind", F.when(F.col("kind") != "organization", F.col("ord"))), F.lit("organization")).alias("kind"))
    return best.join(kind, "id", "left")


def attribution(events: DataFrame, order: str) -> DataFrame:
    """provider, fetched, surviving, duplicates: what of each source's records is left when all are deduplicated."""
    kept = dedup.survivors(dedup.clusters(events, order), order).select(F.col(order), F.lit(True).alias("_kept"))
    return events.join(kept, order, "left").groupBy("provider").agg(F.count(F.lit(1)).alias("fetched"), F.count_if("_kept").alias("surviving"), F.count_if(F.col("_kept").isNull()).alias("duplicates"))


def refine(events: DataFrame) -> DataFrame:
    """Cities by their one name, and meetups by what their words say they are, as records come in."""
    return events.withColumns({"city": normalize_city(F.col("city")), "category": refined_category(F.col("title"), F.col("description"), F.col("category"))})


def attended(log: DataFrame) -> DataFrame:
    """user_id, attended: how often a user has attended records, each time counted."""
    return log.groupBy("user_id").agg(F.count_if((F.col("type") == "attend") & F.col("event_key").isNotNull()).alias("attended"))
