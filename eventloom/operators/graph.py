"""Entity graph as vertices and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.scoring import OPTIONAL, completeness
from eventloom.functions.text import communities, normalize_city, normalize_name, organisations, series_name, venue
from eventloom.operators import matching
from eventloom.operators.predicates import end
from eventloom.staging import staged

TYPES = {"HOSTED_BY": "community", "ORGANIZED_BY": "organization", "PART_OF": "event_series", "HELD_AT": "venue", "IN_CITY": "city"}


def slug(c: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")), " ", "-")


def mentions(catalog: DataFrame, only: tuple[str, ...] = tuple(TYPES)) -> DataFrame:
    """key, edge, name of every entity that a record names, by edges of the kinds asked for, with the record's facts."""
    text = F.concat_ws(" ", "title", F.coalesce("description", F.lit("")))
    city = normalize_city(F.col("city"))
    some = lambda edge, a: F.transform(a, lambda x: F.struct(F.lit(edge).alias("edge"), x.alias("name")))
    one = lambda edge, x: F.when(F.coalesce(x, F.lit("")) != "", F.array(F.struct(F.lit(edge).alias("edge"), x.alias("name")))).otherwise(F.array().cast("array<struct<edge:string,name:string>>"))
    kinds = {
        "HOSTED_BY": lambda: some("HOSTED_BY", communities(text, F.col("provider"))),
        "ORGANIZED_BY": lambda: some("ORGANIZED_BY", organisations(text)),
        "PART_OF": lambda: one("PART_OF", series_name(F.col("title"), F.col("city"))),
        "HELD_AT": lambda: one("HELD_AT", venue(F.col("location"), F.col("city"))),
        "IN_CITY": lambda: one("IN_CITY", city),
    }
    every = F.concat(*[make() for edge, make in kinds.items() if edge in only])
    return catalog.select("key", "category", "start_date", city.alias("city"), F.explode(every).alias("m")).select("key", "category", "start_date", "city", "m.edge", "m.name")


def build(catalog: DataFrame, only: tuple[str, ...] = tuple(TYPES)) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges); a vertex carries the union of what its events say (A10). ACTIVE_IN and HOSTS_SERIES are derived."""
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv]), F.col("edge"))
    m = mentions(catalog, only).withColumn("type", kind).withColumn("id", F.concat_ws(":", "type", slug(F.col("name"))))
    # The events of a vertex are the sources of its edges: a city may have a share of the whole catalog, so only their number is here.
    once = m.groupBy("id", "type", "key").agg(F.min("name").alias("name"), *[F.any_value(c).alias(c) for c in ("city", "category", "start_date")])
    vertices = once.groupBy("id", "type").agg(
        F.min("name").alias("name"),
        F.count(F.lit(1)).alias("events"),
        F.array_sort(F.collect_set("city")).alias("cities"),
        F.array_sort(F.collect_set("category")).alias("categories"),
        F.min("start_date").alias("first_seen"),
        F.max("start_date").alias("last_seen"),
    )
    direct = m.select(F.concat(F.lit("event:"), "key").alias("source"), F.col("edge").alias("type"), F.col("id").alias("target"))
    hosts = m.filter("edge = 'HOSTED_BY'").select("key", F.col("id").alias("h"), "city")
    series = m.filter("edge = 'PART_OF'").select("key", F.col("id").alias("s"))
    active = hosts.filter("city is not null and city <> ''").select(F.col("h").alias("source"), F.lit("ACTIVE_IN").alias("type"), F.concat(F.lit("city:"), slug(F.col("city"))).alias("target"))
    hosts_series = hosts.join(series, "key").select(F.col("h").alias("source"), F.lit("HOSTS_SERIES").alias("type"), F.col("s").alias("target"))
    return vertices, direct.unionByName(active).unionByName(hosts_series).distinct()


def entity_maps(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """key, community, organizer: the names of the first host and organiser of each event, by id."""
    e = edges.filter(F.col("type").isin("HOSTED_BY", "ORGANIZED_BY")).groupBy(F.expr("substr(source, 7)").alias("key"), F.col("type").alias("edge")).agg(F.min("target").alias("id"))
    named = e.join(vertices.select("id", "name"), "id")
    pick = lambda edge: F.max(F.when(F.col("edge") == edge, F.col("name")))
    return named.groupBy("key").agg(pick("HOSTED_BY").alias("community"), pick("ORGANIZED_BY").alias("organizer"))


def neighbours(edges: DataFrame, node: str, edge: str | None = None, outward: bool = True) -> DataFrame:
    here, there = ("source", "target") if outward else ("target", "source")
    out = edges.filter(F.col(here) == node)
    if edge:
        out = out.filter(F.col("type") == edge)
    return out.select(F.col(there).alias("id")).distinct().orderBy("id")


def subgraph(vertices: DataFrame, edges: DataFrame, types: list[str], kinds: list[str]) -> tuple[DataFrame, DataFrame]:
    v = vertices.filter(F.col("type").isin(*types))
    ids = v.select("id")
    e = edges.filter(F.col("type").isin(*kinds)).join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return v, e


def fold(vertices: DataFrame, edges: DataFrame, keep: str, drop: str) -> tuple[DataFrame, DataFrame]:
    """drop becomes keep: edges are rewired, loops go."""
    to = lambda c: F.when(F.col(c) == drop, keep).otherwise(F.col(c)).alias(c)
    e = edges.select(to("source"), "type", to("target")).filter("source <> target").distinct()
    return vertices.filter(F.col("id") != drop), e


def profiles(catalog: DataFrame, edges: DataFrame, today: Column) -> DataFrame:
    """Totals, activity, mean completeness, cities and monthly rate of every organiser."""
    e = edges.filter(F.col("type").isin("HOSTED_BY", "ORGANIZED_BY", "PART_OF")).select(F.regexp_replace("source", "^event:", "").alias("key"), F.col("target").alias("id"))
    j = e.join(catalog, "key")
    span = F.greatest(F.lit(1.0), F.months_between(F.max("start_date"), F.min("start_date"), False) + 1)
    return j.groupBy("id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(end() >= today).alias("active"),
        F.count_if(end() < today).alias("historical"),
        F.bround(F.sum(completeness(*[F.col(c) for c in OPTIONAL])) / (F.count(F.lit(1)) * 6), 3).alias("quality"),
        F.array_sort(F.collect_set(normalize_city(F.col("city")))).alias("cities"),
        F.round(F.count(F.lit(1)) / span, 3).alias("per_month"),
    )


def recurring_series(vertices: DataFrame, limit: int) -> DataFrame:
    s = vertices.filter("type = 'event_series'").select("id", "name", F.col("events").alias("editions")).filter("editions >= 2")
    return s.orderBy(F.desc("editions"), "name", "id").limit(limit)


def directory(vertices: DataFrame, per_type: int = 24) -> DataFrame:
    w = Window.partitionBy("type").orderBy(F.desc("events"), "name", "id")
    v = vertices.select("type", "id", "name", "events")
    return v.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= per_type)


def resolve_names(raw: DataFrame, aliases: dict[str, dict[str, str]], threshold: float = 0.92) -> DataFrame:
    """type, raw, id, ord of names in input order `ord` (unique): curated name, longest curated name contained, seen name, most similar seen name, new.

    A name that is not curated takes the id of the most similar name before it, the first on ties. Which one that is hangs on the names and
    their order, not on ids: so similar names are found through an index, each picks its one, and ids follow these links."""
    names = raw.withColumn("norm", normalize_name(F.col("raw"))).select("type", "raw", "ord", "norm")
    first = names.filter("norm <> ''").groupBy("type", "norm").agg(F.min("ord").alias("first"))
    padded = F.concat(F.lit(" "), F.col("norm"), F.lit(" "))
    curated = F.coalesce(*[F.when((F.col("type") == kind) & hit, F.lit(to)) for kind, known in aliases.items() for a, to, hit in [
        *[(a, to, F.col("norm") == a) for a, to in known.items()], *[(a, known[a], F.contains(padded, F.lit(f" {a} "))) for a in sorted(known, key=lambda a: (-len(a), a))]]], F.lit(None).cast("string"))
    distinct = staged(first.withColumn("curated", curated).withColumn("words", F.array_join(F.array_sort(F.split("norm", " ")), " ")).withColumn("id", F.monotonically_increasing_id()), "resolve-names")
    like = matching.by_index(distinct, "type", "words", threshold)
    of = lambda k: distinct.select(F.col("id").alias(k), F.struct("first", "curated").alias(f"of_{k}"))
    both = like.join(of("x"), "x").join(of("y"), "y")
    later = F.col("of_x.first") > F.col("of_y.first")
    links = both.select(F.when(later, F.col("x")).otherwise(F.col("y")).alias("id"), F.when(later, F.col("y")).otherwise(F.col("x")).alias("to"), F.when(later, F.col("of_x.curated")).otherwise(F.col("of_y.curated")).alias("curated"), F.least("of_x.first", "of_y.first").alias("at"), "score")
    parents = links.filter("curated is null").groupBy("id").agg(F.max_by("to", F.struct("score", -F.col("at"))).alias("to"))
    root = distinct.join(matching.roots(parents), "id", "left").select("type", "norm", F.coalesce("root", "id").alias("root"))
    slug = distinct.select(F.col("id").alias("root"), F.coalesce("curated", F.replace(F.col("norm"), F.lit(" "), F.lit("-"))).alias("slug"))
    named = root.join(slug, "root").select("type", "norm", "slug")
    return names.join(named, ["type", "norm"], "left").select("type", "raw", F.col("slug").alias("id"), "ord")


def health(dates: DataFrame, now: Column) -> DataFrame:
    """id, median positive gap in days, last date, state: active within one period, slowing within two, dormant after."""
    w = Window.partitionBy("id").orderBy("d")
    gaps = dates.select("id", "d", F.datediff("d", F.lag("d").over(w)).alias("gap"))
    g = gaps.groupBy("id").agg(F.max("d").alias("last"), F.percentile(F.when(F.col("gap") > 0, F.col("gap")), 0.5).alias("period"))
    age = F.datediff(now, F.col("last"))
    return g.withColumn("state", F.when(F.col("period").isNull(), "unknown").when(age <= F.col("period"), "active").when(age <= 2 * F.col("period"), "slowing").otherwise("dormant"))
