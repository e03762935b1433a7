"""Fuzzy dedup of event records (M03-M09, J04, J05): date blocks, Indel similarity, greedy clusters."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from eventloom.functions.scoring import OPTIONAL, completeness, source_score
from eventloom.functions.text import normalize_city, normalize_title
from eventloom.functions.urls import dedup_url
from eventloom.operators import matching
from eventloom.operators.matching import indel
from eventloom.session import ship
from eventloom.staging import staged

SAME, URL_SAME = 0.85, 0.95


def title_ratio(a: str, b: str) -> float:
    return max(indel(a, b), indel(" ".join(sorted(a.split())), " ".join(sorted(b.split()))))


@F.pandas_udf(DoubleType())
def title_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([title_ratio(x or "", y or "") for x, y in zip(a, b, strict=True)])


@F.pandas_udf(DoubleType())
def url_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([0.0 if not x or not y else 1.0 if x == y else indel(x, y) for x, y in zip(a, b, strict=True)])


def fold(c: Column) -> Column:
    """Without case, also where a letter's other case is several letters (ß and SS), which lower alone leaves apart.

    The optimizer takes lower(upper(c)) for lower(c), so that A to Z are translated between them."""
    return F.lower(F.translate(F.upper(c), ascii_uppercase, ascii_lowercase))


def keyed(df: DataFrame) -> DataFrame:
    ship(df.sparkSession)
    return df.withColumns({"_title": normalize_title(fold(F.col("title"))), "_url": fold(dedup_url(F.col("url"))), "_city": fold(normalize_city(F.col("city")))})


def pair_score(a: str, b: str) -> Column:
    """0 where the dates or two known cities differ; 1 on (nearly) equal urls; else title and a tenth of the url."""
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    url = url_similarity(x("_url"), y("_url"))
    apart = (F.abs(F.datediff(x("start_date"), y("start_date"))) > 1) | ((x("_city") != "") & (y("_city") != "") & (x("_city") != y("_city")))
    return F.when(F.coalesce(apart, F.lit(False)), 0.0).when(url >= URL_SAME, 1.0).otherwise(F.least(F.lit(1.0), title_similarity(x("_title"), y("_title")) + 0.1 * url))


def richness() -> list[Column]:
    """Order of survivors: more populated, better source, longer description, later columns as ties."""
    return [completeness(*[F.col(c) for c in OPTIONAL]).desc(), source_score(F.col("provider")).desc(), F.length(F.coalesce("description", F.lit(""))).desc()]


def by_word(title: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(title, " "), lambda w: w != "")), " ")


def _pairs(known: DataFrame, value: str, forms: list[str], least: float) -> DataFrame:
    """x, y, score: classes of one date and of sides that may meet, whose values are equal or similar. Equal values are compared once."""
    values = known.groupBy("start_date", value).agg(F.min("id").alias("of"), F.bit_or("sides").alias("sides"), F.count(F.lit(1)).alias("n"), *[F.first(f).alias(f) for f in forms if f != value])
    values = staged(values.withColumnRenamed("of", "id"), "dedup-values")
    alike = matching.scored_tiles(values, "start_date", forms, least).union(values.filter("n > 1").select(F.col("id").alias("x"), F.col("id").alias("y"), F.lit(1.0).alias("score")))
    at = known.alias("k").join(values.alias("v"), F.col("k.start_date").eqNullSafe(F.col("v.start_date")) & (F.col(f"k.{value}") == F.col(f"v.{value}"))).select("k.id", "k.sides", "k._city", "k._url", F.col("v.id").alias("of"))
    at = staged(at, "dedup-of-values")
    one, two = at.alias("a"), at.alias("b")
    both = staged(alike, "dedup-alike").join(one, F.col("x") == F.col("a.of")).join(two, F.col("y") == F.col("b.of"))
    meet = ((F.col("x") != F.col("y")) | (F.col("a.id") < F.col("b.id"))) & (F.col("a.sides").bitwiseOR(F.col("b.sides")) == 3)
    near = F.coalesce((F.col("a._city") == "") | (F.col("b._city") == "") | (F.col("a._city") == F.col("b._city")), F.lit(True))
    return both.filter(meet & near).select(F.least("a.id", "b.id").alias("x"), F.greatest("a.id", "b.id").alias("y"), "score", F.col("a._url").alias("one"), F.col("b._url").alias("two"))


def _like(classes: DataFrame) -> DataFrame:
    """x, y: ids of the classes of one date that are the same event. classes: id, start_date, _title, _url, _city, maybe side.

    Titles need SAME less a tenth of a url's similarity below URL_SAME, whole or with their words sorted; else the urls are
    nearly equal. Both are searched for by filters that miss none."""
    sides = F.col("side") + 1 if "side" in classes.columns else F.lit(3)
    known = classes.withColumns({"_title": F.coalesce("_title", F.lit("")), "_url": F.coalesce("_url", F.lit("")), "sides": sides}).withColumn("_words", by_word(F.col("_title")))
    titles = _pairs(known, "_title", ["_title", "_words"], SAME - 0.1 * URL_SAME)
    urls = _pairs(known.filter("_url <> ''"), "_url", ["_url"], URL_SAME).select("x", "y")
    sure = titles.filter(F.col("score") >= SAME).select("x", "y")
    with_url = titles.filter(F.col("score") < SAME).filter(F.col("score") + 0.1 * url_similarity("one", "two") >= SAME).select("x", "y")
    return sure.union(with_url).union(urls).distinct()


def clusters(df: DataFrame, order: str) -> DataFrame:
    """Greedy single-link clusters within a start date, in order of a unique whole number: each record joins the
    first cluster that has a member like it, or begins one. Adds `cluster`, the order of its first member (M07).

    What a record joins is the smallest number that steps to earlier records like it lead to. Records that are equal in
    title, url, city and date form a class; classes are paired, and a record steps to the last earlier one of its own and of each
    class like it, which leads to all that earlier ones lead to."""
    k = keyed(df).select(F.col(order).cast("long").alias("n"), "start_date", "_title", "_url", "_city")
    equal = ["start_date", "_title", "_url", "_city"]
    classes = staged(k.groupBy(*equal).agg(F.min("n").alias("id")), "dedup-classes")
    same = F.lit(True)
    for c in equal:
        same = same & F.col(f"k.{c}").eqNullSafe(F.col(f"c.{c}"))
    members = staged(k.alias("k").join(classes.alias("c"), same).select("k.n", F.col("c.id").alias("of")), "dedup-members")
    like = staged(_like(classes), "dedup-like")
    before = F.lag("n").over(Window.partitionBy("of").orderBy("n"))
    own = members.withColumn("last", before).filter("last is not null").select(F.col("n").alias("id"), F.explode(F.array_distinct(F.array("last", "of"))).alias("to"))
    sides = like.join(members, F.col("of") == F.col("x")).select("x", "y", "n", F.lit(0).alias("side")).union(like.join(members, F.col("of") == F.col("y")).select("x", "y", "n", F.lit(1).alias("side")))
    seen = Window.partitionBy("x", "y").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda side: F.last(F.when(F.col("side") == side, F.col("n")), ignorenulls=True).over(seen)
    across = sides.withColumn("to", F.when(F.col("side") == 0, last(1)).otherwise(last(0))).filter("to is not null").select(F.col("n").alias("id"), "to")
    edges = staged(own.union(across).distinct(), "dedup-edges")
    first = matching.first_reachable(edges)
    return df.join(first, F.col(order).cast("long") == first["id"], "left").withColumn("cluster", F.coalesce("first", F.col(order).cast("long"))).drop("id", "first")


def survivors(clustered: DataFrame, order: str) -> DataFrame:
    w = Window.partitionBy("cluster").orderBy(*richness(), F.col(order))
    return clustered.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def resolve(new: DataFrame, catalog: DataFrame, order: str) -> DataFrame:
    """New records that no active catalog record of the same date (and known city) repeats (J05). Equal ones of a side are compared once."""
    cols = ["start_date", "_title", "_url", "_city", "_place"]
    named = lambda df, side: keyed(df).withColumn("_place", fold(F.col("city"))).select("key", *cols, F.lit(side).alias("side"))
    both = named(new, 1).union(named(catalog.filter("status = 'active'"), 0))
    grouped = both.groupBy("side", *cols).agg(F.min("key").alias("least"), F.max("key").alias("most"))
    classes = staged(grouped.withColumn("id", F.monotonically_increasing_id()), "resolve-classes")
    like = _like(classes)
    one, two = classes.alias("n"), classes.alias("c")
    pairs = like.select(F.explode(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))).alias("p")).select("p.*")
    met = pairs.join(one.filter("n.side = 1"), F.col("x") == F.col("n.id")).join(two.filter("c.side = 0"), F.col("y") == F.col("c.id"))
    near = met.filter(F.col("n._place").isNull() | F.col("c._place").isNull() | (F.col("n._place") == F.col("c._place")))
    held = near.groupBy(*[F.col(f"n.{c}").alias(f"n{c}") for c in cols]).agg(F.min("c.least").alias("least"), F.max("c.most").alias("most"))
    k = keyed(new).withColumn("_place", fold(F.col("city")))
    same = F.lit(True)
    for c in cols:
        same = same & F.col(c).eqNullSafe(F.col(f"n{c}"))
    repeated = k.join(held, same & ((F.col("least") != F.col("key")) | (F.col("most") != F.col("key")))).select(F.col(order)).distinct()
    return new.join(repeated, order, "left_anti")


def keep_best_rank(results: DataFrame) -> DataFrame:
    """The best (smallest non-zero) rank of each url."""
    w = Window.partitionBy("url").orderBy(F.when(F.col("rank") > 0, F.col("rank")).asc_nulls_last(), "ord")
    return results.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
