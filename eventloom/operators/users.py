"""Interaction logs to weighted profiles and recommendations."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.scoring import freshness, jaccard, trending
from eventloom.functions.text import TECHNOLOGIES, TOPICS, audiences, detect_city, difficulty, labels, literal_map, normalize_city, skills
from eventloom.session import ship
from eventloom.staging import staged

# Strength of each kind of interaction, recommendation weights, order of reasons.
INTERACTIONS = {"attend": 5.0, "register": 3.0, "save": 3.0, "click": 1.5, "view": 1.0, "search": 1.0, "ignore": -1.0, "unsave": -2.0}
RECOMMEND = {"interest": 0.6, "freshness": 0.15, "trending": 0.15, "similarity": 0.10}
PRIORITY = {"community": 0, "organizer": 0, "topic": 1, "tech": 2, "city": 3, "category": 4}


#: Kinds of records (distinct features) that are sent to the users' tasks at a time.
MOST_KINDS = 50_000


def enriched(catalog: DataFrame) -> DataFrame:
    """The catalog with topics, technologies, level, audiences and skills from its text."""
    text = F.concat_ws(" ", "title", F.coalesce("description", F.lit("")))
    e = catalog.withColumns({"topics": labels(text, TOPICS), "technologies": labels(text, TECHNOLOGIES), "level": difficulty(text, F.col("category"))})
    return e.withColumns({"audiences": audiences(F.col("topics"), F.col("category"), F.col("level")), "skills": skills(F.col("topics"), F.col("category"))})


def features(enrichment: bool = False, hosts: bool = False) -> Column:
    """Namespaced features of a record; with the columns of `enriched`, and with its community and organizer."""
    ns = lambda n, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{n}:"), c))
    some = lambda n, c: F.transform(c, lambda x: F.concat(F.lit(f"{n}:"), x))
    own = [
        ns("category", F.col("category")), ns("city", normalize_city(F.col("city"))),
        F.when(F.col("is_online"), "format:online").otherwise("format:offline"),
        F.when(F.col("is_free"), "budget:free").when(~F.col("is_free"), "budget:paid"),
    ]
    if enrichment:
        own.append(ns("difficulty", F.col("level")))
    if hosts:
        own += [ns("community", F.col("community")), ns("organizer", F.col("organizer"))]
    every = F.array_compact(F.array(*own))
    if enrichment:
        every = F.concat(every, some("topic", "topics"), some("tech", "technologies"), some("audience", "audiences"))
    return F.array_distinct(every)


def traits() -> Column:
    """What the similarity of two records is judged by: topics, technologies and skills."""
    some = lambda n, c: F.transform(c, lambda x: F.concat(F.lit(f"{n}:"), x))
    return F.array_distinct(F.concat(some("topic", "topics"), some("tech", "technologies"), some("skill", "skills")))


def query_features(query: Column) -> Column:
    """Features that a search names: topics, technologies, a city."""
    some = lambda n, c: F.transform(c, lambda x: F.concat(F.lit(f"{n}:"), x))
    city = detect_city(query)
    return F.concat(some("topic", labels(query, TOPICS)), some("tech", labels(query, TECHNOLOGIES)), F.array_compact(F.array(F.when(city.isNotNull(), F.concat(F.lit("city:"), city)))))


def profile(log: DataFrame, feats: DataFrame) -> DataFrame:
    """user_id, feature, weight: sums of interaction weights over the features of the records.

    The log is summed per user and record before it meets the features, so that active pairs cross the join once."""
    w = F.coalesce(F.try_element_at(literal_map(INTERACTIONS), F.col("type")), F.lit(0.0))
    per = log.filter("event_key is not null").groupBy("user_id", F.col("event_key").alias("key")).agg(F.sum(w).alias("w"))
    return per.join(feats, "key").select("user_id", "w", F.explode("features").alias("feature")).groupBy("user_id", "feature").agg(F.sum("w").alias("weight"))


def engaged(log: DataFrame) -> DataFrame:
    """user_id, key: saved and not unsaved since, or attended and not only registered since."""
    key = F.col("event_key").alias("key")
    last = lambda kinds, want: log.filter(F.col("type").isin(*kinds)).groupBy("user_id", key).agg(F.max_by("type", "at").alias("last")).filter(F.col("last") == want).select("user_id", "key")
    return last(("save", "unsave"), "save").union(last(("register", "attend"), "attend")).distinct()


def _by_user(pairs: DataFrame, name: str, key: str, value: str) -> DataFrame:
    return pairs.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct(key, value))).alias(name))


def recommend(catalog: DataFrame, log: DataFrame, now: Column, limit: int, hosts: DataFrame | None = None) -> DataFrame:
    """user_id, key, score, rank, similar: upcoming records that the user has not engaged with.

    The score is interest (the profile's weight for the record's features, over the best of the user's candidates),
    freshness, trending, and the best Jaccard similarity to a record that the user has engaged with. The first and the
    last depend on the record's features and traits alone, so users meet kinds of records (distinct features and traits), not
    records; of the kinds that can hold one of a user's best, only the best records join. Scores have four places,
    so records whose scores before rounding are that close are kept until the keys decide.

    hosts: key, community, organizer (graph.entity_maps)."""
    rec = enriched(catalog)
    if hosts is not None:
        rec = rec.join(hosts, "key", "left")
    rec = rec.withColumns({"features": features(True, hosts is not None), "traits": traits()})
    rec = rec.withColumn("kind", F.md5(F.concat_ws("\n", F.concat_ws("\t", F.array_sort("features")), F.concat_ws("\t", F.array_sort("traits"))).cast("binary")))
    base = RECOMMEND["freshness"] * freshness(F.col("first_seen_at"), F.col("start_date"), F.col("version"), now) + RECOMMEND["trending"] * trending(now)
    # Texts are read once; what is kept of a record is small.
    rec = staged(rec.select("key", "kind", "features", "traits", (F.col("start_date") >= F.to_date(now)).alias("ahead"), base.alias("base")), "recommend-records")
    up = rec.filter("ahead")
    held = engaged(log).join(rec.select("key", "kind", "traits", "ahead"), "key")

    kinds = up.groupBy("kind").agg(F.any_value("features").alias("features"), F.any_value("traits").alias("traits"), F.count(F.lit(1)).alias("n"), F.max("base").alias("top"))
    alike = lambda: F.md5(F.concat_ws("\t", F.array_sort("traits")).cast("binary"))
    kinds = kinds.withColumn("alike", alike())
    # Similarity of distinct sets of traits, through shared traits.
    wanted = kinds.select("alike", "traits").distinct()
    own = held.select("user_id", alike().alias("mine"), "traits").distinct()
    mine = own.select("mine", F.col("traits").alias("other")).distinct()
    meets = wanted.select("alike", "traits", F.explode("traits").alias("t")).join(mine.select("mine", "other", F.explode("other").alias("t")), "t").select("alike", "mine", jaccard(F.col("traits"), F.col("other")).alias("sim")).distinct()
    sims = own.select("user_id", "mine").join(meets, "mine").groupBy("user_id", "alike").agg(F.max("sim").alias("sim"))
    took = held.filter("ahead").groupBy("user_id", "kind").agg(F.count(F.lit(1)).cast("int").alias("took"))

    people = _by_user(profile(log, rec.select("key", "features")), "prof", "feature", "weight")
    people = people.join(_by_user(sims, "sims", "alike", "sim"), "user_id", "left").join(_by_user(took, "taken", "kind", "took"), "user_id", "left")
    chosen = _chosen(people, kinds.select("kind", "features", "alike", "n", "top"), limit)

    # Records of a kind by steps of one place of the score: `above` counts those that are ahead whatever the rounding.
    most = limit + (took.agg(F.max("took")).first()[0] or 0)
    step = F.floor(F.col("base") * 10_000)
    lists = up.select("kind", "key", "base", step.alias("step")).withColumn("kr", F.row_number().over(Window.partitionBy("kind", "base").orderBy("key"))).filter(F.col("kr") <= most)
    steps = lists.groupBy("kind", "step").agg(F.count(F.lit(1)).alias("c")).withColumn("above", F.coalesce(F.sum("c").over(Window.partitionBy("kind").orderBy(F.desc("step")).rangeBetween(Window.unboundedPreceding, -2)), F.lit(0))).drop("c")
    lists = lists.join(steps, ["kind", "step"]).filter(F.col("above") < most)
    cand = chosen.join(lists, "kind").filter((F.col("above") < limit + F.col("took")) & (F.col("kr") <= limit + F.col("took")))
    cand = cand.join(held.filter("ahead").select("user_id", "key"), ["user_id", "key"], "left_anti")
    scored = cand.withColumn("score", F.bround(F.col("own") + F.col("base"), 4))
    w = Window.partitionBy("user_id").orderBy(F.desc("score"), "key")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).select("user_id", "key", "score", "rank", "similar")


_CHOSEN = "user_id string, kind string, own double, took int, similar boolean"


def _chosen(people: DataFrame, kinds: DataFrame, limit: int) -> DataFrame:
    """user_id, kind, own, took, similar: the kinds that can hold one of a user's best `limit` records.

    Kinds go to the users' tasks in blocks of MOST_KINDS, where a user's weights are summed over the features of all
    kinds of a block at once. With several blocks, a first pass finds the user's best interest over all of them."""
    spark = people.sparkSession
    ship(spark)
    blocks, held = [], []
    for r in kinds.toLocalIterator():
        held.append((r.kind, r.features, r.alike, r.n, r.top))
        if len(held) >= MOST_KINDS:
            blocks.append(spark.sparkContext.broadcast(held))
            held = []
    if held or not blocks:
        blocks.append(spark.sparkContext.broadcast(held))
    people = people.select("user_id", *[F.map_entries(c).alias(c) for c in ("prof", "sims", "taken")])
    if len(blocks) == 1:
        return people.withColumn("best", F.lit(None).cast("double")).mapInArrow(partial(_own_kinds, block=blocks[0], limit=limit), _CHOSEN)
    each = reduce(DataFrame.unionByName, [people.withColumn("best", F.lit(None).cast("double")).mapInArrow(partial(_best_raw, block=b), "user_id string, best double") for b in blocks])
    known = people.join(each.groupBy("user_id").agg(F.max("best").alias("best")), "user_id")
    return reduce(DataFrame.unionByName, [known.mapInArrow(partial(_own_kinds, block=b, limit=limit), _CHOSEN) for b in blocks])


def _judged(batches: Iterator[pa.RecordBatch], block) -> Iterator[tuple]:
    """user_id, best, raw interest, similarity and records taken by kind, of each user."""
    rows = block.value
    names = {f: i for i, f in enumerate(sorted({f for r in rows for f in r[1]}))}
    flat = np.array([names[f] for r in rows for f in r[1]], np.int64)
    start = np.concatenate([[0], np.cumsum([len(r[1]) for r in rows])[:-1]]).astype(np.int64) if rows else np.zeros(0, np.int64)
    place = {r[0]: i for i, r in enumerate(rows)}
    alikes: dict[str, list[int]] = {}
    for i, r in enumerate(rows):
        alikes.setdefault(r[2], []).append(i)
    for b in batches:
        for user, prof, sims, taken, best in zip(*(b.column(c).to_pylist() for c in ("user_id", "prof", "sims", "taken", "best")), strict=True):
            w = np.zeros(len(names))
            for e in prof or ():
                if e["key"] in names:
                    w[names[e["key"]]] = e["value"]
            raw = np.add.reduceat(w[flat], start) if len(rows) else np.zeros(0)
            sim, took = np.zeros(len(rows)), np.zeros(len(rows), np.int64)
            for e in sims or ():
                sim[alikes.get(e["key"], [])] = e["value"]
            for e in taken or ():
                if e["key"] in place:
                    took[place[e["key"]]] = e["value"]
            yield user, best, raw, sim, took, len(taken or ())


def _best_raw(batches: Iterator[pa.RecordBatch], block) -> Iterator[pa.RecordBatch]:
    n = np.array([r[3] for r in block.value], np.int64)
    got = [(user, float(raw[n > took].max(initial=0.0))) for user, _, raw, _, took, _ in _judged(batches, block)]
    yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], names=["user_id", "best"])


def _own_kinds(batches: Iterator[pa.RecordBatch], block, limit: int) -> Iterator[pa.RecordBatch]:
    rows = block.value
    n, top = np.array([r[3] for r in rows], np.int64), np.array([r[4] for r in rows], np.float64)
    for user, best, raw, sim, took, kinds_taken in _judged(batches, block):
        open_ = np.flatnonzero(n > took)
        if not len(open_):
            continue
        best = raw[open_].max() if best is None else best
        own = RECOMMEND["interest"] * (np.maximum(raw[open_], 0) / best if best > 0 else np.zeros(len(open_))) + RECOMMEND["similarity"] * sim[open_]
        bound = own + top[open_]
        # A kind whose best record the user has taken may fall behind, so as many more are kept; 2e-4 is more than rounding can turn.
        few = min(len(bound), limit + kinds_taken)
        at = np.flatnonzero(bound >= np.partition(bound, -few)[-few] - 2e-4)
        k = open_[at]
        yield pa.RecordBatch.from_arrays(
            [pa.array([user] * len(at), pa.string()), pa.array([rows[i][0] for i in k], pa.string()), pa.array(own[at]), pa.array(took[k], pa.int32()), pa.array(sim[k] > 0)], names=["user_id", "kind", "own", "took", "similar"]
        )


def reasons(top: DataFrame, feats: DataFrame, prof: DataFrame, log: DataFrame, most: int = 3) -> DataFrame:
    """user_id, key, reasons of recommended records (user_id, key, similar): phrases of the features of positive weight, by
    namespace, weight, name; then the similarity to records that the user has engaged with (R14)."""
    went = log.filter("type = 'attend'").select("user_id").distinct().withColumn("went", F.lit(True))
    matched = top.join(feats, "key").select("user_id", "key", F.explode("features").alias("feature")).join(prof.filter("weight > 0"), ["user_id", "feature"]).join(went, "user_id", "left")
    ns, value = F.substring_index("feature", ":", 1), F.expr("substr(feature, locate(':', feature) + 1)")
    prio = F.coalesce(F.try_element_at(literal_map(PRIORITY), ns), F.lit(9))
    phrase = (
        F.when(ns.isin("community", "organizer"), F.concat(F.lit("Recommended because you follow "), value, F.lit(".")))
        .when((ns == "topic") & F.col("went"), F.concat(F.lit("Recommended because you frequently attend "), value, F.lit(" events.")))
        .when(ns.isin("topic", "tech"), F.concat(F.lit("Recommended because you're interested in "), value, F.lit(".")))
        .when(ns == "city", F.concat(F.lit("Recommended because you attend events in "), value, F.lit(".")))
        .when(ns == "category", F.concat(F.lit("Recommended because you like "), value, F.lit(" events.")))
    )
    rows = matched.select("user_id", "key", F.struct(prio.alias("p"), (-F.col("weight")).alias("w"), F.col("feature").alias("f"), phrase.alias("phrase")).alias("r"))
    got = rows.groupBy("user_id", "key").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    said = F.array_distinct(F.filter(F.transform(F.coalesce("rs", F.expr("cast(array() as array<struct<p:int,w:double,f:string,phrase:string>>)")), lambda r: r["phrase"]), lambda x: x.isNotNull()))
    alike = F.array(F.lit("Recommended because it's similar to events you've engaged with."))
    every = F.when(F.col("similar"), F.concat(F.slice(said, 1, most - 1), alike)).otherwise(F.slice(said, 1, most))
    full = top.select("user_id", "key", "similar").join(got, ["user_id", "key"], "left").select("user_id", "key", every.alias("reasons"))
    return full.withColumn("reasons", F.when(F.size("reasons") > 0, F.col("reasons")).otherwise(F.array(F.lit("Recommended based on freshness and trending signals."))))


def acceptance(shown: DataFrame, engaged_keys: DataFrame) -> DataFrame:
    """Share of the shown records that the user engaged with."""
    e = engaged_keys.select("user_id", "key").distinct().withColumn("hit", F.lit(1))
    return shown.select("user_id", "key").distinct().join(e, ["user_id", "key"], "left").groupBy("user_id").agg(F.count(F.lit(1)).alias("shown"), F.count("hit").alias("accepted"), F.round(F.count("hit") / F.count(F.lit(1)), 4).alias("rate"))
