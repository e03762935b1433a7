"""The registered queries of the engine, each with the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.functions import confidence as C
from eventloom.functions import scoring as S
from eventloom.functions import text as T
from eventloom.functions import urls as U
from eventloom.operators import analytics as A
from eventloom.operators import control, crawl, dedup, extract, graph, merge, paging, scans, search, users
from eventloom.operators.predicates import Query, by_free, end, overlaps, quality_gate, recently_added, this_month, this_weekend, where
from eventloom.plans.adapters import CATALOG_SQL, DISCOVERY_SQL, LOG_SQL, NOW, RUNS_SQL, TODAY, catalog, discovery, log, read, runs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _today():
    return F.lit(TODAY).cast("date")


def _now():
    return F.lit(NOW).cast("timestamp")



def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


_WORDY = r"[^\p{L}\p{N}_]"


def re2(pattern: str) -> str:
    """A pattern with Unicode word borders spelled out, since RE2's are ASCII; case is lowered on both sides."""
    out = []
    for part in pattern.split("|"):
        lead, tail = part.startswith(r"\b"), part.endswith(r"\b")
        core = part[2:] if lead else part
        core = core[:-2] if tail else core
        out.append((f"(^|{_WORDY})" if lead else "") + f"({core})" + (f"($|{_WORDY})" if tail else ""))
    return "|".join(out).replace("'", "''")


_CITY_SQL = "CASE lower(trim(city)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.CITIES.items()) + " ELSE trim(city) END"
_END = "coalesce(end_date, start_date)"

# --- filters, pages ---------------------------------------------------------------------

_Q1 = Query(city="Delhi", categories=["meetup", "workshop", "hackathon"], date_from="2026-07-01", date_to="2026-12-31")


@query(f"{CATALOG_SQL} SELECT key, start_date FROM catalog WHERE status = 'active' AND lower(city) = 'delhi' AND category IN ('meetup','workshop','hackathon') AND {_END} >= date '2026-07-01' AND start_date <= date '2026-12-31' AND {_END} >= date '{TODAY}'")
def q_structured_filter(spark, d):
    return catalog(spark, d).filter(where(_Q1, upcoming=TODAY)).select("key", "start_date")


@query(f"{CATALOG_SQL} SELECT key, start_date, end_date FROM catalog WHERE {_END} >= date '2026-08-01' AND start_date <= date '2026-08-20'")
def q_interval_overlap(spark, d):
    return catalog(spark, d).filter(overlaps("2026-08-01", "2026-08-20")).select("key", "start_date", "end_date")


@query(f"{CATALOG_SQL} SELECT count(*) FILTER (WHERE is_free IS NOT DISTINCT FROM true) AS free, count(*) FILTER (WHERE is_free IS NOT DISTINCT FROM false) AS paid, count(*) AS n FROM catalog")
def q_tristate_filter(spark, d):
    return catalog(spark, d).agg(F.count_if(by_free(True)).alias("free"), F.count_if(by_free(False)).alias("paid"), F.count(F.lit(1)).alias("n"))


@query(f"{CATALOG_SQL} SELECT key, category FROM catalog WHERE status='active' AND (contains(lower(concat_ws(' ', title, coalesce(description,''))), 'trash') OR contains(lower(concat_ws(' ', title, coalesce(description,''))), 'mail'))")
def q_keyword_filter(spark, d):
    return catalog(spark, d).filter(where(Query(keywords=["trash", "mail"]))).select("key", "category")


@query(f"{CATALOG_SQL} SELECT key, start_date FROM catalog WHERE status='active' AND (start_date > date '2026-08-01' OR (start_date = date '2026-08-01' AND key > 'x.example.com/e')) ORDER BY start_date, key LIMIT 51")
def q_keyset_page(spark, d):
    return paging.keyset_page(catalog(spark, d).filter("status = 'active'").select("key", "start_date"), 50, ("2026-08-01", "x.example.com/e"))


@query(f"""{CATALOG_SQL}, o AS (SELECT key, start_date, {_END} < date '{TODAY}' AS past FROM catalog WHERE category = 'meetup')
SELECT key, start_date, (SELECT count(*) FROM o) AS total FROM o ORDER BY past, CASE WHEN NOT past THEN start_date END, CASE WHEN NOT past THEN key END, CASE WHEN past THEN start_date END DESC, CASE WHEN past THEN key END DESC LIMIT 24 OFFSET 10""")
def q_offset_page_total(spark, d):
    c = catalog(spark, d).filter("category = 'meetup'").select("key", "start_date", "end_date")
    return paging.offset_page(c, paging.browse_order(_today()), 10, 24).select("key", "start_date", "total")


@query(f"{CATALOG_SQL} SELECT category, city_norm, key FROM (SELECT category, {_CITY_SQL} AS city_norm, key, row_number() OVER (PARTITION BY category ORDER BY start_date, key) AS rn FROM catalog WHERE {_END} >= date '{TODAY}') WHERE rn <= 5")
def q_top_per_category(spark, d):
    c = catalog(spark, d).filter(end() >= _today()).withColumn("city_norm", T.normalize_city(F.col("city")))
    return paging.top_per(c, ["category"], [F.col("start_date"), F.col("key")], 5).select("category", "city_norm", "key")


@query(f"{CATALOG_SQL} SELECT key FROM (SELECT key, start_date, row_number() OVER (PARTITION BY category ORDER BY start_date, key) AS rn FROM catalog) ORDER BY rn > 1, start_date, key LIMIT 12")
def q_stratified_sample(spark, d):
    return paging.stratified(catalog(spark, d).select("key", "category", "start_date"), "category", [F.col("start_date"), F.col("key")], 12).select("key")


@query(f"{CATALOG_SQL} SELECT key, start_date <= date '2026-07-19' AND {_END} >= date '2026-07-18' AS weekend, date_trunc('month', start_date) = date '2026-07-01' AS month, epoch_us(first_seen_at) >= epoch_us(timestamp '{NOW}' - INTERVAL 7 DAY) AS recent FROM catalog")
def q_date_browse(spark, d):
    return catalog(spark, d).select("key", this_weekend(_today()).alias("weekend"), this_month(_today()).alias("month"), recently_added(_now()).alias("recent"))


@query(f"{CATALOG_SQL} SELECT count(*) AS fetched, count(*) FILTER (WHERE trim(title) = '') AS untitled, count(*) FILTER (WHERE {_END} < date '{TODAY}') AS ended, count(*) FILTER (WHERE city IS NULL) AS no_city, count(*) FILTER (WHERE price IS NULL) AS no_price FROM catalog")
def q_quality_gate(spark, d):
    g = quality_gate(catalog(spark, d), _today())
    has = lambda r: F.count_if(F.array_contains("reasons", r))
    return g.agg(F.count(F.lit(1)).alias("fetched"), has("empty title").alias("untitled"), has("already ended").alias("ended"), F.count_if(F.col("city").isNull()).alias("no_city"), F.count_if(F.col("price").isNull()).alias("no_price"))


# --- scores -------------------------------------------------------------------------------

_SOURCE = "CASE provider " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in S.SOURCE_QUALITY.items()) + " ELSE 0.5 END"
_COMPLETE = " + ".join(f"CAST({c} IS NOT NULL AS INTEGER)" for c in S.OPTIONAL)
_HAY, _DAYS = "lower(concat_ws(' ', title, coalesce(description, '')))", f"(start_date - date '{TODAY}')"
_REL = f"(least(1.0, (CAST(contains({_HAY},'trash') AS INT) + CAST(contains(lower(title),'trash') AS INT) + CAST(contains({_HAY},'the') AS INT) + CAST(contains(lower(title),'the') AS INT)) / 4.0) + CASE WHEN category IN ('meetup') THEN 1.0 ELSE 0.0 END) / 2"
_LOC = f"CASE WHEN coalesce({_CITY_SQL} = 'Bangalore', false) THEN 1.0 WHEN is_online THEN 0.5 ELSE 0.0 END"
_POP = "least(1.0, coalesce(0.5 * least(1.0, length(description) / 200.0), 0.0) + CASE WHEN is_free IS NOT NULL THEN 0.25 ELSE 0 END + CASE WHEN coalesce(location,'') <> '' THEN 0.15 ELSE 0 END + CASE WHEN end_date IS NOT NULL THEN 0.10 ELSE 0 END)"
_DATE = f"CASE WHEN {_DAYS} < 0 THEN 0.0 ELSE 1.0 / (1.0 + {_DAYS} / 30.0) END"
_RANK = f"0.40 * {_REL} + 0.20 * {_DATE} + 0.15 * {_LOC} + 0.10 * {_SOURCE} + 0.10 * {_POP} + 0.05 * ({_COMPLETE}) / 6.0"
_FRESH = f"round_even(0.5 * (1.0 / (1.0 + greatest(0.0, (epoch_us(timestamp '{NOW}') - epoch_us(first_seen_at)) / 86400000000.0) / 30.0)) + 0.4 * CASE WHEN {_DAYS} >= 0 THEN 1.0 / (1.0 + {_DAYS} / 30.0) ELSE 0.0 END + CASE WHEN version > 1 THEN 0.1 ELSE 0.0 END, 4)"
_TREND = f"round_even(0.35 * {_SOURCE} + 0.30 * {_FRESH} + 0.20 * least(1.0, ({_COMPLETE}) / 6.0) + 0.15 * least(1.0, (version - 1) / 3.0), 4)"


@query(f"{CATALOG_SQL} SELECT key, round(CAST({_RANK} AS DOUBLE), 6) AS score FROM catalog")
def q_rank_six_term(spark, d):
    return catalog(spark, d).select("key", F.round(S.rank_score(["trash", "the"], ["meetup"], "Bangalore", _today()), 6).alias("score"))


@query(f"{CATALOG_SQL} SELECT key, CAST({_FRESH} AS DOUBLE) AS freshness FROM catalog")
def q_freshness(spark, d):
    return catalog(spark, d).select("key", S.freshness(F.col("first_seen_at"), F.col("start_date"), F.col("version"), _now()).alias("freshness"))


@query(f"{CATALOG_SQL} SELECT key, CAST({_TREND} AS DOUBLE) AS score FROM catalog WHERE start_date >= date '{TODAY}' ORDER BY score DESC, key LIMIT 10")
def q_trending_topn(spark, d):
    return catalog(spark, d).filter(F.col("start_date") >= _today()).select("key", S.trending(_now()).alias("score")).orderBy(F.desc("score"), "key").limit(10)


_STATE = f"CASE WHEN status = 'archived' THEN 'archived' WHEN date '{TODAY}' - {_END} > 90 THEN 'archived' WHEN {_END} < date '{TODAY}' THEN 'completed' WHEN start_date <= date '{TODAY}' THEN 'live_today' WHEN start_date <= date '{TODAY}' + 7 THEN 'registration_closing' ELSE 'upcoming' END"


@query(f"{CATALOG_SQL} SELECT {_STATE} AS state, count(*) AS n FROM catalog GROUP BY 1")
def q_lifecycle_dist(spark, d):
    return catalog(spark, d).groupBy(merge.lifecycle(_today()).alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{CATALOG_SQL} SELECT count(*) FILTER (WHERE start_date > date '{TODAY}' AND start_date <= date '{TODAY}' + 7) AS closing, count(*) FILTER (WHERE start_date <= date '{TODAY}') AS closed, count(*) FILTER (WHERE start_date <= date '{TODAY}' AND {_END} >= date '{TODAY}') AS running FROM catalog")
def q_registration(spark, d):
    r = catalog(spark, d).select(merge.registration(_today()).alias("r"))
    return r.agg(F.count_if("r.closing_soon").alias("closing"), F.count_if("r.closed").alias("closed"), F.count_if("r.event_started").alias("running"))


@query(f"{CATALOG_SQL}, e AS (SELECT {_END} AS e, CASE WHEN status = 'active' AND {_END} < date '{TODAY}' THEN 'expired' ELSE status END AS s FROM catalog) SELECT CASE WHEN s = 'expired' AND e < date '2026-06-15' THEN 'archived' ELSE s END AS status, count(*) AS n FROM e GROUP BY 1")
def q_expire_archive(spark, d):
    return merge.archive(merge.expire(catalog(spark, d), _today()), F.lit("2026-06-15").cast("date")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


# --- merge, change detection --------------------------------------------------------------


def _previous(c: DataFrame) -> DataFrame:
    i = F.col("doc_id")
    return c.filter("doc_id % 10 <> 0").withColumns({
        "status": F.lit("active"), "content_hash": F.when(i % 4 == 0, F.lit("old")).otherwise(F.col("content_hash")),
        "location": F.when(i % 8 == 0, F.lit("Old Hall")).otherwise(F.col("location")), "price": F.when(i % 12 == 4, F.lit("INR 1")).otherwise(F.col("price")),
        "start_date": F.when(i % 16 == 4, F.date_add("start_date", 1)).otherwise(F.col("start_date")),
    })


@query(f"""{CATALOG_SQL}, prev AS (SELECT key, 'active' AS status, CASE WHEN doc_id % 4 = 0 THEN 'old' ELSE content_hash END AS content_hash, CASE WHEN doc_id % 8 = 0 THEN 'Old Hall' ELSE location END AS location,
  CASE WHEN doc_id % 12 = 4 THEN 'INR 1' ELSE price END AS price, is_free, CASE WHEN doc_id % 16 = 4 THEN start_date + 1 ELSE start_date END AS start_date, end_date FROM catalog WHERE doc_id % 10 <> 0),
j AS (SELECT c.*, p.key AS pk, p.location AS pl, p.price AS pp, p.is_free AS pf, p.start_date AS ps, p.end_date AS pe, p.content_hash AS ph, p.status AS pst FROM catalog c LEFT JOIN prev p USING (key)),
k AS (SELECT *, CASE WHEN pk IS NULL THEN 'NEW' WHEN status = 'withdrawn' AND pst <> 'withdrawn' THEN 'CANCELLED' WHEN status = 'expired' AND pst <> 'expired' THEN 'EXPIRED' WHEN content_hash <> ph THEN 'UPDATED' END AS change FROM j)
SELECT key, change FROM k WHERE change IS NOT NULL UNION ALL SELECT key, 'VENUE_CHANGED' FROM k WHERE change = 'UPDATED' AND location IS DISTINCT FROM pl
UNION ALL SELECT key, 'COST_CHANGED' FROM k WHERE change = 'UPDATED' AND (is_free IS DISTINCT FROM pf OR price IS DISTINCT FROM pp) UNION ALL SELECT key, 'DATE_CHANGED' FROM k WHERE change = 'UPDATED' AND (start_date IS DISTINCT FROM ps OR end_date IS DISTINCT FROM pe)""")
def q_change_detection(spark, d):
    c = catalog(spark, d)
    return merge.detect_changes(_previous(c), c)


# Old rows and batch overlap, and together they are the whole catalog.
_OLD, _BATCH = "doc_id % 5 <> 0", "(doc_id % 7 <> 0 OR doc_id % 5 = 0)"


@query(f"""{CATALOG_SQL}, old AS (SELECT * FROM catalog WHERE {_OLD}), batch AS (SELECT * REPLACE (CASE WHEN doc_id % 6 = 0 THEN 'new' ELSE content_hash END AS content_hash) FROM catalog WHERE {_BATCH})
SELECT coalesce(o.key, b.key) AS key, CASE WHEN b.key IS NULL THEN 'kept' WHEN o.key IS NULL THEN 'inserted' WHEN o.content_hash = b.content_hash THEN 'touched' ELSE 'updated' END AS action,
 CASE WHEN o.key IS NULL THEN 1 WHEN b.key IS NOT NULL AND o.content_hash <> b.content_hash THEN o.version + 1 ELSE o.version END AS version FROM old o FULL JOIN batch b USING (key)""")
def q_upsert_merge(spark, d):
    c = catalog(spark, d)
    batch = c.filter(_BATCH).withColumn("content_hash", F.when(F.col("doc_id") % 6 == 0, "new").otherwise(F.col("content_hash")))
    return merge.upsert(c.filter(_OLD), batch, F.col("doc_id")).select("key", "action", "version")


@query(f"""{CATALOG_SQL}, l AS (SELECT category, substr(sha256(key), 1, 3) AS b, sha256(concat(key, ':', content_hash)) AS h FROM catalog), p AS (SELECT category, b, sha256(string_agg(h, '' ORDER BY h)) AS h FROM l GROUP BY 1, 2)
SELECT sha256(string_agg(concat(b, h), '' ORDER BY b)) AS checkpoint FROM p GROUP BY category""")
def q_batch_checkpoint(spark, d):
    return merge.checkpoint(catalog(spark, d), "category").select("checkpoint")


@query("SELECT url, rank, ord FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY CASE WHEN rank > 0 THEN rank END NULLS LAST, ord) AS rn FROM (SELECT concat('u', cast(doc_id % 200 AS varchar)) AS url, doc_id % 7 AS rank, doc_id AS ord FROM documents)) WHERE rn = 1")
def q_keep_best_rank(spark, d):
    r = read(spark, d, "documents").select(F.concat(F.lit("u"), (F.col("doc_id") % 200).cast("string")).alias("url"), (F.col("doc_id") % 7).alias("rank"), F.col("doc_id").alias("ord"))
    return dedup.keep_best_rank(r)


@query("SELECT n_regionkey AS k FROM nation INTERSECT SELECT r_regionkey FROM region UNION SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_nationkey > 12")
def q_set_operators(spark, d):
    n, r, c, s = (read(spark, d, t) for t in ("nation", "region", "customer", "supplier"))
    both = n.select(F.col("n_regionkey").alias("k")).intersect(r.select("r_regionkey"))
    return both.union(c.select("c_nationkey")).distinct().subtract(s.filter("s_nationkey > 12").select("s_nationkey"))


@query()
def q_dedup_fuzzy(spark, d):
    c = dedup.clusters(catalog(spark, d).withColumn("url", F.concat("url", F.lit("/"), "category")), "doc_id")
    return dedup.survivors(c, "doc_id").select("doc_id", "cluster")


@query(f"{CATALOG_SQL} SELECT doc_id FROM catalog WHERE status = 'active' AND doc_id % 2 = 1")
def q_cross_source_resolve(spark, d):
    # Every active record comes again from another source, half of them under another title and url.
    c = catalog(spark, d)
    other = F.concat(F.sha1("title"), F.sha1("key"))
    again = c.filter("status = 'active'").withColumns({"key": F.concat(F.lit("n"), "key"), "title": F.when(F.col("doc_id") % 2 == 0, F.concat(F.upper("title"), F.lit(" !"))).otherwise(other), "url": F.concat(F.lit("https://luma.example.org/"), other)})
    return dedup.resolve(again, c, "doc_id").select("doc_id")


# --- search ---------------------------------------------------------------------------------

_BM_TERMS = ["trash", "mail", "rights"]
_TF = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(_BM_TERMS))
_BM_SCORE = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * length / avgdl))" for i in range(3))
_BM25 = f"""w AS (SELECT doc_id AS key, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM documents), c AS (SELECT key, len(w) AS length, {_TF} FROM w),
st AS (SELECT count(*) AS n, avg(length) AS avgdl, {", ".join(f"count(*) FILTER (WHERE tf{i} > 0) AS df{i}" for i in range(3))} FROM c), bm AS (SELECT key, round({_BM_SCORE}, 6) AS score FROM c, st WHERE tf0 > 0 OR tf1 > 0 OR tf2 > 0)"""


@query(f"WITH {_BM25} SELECT key, score FROM bm ORDER BY score DESC, key LIMIT 20")
def q_bm25_topk(spark, d):
    b = search.bm25(read(spark, d, "documents"), "doc_id", F.col("text"), _BM_TERMS)
    return b.select("key", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "key").limit(20)


@query("""WITH a AS (SELECT doc_id AS key, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS rank FROM documents ORDER BY rank LIMIT 100), b AS (SELECT doc_id AS key, row_number() OVER (ORDER BY doc_id % 97, doc_id) - 1 AS rank FROM documents ORDER BY rank LIMIT 100),
u AS (SELECT 'long' AS source, * FROM a UNION ALL SELECT 'mod' AS source, * FROM b) SELECT key, round(sum(1.0 / (60 + rank + 1)), 9) AS score, string_agg(DISTINCT source, '+' ORDER BY source) AS sources FROM u GROUP BY key ORDER BY score DESC, key LIMIT 50""")
def q_rrf_fusion(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("key"), "n_chars")
    a = search.ranked(docs, "long", [F.desc("n_chars"), F.col("key")], 100)
    b = search.ranked(docs, "mod", [F.col("key") % 97, F.col("key")], 100)
    return search.fuse([a, b], 50).select("key", F.round("score", 9).alias("score"), "sources")


@query()
def q_hybrid_search(spark, d):
    q = Query(keywords=["trash", "pune"], categories=["meetup", "webinar", "workshop", "hackathon", "conference"])
    c = catalog(spark, d)
    entities = c.select(T.normalize_city(F.col("city")).alias("name"), "key")
    return search.search(c, q, TODAY, entities).select("key", "rank_score")


@query("""WITH p AS (SELECT url, lower(concat_ws(' ', url, html)) AS hay, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:@]+)', 1)) AS host FROM pages),
h AS (SELECT url, CAST(contains(hay, 'the') AS INT) + CAST(contains(hay, 'trash') AS INT) + CAST(contains(hay, 'login') AS INT) AS hits FROM p WHERE host = 'example.com' OR ends_with(host, '.example.com')) SELECT url, hits, row_number() OVER (ORDER BY hits DESC, url) AS rank FROM h WHERE hits > 0 ORDER BY hits DESC, url LIMIT 25""")
def q_corpus_search(spark, d):
    return search.corpus_search(read(spark, d, "pages"), "example.com", ["the", "trash", "login"], 25)


@query("""WITH q AS (SELECT * FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT q.vec_id AS query, e.vec_id AS id, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])))), 6) AS similarity FROM embeddings e, q WHERE e.vec_id <> q.vec_id)
SELECT query, id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id) AS rn FROM s) WHERE rn <= 10""")
def q_cosine_topk(spark, d):
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return search.cosine_topk(v, v.filter("id % 50 = 0"), 10).select("query", "id", "similarity")


# --- text -----------------------------------------------------------------------------------

_TOPIC_LIST = "[" + ", ".join(f"CASE WHEN regexp_matches(lower(text), '{re2(p)}') THEN '{n}' END" for n, p in (T.TOPICS | {f"tech:{k}": v for k, v in T.TECHNOLOGIES.items()}).items()) + "]"


#: Ends of texts, so that the taxonomy has something to find in the invented prose.
_ENDS = ["AI and MLOps on k8s", "react native, Next.js", "Open-source FOSS start-ups", "c++ gaming club", "an a.i. demo day", "Chatgpt, Gemma; LangChain", "big data with py torch", "CI / CD at scale", "AR/VR nights", "carts and pairs", "microservices on AWS", "pentesters meet infosec", "web3 NFTs", "tea"]
_ENDED = "concat(text, ' ', {ends}[doc_id % " + str(len(_ENDS)) + " + {first}])"


@query(f"SELECT label, count(*) AS n FROM (SELECT unnest({_TOPIC_LIST}) AS label FROM (SELECT {_ENDED.format(ends=_ENDS, first=1)} AS text FROM documents)) WHERE label IS NOT NULL GROUP BY label")
def q_taxonomy_counts(spark, d):
    ended = F.expr(_ENDED.format(ends=f"array({str(_ENDS)[1:-1]})", first=0))
    t = read(spark, d, "documents").select(ended.alias("text"))
    both = F.concat(T.labels(F.col("text"), T.TOPICS), T.labels(F.col("text"), {f"tech:{k}": v for k, v in T.TECHNOLOGIES.items()}))
    return t.select(F.explode(both).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(f"{CATALOG_SQL} SELECT {_CITY_SQL} AS city, count(*) AS n FROM catalog GROUP BY 1")
def q_city_norm(spark, d):
    return catalog(spark, d).groupBy(T.normalize_city(F.col("city")).alias("city")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, trim(regexp_replace(lower(split_part(text, '.', 1)), '[^a-z0-9]+', ' ', 'g')) AS title FROM documents")
def q_normalize_title(spark, d):
    return read(spark, d, "documents").select("doc_id", T.normalize_title(F.substring_index("text", ".", 1)).alias("title"))


# --- urls, pages ------------------------------------------------------------------------------

_HOST = "lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:@]+)', 1))"
_BARE = f"regexp_replace({_HOST}, '^www\\.', '')"
_TWO, _THREE = f"array_to_string(string_split({_BARE}, '.')[-2:], '.')", f"array_to_string(string_split({_BARE}, '.')[-3:], '.')"
_REG = f"CASE WHEN {_TWO} IN ({', '.join(repr(t) for t in U.MULTI_TLDS)}) THEN {_THREE} ELSE {_TWO} END"


@query(f"SELECT {_REG} AS domain, count(*) AS pages FROM pages GROUP BY 1")
def q_domain_counts(spark, d):
    return read(spark, d, "pages").groupBy(U.registrable_domain(F.col("url")).alias("domain")).agg(F.count(F.lit(1)).alias("pages"))


@query(f"SELECT page_id, concat({_BARE}, lower(regexp_replace(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', ''))) AS id FROM pages")
def q_dedup_url(spark, d):
    return read(spark, d, "pages").select("page_id", U.dedup_url(F.col("url")).alias("id"))


@query()
def q_url_canonical(spark, d):
    return read(spark, d, "pages").select("page_id", U.crawl_url(F.col("url")).alias("url"))


@query("SELECT page_id, len(list_distinct(regexp_extract_all(html, '(?i)<a\\b[^>]*\\bhref=[\"'']([^\"''#]+)', 1))) AS links FROM pages")
def q_page_links(spark, d):
    return read(spark, d, "pages").select("page_id", F.size(U.links(F.col("html"))).cast("long").alias("links"))


@query()
def q_strip_tags(spark, d):
    return read(spark, d, "pages").select("page_id", T.strip_tags(F.col("html")).alias("text"))


@query("SELECT page_id, sha1(trim(regexp_replace(html, '\\s+', ' ', 'g'))) AS fp FROM pages")
def q_fingerprint(spark, d):
    return read(spark, d, "pages").select("page_id", extract.fingerprint(F.col("html")).alias("fp"))


@query("""WITH RECURSIVE e AS (SELECT n AS source, (n * 2) % 5000 AS target FROM (SELECT DISTINCT o_custkey AS n FROM orders) UNION SELECT n, (n * 3 + 1) % 5000 FROM (SELECT DISTINCT o_custkey AS n FROM orders)),
r(url, depth) AS (SELECT 1::BIGINT, 0 UNION SELECT e.target, r.depth + 1 FROM r JOIN e ON r.url = e.source WHERE r.depth < 4) SELECT url, min(depth) AS depth FROM r GROUP BY url""")
def q_crawl_bfs(spark, d):
    n = read(spark, d, "orders").select(F.col("o_custkey").alias("source")).distinct()
    edges = n.withColumn("target", F.col("source") * 2 % 5000).union(n.withColumn("target", (F.col("source") * 3 + 1) % 5000))
    return crawl.bfs(edges, spark.range(1, 2).select(F.col("id").alias("url")), 4)


@query(f"SELECT url, domain FROM (SELECT url, {_REG} AS domain, row_number() OVER (PARTITION BY {_REG} ORDER BY length(html) DESC, url) AS rn FROM pages) WHERE rn <= 5")
def q_frontier_budget(spark, d):
    return crawl.frontier(read(spark, d, "pages").select("url", F.length("html").alias("priority")), 5).select("url", "domain")


# --- users --------------------------------------------------------------------------------------

_W = "CASE type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in users.INTERACTIONS.items()) + " ELSE 0 END"
def _found(table: dict[str, str], low: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({low}, '{re2(p)}') THEN '{n}' END" for n, p in table.items()) + "], lambda x: x IS NOT NULL)"


def _stands_for(table: dict[str, list[str]], topics: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items())
    return f"flatten(list_transform({topics}, lambda x: CASE x {cases} ELSE [] END))"


def _named(n: str, xs: str) -> str:
    return f"list_transform({xs}, lambda x: concat('{n}:', x))"


def _first_by_slug(names: str) -> str:
    return f"list_sort(list_transform({names}, lambda x: [trim(regexp_replace(lower(x), '[^a-z0-9]+', '-', 'g'), '-'), x]))[1][2]"


def _level(low: str) -> str:
    bounded = lambda p: f"(^|{_WORDY})" + p.removeprefix(r"\b").removesuffix(r"\b") + f"($|{_WORDY})"
    return f"CASE WHEN regexp_matches({low}, '{bounded(T.ADVANCED)}') THEN 'advanced' WHEN regexp_matches({low}, '{bounded(T.BEGINNER)}') THEN 'beginner' WHEN category IN ('workshop', 'hackathon') THEN 'beginner' ELSE 'intermediate' END"


_ENRICHED = f"""low AS (SELECT *, lower(concat_ws(' ', title, coalesce(description, ''))) AS low FROM catalog),
lab AS (SELECT *, {_found(T.TOPICS, "low")} AS topics, {_found(T.TECHNOLOGIES, "low")} AS technologies, {_level("low")} AS level FROM low),
aud AS (SELECT *, list_concat({_stands_for(T.AUDIENCES, "topics")}, CASE WHEN category = 'hackathon' THEN ['Students', 'Developers'] ELSE [] END, CASE WHEN level = 'beginner' THEN ['Students'] ELSE [] END) AS a0,
 list_concat({_stands_for(T.SKILLS, "topics")}, CASE WHEN category IN ('conference', 'meetup') THEN ['Networking'] WHEN category IN ('workshop', 'hackathon', 'webinar') THEN ['Hands-on Building'] ELSE [] END) AS skills FROM lab),
enr AS (SELECT *, CASE WHEN len(a0) > 0 THEN a0 ELSE ['Developers'] END AS audiences,
 {_first_by_slug(f"list_concat(CASE provider " + " ".join(f"WHEN '{k}' THEN ['{v}']" for k, v in T.PROVIDER_COMMUNITY.items()) + f" ELSE [] END, {_found(T.COMMUNITY_PATTERNS, 'low')})")} AS community,
 {_first_by_slug("list_filter([" + ", ".join(f"CASE WHEN regexp_matches(low, '{re2(chr(92) + 'b' + k + chr(92) + 'b')}') THEN '{v}' END" for k, v in T.ORGANISATIONS.items()) + "], lambda x: x IS NOT NULL)")} AS organizer FROM aud)"""
_FEAT = f"""list_filter([concat('category:', category), CASE WHEN coalesce({_CITY_SQL}, '') <> '' THEN concat('city:', {_CITY_SQL}) END, CASE WHEN is_online THEN 'format:online' ELSE 'format:offline' END, CASE WHEN is_free THEN 'budget:free' WHEN NOT is_free THEN 'budget:paid' END], lambda x: x IS NOT NULL)"""
_FULL_FEAT = f"""list_distinct(list_concat({_FEAT}, [concat('difficulty:', level)], CASE WHEN community IS NULL THEN [] ELSE [concat('community:', community)] END, CASE WHEN organizer IS NULL THEN [] ELSE [concat('organizer:', organizer)] END,
 {_named("topic", "topics")}, {_named("tech", "technologies")}, {_named("audience", "audiences")}))"""
_TRAITS = f"list_distinct(list_concat({_named('topic', 'topics')}, {_named('tech', 'technologies')}, {_named('skill', 'skills')}))"
_PROFILE_OF = f"prof AS (SELECT user_id, feature, sum(w) AS weight FROM (SELECT user_id, {_W} AS w, unnest(features) AS feature FROM log JOIN feats ON event_key = key) GROUP BY 1, 2)"
_PROFILE = f"{CATALOG_SQL}, {LOG_SQL}, feats AS (SELECT key, {_FEAT} AS features FROM catalog), {_PROFILE_OF}"
_RECOMMEND = f"""{CATALOG_SQL}, {LOG_SQL}, {_ENRICHED}, feats AS (SELECT key, {_FULL_FEAT} AS features, {_TRAITS} AS traits FROM enr), {_PROFILE_OF},
held AS (SELECT user_id, event_key AS key FROM log WHERE type IN ('save', 'unsave') GROUP BY 1, 2 HAVING arg_max(type, "at") = 'save' UNION SELECT user_id, event_key FROM log WHERE type IN ('register', 'attend') GROUP BY 1, 2 HAVING arg_max(type, "at") = 'attend'),
cand AS (SELECT u.user_id, c.key, f.features, f.traits, 0.15::DOUBLE * CAST({_FRESH} AS DOUBLE) + 0.15::DOUBLE * CAST({_TREND} AS DOUBLE) AS base FROM (SELECT DISTINCT user_id FROM prof) u, catalog c JOIN feats f USING (key)
 WHERE c.start_date >= date '{TODAY}' AND NOT EXISTS (SELECT 1 FROM held h WHERE h.user_id = u.user_id AND h.key = c.key)),
raw AS (SELECT user_id, key, sum(coalesce(weight, 0)) AS raw FROM (SELECT user_id, key, unnest(features) AS feature FROM cand) LEFT JOIN prof USING (user_id, feature) GROUP BY 1, 2),
sim AS (SELECT c.user_id, c.key, max(CASE WHEN len(list_distinct(list_concat(c.traits, f.traits))) > 0 THEN len(list_intersect(c.traits, f.traits)) / len(list_distinct(list_concat(c.traits, f.traits)))::DOUBLE ELSE 0 END) AS sim FROM cand c JOIN held h USING (user_id) JOIN feats f ON f.key = h.key GROUP BY 1, 2),
own AS (SELECT *, coalesce(sim, 0) AS s, max(CASE WHEN raw > 0 THEN raw END) OVER (PARTITION BY user_id) AS best FROM cand JOIN raw USING (user_id, key) LEFT JOIN sim USING (user_id, key)),
scored AS (SELECT user_id, key, s > 0 AS "similar", round_even((0.6::DOUBLE * CASE WHEN raw > 0 THEN (raw / best)::DOUBLE ELSE 0.0::DOUBLE END + 0.1::DOUBLE * s) + base, 4) AS score FROM own),
top AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, key) AS rank FROM scored)"""


@query(f"{CATALOG_SQL}, {_ENRICHED} SELECT key, community, organizer FROM enr WHERE community IS NOT NULL OR organizer IS NOT NULL")
def q_entity_maps(spark, d):
    return graph.entity_maps(*graph.build(catalog(spark, d), ("HOSTED_BY", "ORGANIZED_BY")))


@query(f"{_PROFILE} SELECT user_id, feature, round(CAST(weight AS DOUBLE), 4) AS weight FROM prof")
def q_user_profile(spark, d):
    c = catalog(spark, d)
    return users.profile(log(spark, d), c.select("key", users.features().alias("features"))).select("user_id", "feature", F.round("weight", 4).alias("weight"))


@query(f"{_PROFILE} SELECT user_id, feature FROM (SELECT user_id, feature, row_number() OVER (PARTITION BY user_id, split_part(feature, ':', 1) ORDER BY weight DESC, feature) AS rn FROM prof WHERE weight > 0) WHERE rn <= 2")
def q_user_topk_namespace(spark, d):
    c = catalog(spark, d)
    p = users.profile(log(spark, d), c.select("key", users.features().alias("features"))).filter("weight > 0").withColumn("ns", F.substring_index("feature", ":", 1))
    return paging.top_per(p, ["user_id", "ns"], [F.desc("weight"), F.col("feature")], 2).select("user_id", "feature")


def _recommended(spark, d, limit: int):
    c = catalog(spark, d)
    hosts = graph.entity_maps(*graph.build(c, ("HOSTED_BY", "ORGANIZED_BY")))
    return users.recommend(c, log(spark, d), _now(), limit, hosts), hosts


@query(f"{_RECOMMEND} SELECT user_id, key, CAST(score AS DOUBLE) AS score, rank FROM top WHERE rank <= 10")
def q_recommend(spark, d):
    return _recommended(spark, d, 10)[0].drop("similar")


_PHRASE = """CASE split_part(feature, ':', 1) WHEN 'community' THEN concat('Recommended because you follow ', value, '.') WHEN 'organizer' THEN concat('Recommended because you follow ', value, '.')
 WHEN 'topic' THEN CASE WHEN user_id IN (SELECT user_id FROM log WHERE type = 'attend') THEN concat('Recommended because you frequently attend ', value, ' events.') ELSE concat('Recommended because you''re interested in ', value, '.') END
 WHEN 'tech' THEN concat('Recommended because you''re interested in ', value, '.') WHEN 'city' THEN concat('Recommended because you attend events in ', value, '.') WHEN 'category' THEN concat('Recommended because you like ', value, ' events.') END"""
_PRIO = "CASE split_part(feature, ':', 1) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in users.PRIORITY.items()) + " ELSE 9 END"


@query(f"""{_RECOMMEND}, t AS (SELECT user_id, key, "similar" FROM top WHERE rank <= 5), m AS (SELECT user_id, key, feature, weight, substr(feature, strpos(feature, ':') + 1) AS value FROM (SELECT user_id, key, unnest(features) AS feature FROM t JOIN feats USING (key)) JOIN prof USING (user_id, feature) WHERE weight > 0),
o AS (SELECT user_id, key, {_PHRASE} AS phrase, row_number() OVER (PARTITION BY user_id, key ORDER BY {_PRIO}, weight DESC, feature) AS rn FROM m), d AS (SELECT user_id, key, phrase, min(rn) AS rn FROM o WHERE phrase IS NOT NULL GROUP BY 1, 2, 3),
n AS (SELECT user_id, key, phrase, row_number() OVER (PARTITION BY user_id, key ORDER BY rn) AS k FROM d), l AS (SELECT user_id, key, string_agg(phrase, '|' ORDER BY k) AS said FROM n JOIN t USING (user_id, key) WHERE k <= CASE WHEN "similar" THEN 2 ELSE 3 END GROUP BY 1, 2)
SELECT user_id, key, CASE WHEN "similar" THEN concat_ws('|', said, 'Recommended because it''s similar to events you''ve engaged with.') ELSE coalesce(said, 'Recommended based on freshness and trending signals.') END AS reasons FROM t LEFT JOIN l USING (user_id, key)""")
def q_recommend_reasons(spark, d):
    top, hosts = _recommended(spark, d, 5)
    feats = users.enriched(catalog(spark, d)).join(hosts, "key", "left").select("key", users.features(True, True).alias("features"))
    got = users.reasons(top, feats, users.profile(log(spark, d), feats), log(spark, d))
    return got.select("user_id", "key", F.array_join("reasons", "|").alias("reasons"))


@query(f"WITH {LOG_SQL} SELECT user_id, count(*) FILTER (WHERE type = 'attend') AS attend, count(*) FILTER (WHERE type = 'click') AS click, count(*) FILTER (WHERE type = 'view') AS view FROM log GROUP BY user_id")
def q_interaction_pivot(spark, d):
    return log(spark, d).groupBy("user_id").agg(*[F.count_if(F.col("type") == t).alias(t) for t in ("attend", "click", "view")])


@query(f"WITH {LOG_SQL}, s AS (SELECT DISTINCT user_id, event_key FROM log WHERE type = 'view'), e AS (SELECT DISTINCT user_id, event_key FROM log WHERE type = 'attend') SELECT s.user_id, count(*) AS shown, count(e.user_id) AS accepted, round(count(e.user_id) / count(*), 4) AS rate FROM s LEFT JOIN e USING (user_id, event_key) GROUP BY s.user_id")
def q_acceptance(spark, d):
    x = log(spark, d).select("user_id", "type", F.col("event_key").alias("key"))
    return users.acceptance(x.filter("type = 'view'"), x.filter("type = 'attend'"))


@query(f"""{CATALOG_SQL}, f AS (SELECT key, category, {_FEAT} AS x FROM catalog), t AS (SELECT x FROM f WHERE key = 'x.example.com/e000000000')
SELECT key, score FROM (SELECT key, round(len(list_intersect(f.x, t.x)) / len(list_distinct(list_concat(f.x, t.x))), 4) AS score FROM f, t WHERE key <> 'x.example.com/e000000000') WHERE score > 0 ORDER BY score DESC, key LIMIT 20""")
def q_jaccard_similar(spark, d):
    f = catalog(spark, d).select("key", users.features().alias("x"))
    one = f.filter("key = 'x.example.com/e000000000'").select(F.col("x").alias("t")).limit(1)
    s = f.filter("key <> 'x.example.com/e000000000'").crossJoin(F.broadcast(one)).select("key", F.round(S.jaccard(F.col("x"), F.col("t")), 4).alias("score"))
    return s.filter("score > 0").orderBy(F.desc("score"), "key").limit(20)


# --- discovery and operations --------------------------------------------------------------------


@query(f"{DISCOVERY_SQL} SELECT t AS target, t IN (SELECT city FROM records WHERE city IS NOT NULL) AS covered FROM (SELECT unnest([{', '.join(repr(c) for c in A.TARGET_CITIES)}]) AS t)")
def q_coverage(spark, d):
    return A.coverage(spark, discovery(spark, d), "city", A.TARGET_CITIES)


@query(f"""{DISCOVERY_SQL}, c AS (SELECT city, tech, sum(w) AS n FROM (SELECT city, greatest(1, event_count) AS w, unnest(technologies) AS tech FROM records WHERE city IS NOT NULL) GROUP BY 1, 2), t AS (SELECT city, sum(n) AS total FROM c GROUP BY 1 HAVING sum(n) >= 20),
g AS (SELECT t.city, x.tech, CAST(coalesce(c.n, 0) AS BIGINT) AS observed, CAST(total AS BIGINT) AS total FROM t CROSS JOIN (SELECT unnest(['Python','Rust','Go','Docker','Flutter','Claude','React']) AS tech) x LEFT JOIN c ON c.city = t.city AND c.tech = x.tech)
SELECT city, tech, observed, total, CAST(least(1.0, greatest(0.0, round_even(1.0 - observed / (total * 0.05::DOUBLE + 1e-9::DOUBLE), 4))) AS DOUBLE) AS severity FROM g WHERE observed <= greatest(2.0, 0.05 * total)""")
def q_gap_analysis(spark, d):
    return A.gaps(spark, discovery(spark, d), ["Python", "Rust", "Go", "Docker", "Flutter", "Claude", "React"])


@query(f"""{DISCOVERY_SQL}, g AS (SELECT search_query, count(DISTINCT domain) AS domains, count(*) FILTER (WHERE approved OR active) AS good, count(*) FILTER (WHERE onboarding_state = 'rejected') AS spam, count(*) FILTER (WHERE onboarding_state = 'duplicate') AS duplicates FROM records WHERE search_query IS NOT NULL GROUP BY 1),
h AS (SELECT *, round_even(good / domains, 4) AS yield_score, round_even(spam / domains, 4) AS spam_rate FROM g) SELECT *, CASE WHEN spam_rate >= 0.6 THEN 'retire' WHEN yield_score >= 0.5 AND domains >= 2 THEN 'boost' WHEN domains >= 8 AND yield_score < 0.2 THEN 'split' ELSE 'keep' END AS recommendation FROM h""")
def q_query_stats(spark, d):
    return A.query_stats(discovery(spark, d))


@query(f"""{DISCOVERY_SQL}, s AS (SELECT DISTINCT search_query AS q, domain FROM records WHERE search_query IS NOT NULL), n AS (SELECT q, count(*) AS n FROM s GROUP BY q), b AS (SELECT a.q AS qa, b.q AS qb, count(*) AS k FROM s a JOIN s b ON a.domain = b.domain AND a.q < b.q GROUP BY 1, 2)
SELECT qa, qb, round(k / (x.n + y.n - k), 4) AS jaccard FROM b JOIN n x ON x.q = qa JOIN n y ON y.q = qb WHERE round(k / (x.n + y.n - k), 4) >= 0.6""")
def q_query_overlap(spark, d):
    return A.query_overlap(discovery(spark, d))


_FR = "CASE WHEN freshness_hours IS NULL OR freshness_hours >= 720 THEN 0.0 WHEN freshness_hours <= 24 THEN 1.0 ELSE round_even(1.0 - (freshness_hours - 24) / 696, 4) END"
_TRUST = f"""{DISCOVERY_SQL}, g AS (SELECT domain, count(*) AS records, round_even(avg(CAST(approved AS INT)), 3) AS approval, round_even(avg(CAST(sandbox_quality AS DOUBLE)), 3) AS sandbox,
 round_even(coalesce(avg(CASE WHEN production_state IN ('active','rolled_back') THEN CAST(production_state = 'active' AS INT) END), 0.0), 3) AS production, round_even(1 - avg(CAST(duplicate_rate AS DOUBLE)), 3) AS duplicate, round_even(avg({_FR}), 3) AS freshness,
 round_even(avg(least(1.0, event_count / 10.0)), 3) AS richness, round_even(avg(1.0 - coalesce(crawl_failures / nullif(crawl_attempts, 0), 0.0)), 3) AS stability FROM records GROUP BY domain),
t AS (SELECT *, round_even(0.20 * approval + 0.15 * sandbox + 0.20 * production + 0.10 * duplicate + 0.10 * freshness + 0.15 * richness + 0.10 * stability, 4) AS total FROM g),
trust AS (SELECT *, CASE WHEN total >= 0.7 THEN 'high' WHEN total >= 0.45 THEN 'medium' WHEN total >= 0.2 THEN 'low' ELSE 'dead' END AS tier FROM t)"""


@query(f"{_TRUST} SELECT domain, records, CAST(total AS DOUBLE) AS total, tier FROM trust")
def q_domain_trust(spark, d):
    return A.domain_trust(discovery(spark, d)).select("domain", "records", "total", "tier")


@query(f"""{_TRUST}, a AS (SELECT sum(total) AS s FROM trust WHERE tier <> 'dead'), b AS (SELECT domain, tier, CASE tier WHEN 'high' THEN 'increase' WHEN 'medium' THEN 'maintain' WHEN 'low' THEN 'decrease' ELSE 'stop' END AS action,
 CASE tier WHEN 'high' THEN 6 WHEN 'medium' THEN 12 WHEN 'low' THEN 48 END AS interval_hours, CAST(round_even(CASE WHEN tier = 'dead' THEN 0.0 ELSE total / s END, 4) AS DOUBLE) AS weight FROM trust, a) SELECT *, CAST(round_even(weight * 100, 2) AS DOUBLE) AS crawls FROM b""")
def q_budget(spark, d):
    return A.budget(A.domain_trust(discovery(spark, d)))


_STRAT = f"CASE WHEN feed_type IN ({', '.join(repr(x) for x in A.STRUCTURED)}) THEN 'structured' WHEN feed_type IN ({', '.join(repr(x) for x in A.FRAMEWORK)}) THEN 'framework' WHEN feed_type = 'ai_extracted' THEN 'ai' ELSE 'search' END"


@query(f"""{DISCOVERY_SQL}, p AS (SELECT domain, {_STRAT} AS s, sum(greatest(event_count, CAST(approved AS INT))) AS n FROM records GROUP BY 1, 2), c AS (SELECT *, CASE s WHEN 'structured' THEN 1 WHEN 'framework' THEN 2 WHEN 'search' THEN 3 ELSE 4 END AS cost FROM p),
g AS (SELECT domain, coalesce(min(CASE WHEN n > 0 THEN cost END), 3) AS best, list(s) FILTER (WHERE n > 0) AS eff FROM c GROUP BY domain)
SELECT domain, ['structured','framework','search','ai'][best] AS best_strategy, array_to_string(list_filter(['structured','framework','search','ai'], lambda x: list_position(['structured','framework','search','ai'], x) > best AND NOT list_contains(coalesce(eff, []), x)), ',') AS avoid FROM g""")
def q_strategy(spark, d):
    return A.strategies(discovery(spark, d))


@query(f"""{DISCOVERY_SQL} SELECT count(*) AS records, count(DISTINCT domain) AS domains, count(DISTINCT search_query) AS queries, round_even(count(*) FILTER (WHERE approved OR active) / count(DISTINCT search_query), 4) AS query_yield, round_even(sum(event_count) / count(DISTINCT domain), 4) AS domain_yield,
 round_even(sum(event_count) / sum(crawl_attempts), 4) AS crawl_efficiency, round_even(count(*) FILTER (WHERE active) / count(*) FILTER (WHERE production_state IN ('active','rolled_back')), 4) AS precision, round_even(sum(crawl_attempts) / count(DISTINCT domain), 4) AS cost FROM records""")
def q_discovery_kpis(spark, d):
    return A.discovery_kpis(discovery(spark, d))


@query("""WITH o AS (SELECT doc_id % 101 / 101.0::DOUBLE AS p, quality FROM labels) SELECT CAST(least(4, floor(p * 5)) AS INT) AS bin, count(*) AS n, round(avg(p), 6) AS predicted, round(avg(CAST(quality AS DOUBLE)), 6) AS observed, round(round(avg(CAST(quality AS DOUBLE)), 6) - round(avg(p), 6), 6) AS delta FROM o GROUP BY 1""")
def q_calibration(spark, d):
    return A.calibration(read(spark, d, "labels").select((F.col("doc_id") % 101 / F.lit(101.0)).alias("predicted"), F.col("quality").alias("observed")))


@query("""WITH s AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'healthy' WHEN 'O' THEN 'degraded' ELSE 'failing' END AS health, CASE WHEN o_orderpriority LIKE '1%' THEN 'open' ELSE 'closed' END AS circuit, o_orderkey % 9 AS runs, o_orderkey % 5 AS successes FROM orders)
SELECT health, circuit, count(*) AS n, CAST(sum(runs) AS BIGINT) AS runs, round_even(sum(successes) / sum(runs), 4) AS success_rate FROM s GROUP BY GROUPING SETS ((health), (circuit), ())""")
def q_health_rollup(spark, d):
    o = read(spark, d, "orders")
    s = o.select(F.expr("case o_orderstatus when 'F' then 'healthy' when 'O' then 'degraded' else 'failing' end").alias("health"), F.when(F.col("o_orderpriority").startswith("1"), "open").otherwise("closed").alias("circuit"), (F.col("o_orderkey") % 9).alias("runs"), (F.col("o_orderkey") % 5).alias("successes"))
    return A.health_rollup(s)


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(value) FILTER (WHERE i = round_even(0.5 * (n - 1), 0)) AS p50, max(value) FILTER (WHERE i = round_even(0.95 * (n - 1), 0)) AS p95, max(value) FILTER (WHERE i = round_even(0.99 * (n - 1), 0)) AS p99 FROM r GROUP BY event_type""")
def q_latency_percentiles(spark, d):
    return scans.percentiles(read(spark, d, "events"), "event_type", "value", [0.5, 0.95, 0.99])


@query(f"""{RUNS_SQL}, i AS (SELECT *, sum(CAST(ok AS INT)) OVER (PARTITION BY provider ORDER BY tm, run_id ROWS UNBOUNDED PRECEDING) AS g FROM runs), s AS (SELECT *, sum(CAST(NOT ok AS INT)) OVER (PARTITION BY provider, g ORDER BY tm, run_id ROWS UNBOUNDED PRECEDING) AS streak FROM i)
SELECT provider, count(*) AS runs, count(*) FILTER (WHERE ok) AS successes, CAST(last(streak ORDER BY tm, run_id) AS BIGINT) AS streak, CAST(max(streak) AS BIGINT) AS worst, round(avg(found) FILTER (WHERE ok), 6) AS avg_found, CASE WHEN last(streak ORDER BY tm, run_id) >= 3 THEN 'open' ELSE 'closed' END AS circuit FROM s GROUP BY provider""")
def q_failure_streak(spark, d):
    return A.provider_state(runs(spark, d))


@query(f"{RUNS_SQL} SELECT run_id, CAST(floor(sum(CAST(round(found * 100) AS BIGINT)) OVER w * 10 / count(*) OVER w) AS BIGINT) AS mean_milli FROM runs WINDOW w AS (PARTITION BY provider ORDER BY tm, run_id ROWS UNBOUNDED PRECEDING)")
def q_running_mean(spark, d):
    cents = F.round(F.col("found") * 100).cast("long")  # whole numbers: a mean's last digit would depend on the order of additions
    log = scans.ranged(runs(spark, d).select("provider", "at", "run_id", "found"), ["provider"], ["at", "run_id"])
    r = scans.running(log, ["provider"], ["at", "run_id"], total=cents, n=F.lit(1).cast("long"))
    return r.select("run_id", F.floor(F.col("total") * 10 / F.col("n")).alias("mean_milli"))


@query("WITH g AS (SELECT o_custkey AS id, date_diff('day', lag(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE)), CAST(o_orderdate AS DATE)) AS gap FROM orders) SELECT id, median(gap) FILTER (WHERE gap > 0) AS period FROM g GROUP BY id")
def q_median_gap(spark, d):
    return graph.health(read(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.to_date("o_orderdate").alias("d")), F.lit("2001-08-01").cast("date")).select("id", "period")


@query(f"{RUNS_SQL}, r AS (SELECT provider, found, row_number() OVER (PARTITION BY provider ORDER BY tm, run_id) AS i, count(*) OVER (PARTITION BY provider) AS n FROM runs) SELECT provider, round(avg(found) FILTER (WHERE i > n // 2) - avg(found) FILTER (WHERE i <= n // 2), 6) AS trend FROM r GROUP BY provider")
def q_half_trend(spark, d):
    log = scans.ranged(runs(spark, d).select("provider", "at", "run_id", "found"), ["provider"], ["at", "run_id"])
    r = scans.numbered(log, ["provider"], ["at", "run_id"]).join(log.groupBy(F.col("provider").alias("of")).agg(F.count(F.lit(1)).alias("n")), F.col("provider").eqNullSafe(F.col("of")))
    late = F.col("position") > F.floor(F.col("n") / 2)
    return r.groupBy("provider").agg(F.round(F.avg(F.when(late, F.col("found"))) - F.avg(F.when(~late, F.col("found"))), 6).alias("trend"))


# --- graph -------------------------------------------------------------------------------------------

_CITYSLUG = f"concat('city:', replace(trim(regexp_replace(lower({_CITY_SQL}), '[^a-z0-9]+', ' ', 'g')), ' ', '-'))"


@query(f"{CATALOG_SQL} SELECT {_CITYSLUG} AS id, count(*) AS events, min(start_date) AS first_seen, max(start_date) AS last_seen FROM catalog WHERE city IS NOT NULL GROUP BY 1")
def q_city_ecosystem(spark, d):
    v, _ = graph.build(catalog(spark, d), ("IN_CITY",))
    return v.select("id", "events", "first_seen", "last_seen")


@query(f"{CATALOG_SQL} SELECT concat('event:', key) AS id FROM catalog WHERE {_CITYSLUG} = 'city:pune'")
def q_neighbours(spark, d):
    _, e = graph.build(catalog(spark, d))
    return graph.neighbours(e, "city:pune", "IN_CITY", outward=False)


@query()
def q_directory(spark, d):
    v, _ = graph.build(catalog(spark, d))
    return graph.directory(v).select("type", "id", "events")


# --- control plane, confidences -----------------------------------------------------------------------

_STATES = "WITH states AS (SELECT c_custkey AS provider, c_nationkey % 5 > 0 AS enabled, CASE WHEN c_custkey % 7 > 0 THEN date '2026-07-01' + CAST(c_custkey % 30 AS INTEGER) END AS next_run FROM customer)"


@query(f"{_STATES} SELECT provider FROM states WHERE enabled AND (next_run IS NULL OR next_run <= date '{TODAY}') ORDER BY next_run NULLS FIRST, provider LIMIT 100")
def q_due_providers(spark, d):
    c = read(spark, d, "customer")
    day = F.when(F.col("c_custkey") % 7 > 0, F.date_add(F.lit("2026-07-01").cast("date"), (F.col("c_custkey") % 30).cast("int")))
    s = c.select(F.col("c_custkey").alias("provider"), (F.col("c_nationkey") % 5 > 0).alias("enabled"), day.alias("next_run_at"))
    return control.due(s, _today(), 100).select("provider")


@query("WITH a AS (SELECT o_orderstatus AS state, o_orderpriority AS feed FROM orders) SELECT state, feed, count(*) AS n FROM a GROUP BY GROUPING SETS ((state), (feed))")
def q_histograms(spark, d):
    return control.histogram(read(spark, d, "orders").select(F.col("o_orderstatus").alias("state"), F.col("o_orderpriority").alias("feed")), "state", "feed")


@query("""WITH o AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'auto' ELSE 'review' END AS band, quality = 1 AS ok, toxic = 1 AS rolled, doc_id % 101 / 101.0::DOUBLE AS p FROM labels)
SELECT count(*) AS n, round_even(count(*) FILTER (WHERE band = 'auto' AND ok) / count(*) FILTER (WHERE band = 'auto'), 4) AS auto_precision, round_even(count(*) FILTER (WHERE rolled) / count(*), 4) AS rollback_rate, round(avg(abs(p - CAST(ok AS INT))), 6) AS mean_error FROM o""")
def q_feedback(spark, d):
    o = read(spark, d, "labels").select(F.when(F.col("doc_id") % 3 == 0, "auto").otherwise("review").alias("band"), F.col("quality").alias("observed"), (F.col("toxic") == 1).alias("rolled_back"), (F.col("doc_id") % 101 / F.lit(101.0)).alias("predicted"))
    return control.feedback(o)


@query("""WITH l AS (SELECT CAST(ts AS DATE) AS day, user_id % 30 AS domain, CASE event_type WHEN 'error' THEN 'rejected' WHEN 'view' THEN 'duplicate' ELSE 'kept' END AS outcome FROM events)
SELECT day, count(DISTINCT domain) AS domains, round_even(count(*) FILTER (WHERE outcome = 'duplicate') / count(*), 4) AS duplicate_rate, count(*) FILTER (WHERE outcome = 'rejected') AS rejected FROM l GROUP BY day""")
def q_daily_metrics(spark, d):
    out = F.expr("case event_type when 'error' then 'rejected' when 'view' then 'duplicate' else 'kept' end")
    return control.daily_metrics(read(spark, d, "events").select(F.to_date("ts").alias("day"), (F.col("user_id") % 30).alias("domain"), out.alias("outcome")))


@query(f"{DISCOVERY_SQL} SELECT value, count(*) AS n FROM (SELECT unnest(technologies) AS value FROM records) GROUP BY value ORDER BY n DESC, value LIMIT 5")
def q_top_values(spark, d):
    return control.top_values(discovery(spark, d), "technologies")


@query(f"""{CATALOG_SQL}, {LOG_SQL}, r AS (SELECT user_id, event_key AS key, type, row_number() OVER (PARTITION BY user_id, event_key ORDER BY at DESC, type DESC) AS rn FROM (SELECT user_id, event_key, type, "at" FROM log WHERE type IN ('register', 'attend')) x)
SELECT user_id, key, CASE WHEN type = 'attend' THEN 'attended' WHEN {_END} < date '{TODAY}' THEN 'missed' ELSE 'registered' END AS status FROM r JOIN catalog USING (key) WHERE rn = 1""".replace("ORDER BY at DESC", 'ORDER BY "at" DESC'))
def q_attendance(spark, d):
    return control.attendance(log(spark, d), catalog(spark, d), _today())


@query("""WITH c AS (SELECT user_id AS run, event_id AS cycle, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS progress FROM events)
SELECT run, cycle, max(progress) OVER w = 0 AND count(*) OVER w = 3 AS steady FROM c WINDOW w AS (PARTITION BY run ORDER BY cycle ROWS 2 PRECEDING)""")
def q_steady_state(spark, d):
    return control.steady(read(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("cycle"), (F.col("event_type") == "error").cast("int").alias("progress")))


@query("SELECT n_name AS name, 'nation' AS kind FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def q_opportunities(spark, d):
    n, s = read(spark, d, "nation"), read(spark, d, "supplier").filter("s_acctbal > 5000")
    known = s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(F.col("n_name").alias("name")).distinct()
    return control.opportunities(known, n.select(F.col("n_name").alias("name")), "nation").select("name", "kind")


@query("SELECT page_id, CASE WHEN regexp_matches(url, '(?i)/(graphql|gql)\\b') THEN 'graphql' WHEN regexp_matches(url, '(?i)\\.ics(\\b|$)') THEN 'ics' WHEN regexp_matches(url, '(?i)calendar\\.google\\.com|/calendar') THEN 'calendar' WHEN regexp_matches(url, '(?i)/(feed|rss|atom)\\b|\\.(xml|rss)\\b') THEN 'rss' WHEN regexp_matches(url, '(?i)/api/|\\.json\\b') OR regexp_matches(url, '(?i)/(?:v[0-9]+/)?events?(?:/|\\?|\\b|$)|^https?://api\\.') THEN CASE WHEN contains(lower(url), '.json') THEN 'json' ELSE 'rest' END ELSE 'unknown' END AS kind FROM pages".replace("\\\\", "\\"))
def q_endpoint_kind(spark, d):
    return read(spark, d, "pages").select("page_id", C.endpoint_kind(F.col("url")).alias("kind"))


@query()
def q_search_result_score(spark, d):
    p = read(spark, d, "pages")
    return p.select("page_id", C.search_result(F.regexp_extract("html", "(?is)<h1[^>]*>(.*?)</h1>", 1), T.strip_tags(F.col("html")), U.registrable_domain(F.col("url")), F.col("url")).alias("score"))


@query()
def q_crawl_priority(spark, d):
    return crawl.page_links(read(spark, d, "pages")).select("source", "target", C.crawl_priority(F.col("target"), F.lit(""), F.lit(False), F.lit(False), F.lit(0.0)).alias("priority"))


@query()
def q_page_signals(spark, d):
    h = F.col("html")
    return read(spark, d, "pages").select("page_id", C.framework(h).alias("framework"), C.feed_kinds(h, F.lit(None).cast("string")).alias("feeds"), C.endpoints(h).alias("endpoints"), C.off_topic(T.strip_tags(h)).alias("off_topic"), U.feeds(h).alias("feed_links"))


@query()
def q_onboarding_bands(spark, d):
    r = discovery(spark, d)
    parts = {"discovery": F.col("sandbox_quality"), "sandbox": C.sandbox(F.size("technologies"), F.col("event_count"), F.col("sandbox_quality"), F.lit(0.5)), "extraction": F.lit(0.5), "content": F.col("event_count") / 15, "duplicate": 1 - F.col("duplicate_rate"), "tech": F.size("technologies") / 3, "india": F.lit(0.5)}
    return r.select(C.onboarding(parts, F.col("feed_type")).alias("b")).groupBy("b.band").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("b.total"), 4).alias("mean"))


@query()
def q_organizer_pages(spark, d):
    from eventloom.functions import organizers as O

    return O.page_profile(read(spark, d, "pages"))


@query("SELECT s_nationkey AS id, max(CAST(s_suppkey AS VARCHAR)) AS top, count(*) AS n FROM supplier GROUP BY 1")
def q_alias_groups(spark, d):
    from eventloom.functions import organizers as O

    # every supplier of a nation is one identity: the number is punctuation, the rest filler
    s = read(spark, d, "supplier").select(F.concat(F.lit("The Club of nation"), F.col("s_nationkey").cast("string")).alias("name"), "s_nationkey", "s_suppkey")
    keyed = s.withColumn("key", O.canonical_key(F.col("name")))
    return keyed.groupBy("key").agg(F.min("s_nationkey").alias("id"), F.max(F.col("s_suppkey").cast("string")).alias("top"), F.count(F.lit(1)).alias("n")).select("id", "top", "n")


@query("""WITH d AS (SELECT o_custkey AS id, CASE o_custkey % 5 WHEN 0 THEN 'weekly' WHEN 1 THEN 'monthly' WHEN 2 THEN 'quarterly' WHEN 3 THEN 'annual' ELSE 'unknown' END AS cadence, CAST(o_orderdate AS DATE) AS d FROM orders),
l AS (SELECT *, date_diff('day', lag(d) OVER (PARTITION BY id ORDER BY d), d) AS gap FROM d), g AS (SELECT id, cadence, max(d) AS last, count(*) AS n, median(gap) FILTER (WHERE gap > 0) AS m FROM l GROUP BY id, cadence),
p AS (SELECT *, coalesce(CASE cadence WHEN 'weekly' THEN 7.0 WHEN 'monthly' THEN 31.0 WHEN 'quarterly' THEN 93.0 WHEN 'annual' THEN 366.0 END, m, 45.0) AS period, date '2001-06-01' - last AS age FROM g)
SELECT id, CASE WHEN age < 0 THEN 'active' WHEN n = 1 THEN CASE WHEN age <= 2 * period THEN 'new' ELSE 'inactive' END WHEN age <= 1.5 * period THEN 'active' WHEN cadence IN ('annual', 'quarterly') AND age <= 2 * period THEN 'seasonal' WHEN age <= 3 * period THEN 'dormant' ELSE 'inactive' END AS state,
 last + CAST(floor(period) AS INTEGER) AS next, CASE WHEN age < 0.75 * period THEN 'low' WHEN age <= 2 * period THEN 'high' ELSE 'medium' END AS chance FROM p""")
def q_organizer_health(spark, d):
    from eventloom.functions import organizers as O

    cad = F.expr("case o_custkey % 5 when 0 then 'weekly' when 1 then 'monthly' when 2 then 'quarterly' when 3 then 'annual' else 'unknown' end")
    return O.health(read(spark, d, "orders").select(F.col("o_custkey").alias("id"), cad.alias("cadence"), F.to_date("o_orderdate").alias("d")), F.lit("2001-06-01").cast("date"))


def _enrichment(c: DataFrame) -> DataFrame:
    text = F.concat_ws(" ", "title", F.coalesce("description", F.lit("")))
    return c.select("key", T.labels(text, T.TOPICS).alias("topics"), T.labels(text, T.TECHNOLOGIES).alias("technologies"), T.difficulty(text, F.col("category")).alias("level"))


_SECTION_SQL = " UNION ALL ".join(
    f"SELECT '{n}' AS section, key, row_number() OVER (ORDER BY {o}) AS rank FROM hp WHERE {c}"
    for n, c, o in (
        *((n, f"{_END} >= date '{TODAY}' AND category = '{k}'", "start_date, key") for n, k in (("ai_events", "ai"), ("startup_events", "startup"))),
        *((n, f"{_END} >= date '{TODAY}' AND regexp_matches(title, '{p}')", "start_date, key") for n, p in (("developer_festivals", "(?i)dev ?fest|developer festival"), ("government_tech", "(?i)\\b(government|goverment|govt|gov)\\b"), ("university_events", "(?i)university|college|campus|student"))),
        ("upcoming", f"{_END} >= date '{TODAY}'", "start_date, key"), ("hackathons", f"{_END} >= date '{TODAY}' AND category = 'hackathon'", "start_date, key"), ("conferences", f"{_END} >= date '{TODAY}' AND category = 'conference'", "start_date, key"),
        ("meetups", f"{_END} >= date '{TODAY}' AND category = 'meetup'", "start_date, key"), ("workshops", f"{_END} >= date '{TODAY}' AND category = 'workshop'", "start_date, key"),
        ("recently_added", f"epoch_us(first_seen_at) >= epoch_us(timestamp '{NOW}' - INTERVAL 7 DAY)", "first_seen_at DESC, start_date, key"), ("registration_closing", f"start_date > date '{TODAY}' AND start_date <= date '{TODAY}' + 7", "start_date, key"),
        ("online_events", f"{_END} >= date '{TODAY}' AND is_online", "start_date, key"), ("free_events", f"{_END} >= date '{TODAY}' AND is_free", "start_date, key"), ("trending", f"start_date >= date '{TODAY}'", f"-{_TREND}, start_date, key"), ("nearby_events", f"{_END} >= date '{TODAY}' AND {_CITY_SQL} = 'Pune'", "start_date, key"),
    )
)


# Some records are of the categories and titles that a few sections look for.
_STAGED = {
    "category": "CASE WHEN doc_id % 11 = 0 THEN 'ai' WHEN doc_id % 13 = 0 THEN 'startup' ELSE category END",
    "title": "CASE WHEN doc_id % 17 = 0 THEN concat('DevFest ', title) WHEN doc_id % 19 = 0 THEN concat('Govt day: ', title) WHEN doc_id % 23 = 0 THEN concat('Campus ', title) ELSE title END",
}


@query(f"{CATALOG_SQL}, hp AS (SELECT * REPLACE ({', '.join(f'{e} AS {n}' for n, e in _STAGED.items())}) FROM catalog), s AS ({_SECTION_SQL}) SELECT section, rank, key FROM s WHERE rank <= 8")
def q_homepage(spark, d):
    from eventloom.operators import platform, scans

    c = catalog(spark, d).withColumns({n: F.expr(e) for n, e in _STAGED.items()})
    return platform.homepage(c, _now(), 8, "Pune")


@query(f"{CATALOG_SQL} SELECT key FROM catalog WHERE {_END} >= date '{TODAY}' ORDER BY -(CAST({_SOURCE} AS DOUBLE) + ({_COMPLETE}) / 6.0::DOUBLE), key LIMIT 20")
def q_feed_popular(spark, d):
    from eventloom.operators import platform, scans

    return platform.feed(catalog(spark, d), "popular", _now(), 20).select("key")


@query(f"{CATALOG_SQL} SELECT provider, count(*) AS fetched, count(*) FILTER (WHERE {_END} >= date '{TODAY}') AS upcoming, string_agg(DISTINCT category, ',' ORDER BY category) AS categories, round(avg(({_COMPLETE}) / 6.0::DOUBLE), 4) AS completeness FROM catalog GROUP BY provider")
def q_source_report(spark, d):
    from eventloom.operators import platform, scans

    return platform.source_report(catalog(spark, d), _today())


@query(f"{CATALOG_SQL} SELECT key, CAST(start_date AS varchar) AS start_date, CAST(end_date AS varchar) AS end_date FROM catalog WHERE provider = 'gdg'")
def q_event_dto(spark, d):
    from eventloom.operators import platform, scans

    return platform.event_dto(platform.browse(catalog(spark, d), "provider", "gdg")).select("key", "start_date", "end_date")


@query()
def q_browse_difficulty(spark, d):
    from eventloom.operators import platform, scans

    c = catalog(spark, d)
    return platform.browse(c, "difficulty", "beginner", _enrichment(c)).select("key")


@query()
def q_community_insights(spark, d):
    from eventloom.operators import platform, scans

    c = catalog(spark, d)
    v, e = graph.build(c)
    return platform.insights(graph.profiles(c, e, _today()), v).select("list", "rank", "name", "n")


@query("SELECT DISTINCT concat('site:', n_name, ' ', r_name, ' ', p) AS query FROM nation, region, (SELECT unnest(['Rust', 'Go', 'Python']) AS p)")
def q_query_matrix(spark, d):
    from eventloom.functions import discovery as D

    tech = spark.createDataFrame([("Rust",), ("Go",), ("Python",)], "technology string")
    return D.query_matrix(read(spark, d, "nation").select(F.col("n_name").alias("platform")), read(spark, d, "region").select(F.col("r_name").alias("city")), tech)


@query(f"""{DISCOVERY_SQL} SELECT doc_id, CASE WHEN event_count >= 20 THEN 'high' WHEN event_count >= 5 THEN 'medium' ELSE 'low' END AS volume,
 CASE WHEN feed_type IN ('search_result', 'unknown') OR event_count = 0 OR sandbox_quality < 0.5 THEN 'high' WHEN feed_type IN ('ai_extracted', 'json_api', 'graphql') THEN 'medium' ELSE 'low' END AS risk FROM records""")
def q_promotion_risk(spark, d):
    from eventloom.functions import discovery as D

    p = D.promotion(F.col("feed_type"), F.col("event_count"), F.lit(0.5), F.col("sandbox_quality"))
    return discovery(spark, d).select("doc_id", p.alias("p")).select("doc_id", "p.volume", "p.risk")


@query("SELECT s_suppkey, concat('https://', regexp_replace(regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), '.dev/') AS url FROM supplier")
def q_candidate_urls(spark, d):
    from eventloom.functions import discovery as D

    return read(spark, d, "supplier").select("s_suppkey", D.candidate_urls(F.lit("series_instance"), F.col("s_name"))[0].alias("url"))


# Further queries register themselves here.
from eventloom.plans import crawls, organizers, pages, rendered, streams, upkeep  # noqa: E402, F401
