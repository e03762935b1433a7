"""The engine's own tables, laid over the driver's: a catalog over documents, logs over events,
discovery records over documents. Each has a Spark form and the same as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW, TODAY = "2026-07-15 12:00:00", "2026-07-15"
CITY = ["Bengaluru", "Bombay", "Delhi", "Pune", "Chennai", " hyderabad ", None, "Kochi"]
PROVIDER = ["gdg", "cncf", "fossunited", "hasgeek", "luma", "devfolio", "confs.tech", "other"]
CATEGORY = ["meetup", "conference", "workshop", "hackathon", "webinar"]
FEED = ["rss", "ics", "jsonld_event", "next_data", "json_api", "search_result", "ai_extracted", "html", "graphql"]
TECH = ["Python", "Rust", "Go", "Docker", "React", "Java", "Cloud"]


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _list(xs, spark: bool) -> str:
    body = ", ".join("null" if x is None else f"'{x}'" for x in xs)
    return f"array({body})" if spark else f"[{body}]"


def _catalog_select(spark: bool) -> str:
    pick = (lambda xs, i: f"element_at({_list(xs, True)}, int({i}) + 1)") if spark else (lambda xs, i: f"{_list(xs, False)}[{i} + 1]")
    title = "substring_index(text, '.', 1)" if spark else "split_part(text, '.', 1)"
    start = f"date_add(date '{TODAY}', int(doc_id % 300 - 60))" if spark else f"(date '{TODAY}' + CAST(doc_id % 300 - 60 AS INTEGER))"
    plus = (lambda n: f"date_add({start}, int({n}))") if spark else (lambda n: f"({start} + CAST({n} AS INTEGER))")
    back = (lambda h: f"timestamp '{NOW}' - make_dt_interval(0, int({h}))") if spark else (lambda h: f"timestamp '{NOW}' - to_hours(CAST({h} AS BIGINT))")
    sha = "sha2(cast(text as binary), 256)" if spark else "sha256(text)"
    text = "string" if spark else "varchar"
    return f"""
      SELECT doc_id, concat('x.example.com/e', lpad(cast(doc_id as {text}), 9, '0')) AS key, {title} AS title, text AS description,
        concat('https://x.example.com/e', cast(doc_id as {text})) AS url, {pick(CITY, "doc_id % 8")} AS city,
        CASE WHEN doc_id % 4 = 0 THEN concat('Hall ', cast(doc_id % 7 as {text}), ', Main Road') END AS location, doc_id % 5 = 0 AS is_online,
        {start} AS start_date, CASE WHEN doc_id % 3 = 0 THEN {plus("doc_id % 4")} END AS end_date, {pick(CATEGORY, "doc_id % 5")} AS category,
        CASE WHEN doc_id % 3 = 0 THEN true WHEN doc_id % 3 = 1 THEN false END AS is_free, CASE WHEN doc_id % 3 = 1 THEN concat('INR ', cast(doc_id % 10 * 100 as {text})) END AS price,
        {pick(PROVIDER, "doc_id % 8")} AS provider, {sha} AS content_hash, {back("doc_id % 40 * 24 + doc_id % 24")} AS first_seen_at, {back("doc_id % 12")} AS last_seen_at,
        CASE WHEN doc_id % 11 = 0 THEN 'expired' WHEN doc_id % 13 = 0 THEN 'withdrawn' ELSE 'active' END AS status, cast(null as {text}) AS status_reason, cast(1 + doc_id % 4 as int) AS version
      FROM documents"""


def catalog(spark: SparkSession, d: str) -> DataFrame:
    """Schema: eventloom.schema.CATALOG, and doc_id."""
    return spark.sql(_catalog_select(True).replace("FROM documents", "FROM {docs}"), docs=read(spark, d, "documents"))


CATALOG_SQL = f"WITH catalog AS ({_catalog_select(False)})"


def log(spark: SparkSession, d: str) -> DataFrame:
    """Interactions over events; records are named by event_id modulo 200."""
    kind = F.expr("case event_type when 'purchase' then 'attend' when 'signup' then 'register' when 'error' then 'ignore' else event_type end")
    key = F.concat(F.lit("x.example.com/e"), F.lpad((F.col("event_id") * 7 % 200).cast("string"), 9, "0"))
    return read(spark, d, "events").select(F.col("user_id").cast("string").alias("user_id"), kind.alias("type"), F.col("ts").alias("at"), key.alias("event_key"), "event_id")


LOG_SQL = """log AS (SELECT cast(user_id AS varchar) AS user_id, CASE event_type WHEN 'purchase' THEN 'attend' WHEN 'signup' THEN 'register' WHEN 'error' THEN 'ignore' ELSE event_type END AS type,
  ts AS at, concat('x.example.com/e', lpad(cast(event_id * 7 % 200 AS varchar), 9, '0')) AS event_key, event_id FROM events)"""


def runs(spark: SparkSession, d: str) -> DataFrame:
    """A run log of 20 sources over events."""
    return read(spark, d, "events").select((F.col("user_id") % 20).alias("provider"), F.col("event_id").alias("run_id"), F.col("ts").alias("at"), (F.col("event_type") != "error").alias("ok"), F.col("value").alias("found"))


RUNS_SQL = "WITH runs AS (SELECT user_id % 20 AS provider, event_id AS run_id, ts AS tm, event_type <> 'error' AS ok, value AS found FROM events)"


def _discovery_select(spark: bool) -> str:
    pick = (lambda xs, i: f"element_at({_list(xs, True)}, int({i}) + 1)") if spark else (lambda xs, i: f"{_list(xs, False)}[{i} + 1]")
    text = "string" if spark else "varchar"
    arr = (lambda xs: f"array({xs})") if spark else (lambda xs: f"[{xs}]")
    return f"""
      SELECT doc_id, concat('d', cast(doc_id % 40 as {text}), '.example.com') AS domain, {pick(FEED, "doc_id % 9")} AS feed_type,
        CASE WHEN doc_id % 6 > 0 THEN concat('q', cast(doc_id % 12 as {text})) END AS search_query, {pick(["Bangalore", "Mumbai", "Delhi", None, "Pune"], "doc_id % 5")} AS city,
        {arr(f"{pick(TECH, 'doc_id % 7')}, {pick(TECH, 'doc_id % 3')}")} AS technologies, {pick(["rejected", "duplicate", "approved", "production", "pending"], "doc_id % 5")} AS onboarding_state,
        doc_id % 5 in (2, 3) AS approved, doc_id % 7 = 3 AS active, doc_id % 11 / 10.0 AS sandbox_quality, CASE WHEN doc_id % 7 = 3 THEN 'active' WHEN doc_id % 7 = 4 THEN 'rolled_back' ELSE 'none' END AS production_state,
        doc_id % 4 / 10.0 AS duplicate_rate, cast(n_chars % 15 as int) AS event_count, CASE WHEN doc_id % 9 > 0 THEN cast(doc_id % 800 as double) END AS freshness_hours, cast(doc_id % 5 as int) AS crawl_attempts,
        cast(CASE WHEN doc_id % 5 > 2 THEN 1 ELSE 0 END as int) AS crawl_failures
      FROM documents"""


def discovery(spark: SparkSession, d: str) -> DataFrame:
    df = spark.sql(_discovery_select(True).replace("FROM documents", "FROM {docs}"), docs=read(spark, d, "documents"))
    return df.withColumns({c: F.col(c).cast("double") for c in ("sandbox_quality", "duplicate_rate")})


DISCOVERY_SQL = f"WITH records AS ({_discovery_select(False)})"
