"""Queries that run as streams over the driver's tables and return what they have written, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from eventloom.operators import users
from eventloom.plans.adapters import CATALOG_SQL, catalog, read
from eventloom.plans.queries import _PROFILE, query
from eventloom.plans.upkeep import _greedy
from eventloom.staging import shared_dir
from eventloom.streaming import incremental
from eventloom.streaming.ledger import Catalog


def _fresh(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _stream(spark, d, name: str):
    # As a pattern, since a table may be one file.
    return incremental.stream(spark, f"{d}/[{name[0]}]{name[1:]}.parquet", read(spark, d, name).schema)


def _log(events):
    """The interactions of `adapters.log`, from a stream."""
    kind = F.expr("case event_type when 'purchase' then 'attend' when 'signup' then 'register' when 'error' then 'ignore' else event_type end")
    key = F.concat(F.lit("x.example.com/e"), F.lpad((F.col("event_id") * 7 % 200).cast("string"), 9, "0"))
    return events.select(F.col("user_id").cast("string").alias("user_id"), kind.alias("type"), F.col("ts").alias("at"), key.alias("event_key"))


@query(f"{_PROFILE} SELECT user_id, feature, round(CAST(weight AS DOUBLE), 4) AS weight FROM prof")
def q_stream_profile(spark, d):
    """Profiles folded from the log as it comes; each batch writes the sums that it changed, and the last of a profile counts."""
    feats = catalog(spark, d).select("key", users.features().alias("features"))
    out = _fresh(spark, "stream-profile")

    def write(batch, n):
        batch.withColumn("n", F.lit(n)).write.mode("overwrite").parquet(f"{out}/batch={n}")

    incremental.run_available(incremental.profile_stream(_log(_stream(spark, d, "events")), feats), _fresh(spark, "checkpoint"), write)
    return spark.read.parquet(out).groupBy("user_id", "feature").agg(F.max_by("weight", "n").alias("weight")).select("user_id", "feature", F.round("weight", 4).alias("weight"))


@query(f"WITH RECURSIVE {_greedy('log AS (SELECT user_id AS key, epoch_us(ts) AS t, event_id FROM events)', 21600)} SELECT event_id, admitted FROM w")
def q_stream_admission(spark, d):
    out = _fresh(spark, "stream-admission")
    s = incremental.admission_stream(_stream(spark, d, "events"), "user_id", "ts", 21600, "event_id")
    incremental.run_available(s, _fresh(spark, "checkpoint"), lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}"), mode="append")
    return spark.read.parquet(out).select("event_id", "admitted")


@query("SELECT url, count(*) > 0 AS crawled FROM pages GROUP BY url")
def q_stream_dedup(spark, d):
    """A url that comes again within a day of its crawl is dropped; all pages come within one, each of them twice."""
    out = _fresh(spark, "stream-pages")
    p = _stream(spark, d, "pages").select("url", F.explode(F.array(*[F.lit(f"2026-07-15 {h}:00:00").cast("timestamp") for h in (12, 18)])).alias("at"))
    incremental.run_available(incremental.crawl_once(p), _fresh(spark, "checkpoint"), lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}"), mode="append")
    return spark.read.parquet(out).groupBy("url").agg((F.count(F.lit(1)) == 1).alias("crawled"))


# Three batches over the whole catalog: all of it, an edit of some titles' hashes with a withdrawal, and the second one again.
_EDITED = "CASE WHEN n_chars % 3 = 0 THEN concat(content_hash, 'x') ELSE content_hash END"


@query(f"{CATALOG_SQL}, c AS (SELECT catalog.*, n_chars FROM catalog JOIN documents USING (doc_id)) SELECT key, CASE WHEN n_chars % 3 = 0 THEN 2 ELSE 1 END AS version, CASE WHEN n_chars % 5 = 0 THEN 'withdrawn' ELSE status END AS status, {_EDITED} AS content_hash FROM c")
def q_catalog_batches(spark, d):
    c = catalog(spark, d).join(read(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").drop("doc_id")
    cat = Catalog(spark, _fresh(spark, "catalog"))
    edited = c.withColumns({"content_hash": F.expr(_EDITED), "status": F.when(F.col("n_chars") % 5 == 0, "withdrawn").otherwise(F.col("status"))})
    for n, rows in enumerate((c, edited, edited)):
        cat.apply(rows.drop("n_chars"), min(n, 1), F.col("last_seen_at"))
    return cat.read().select("key", "version", "status", "content_hash")


@query(f"""{CATALOG_SQL}, c AS (SELECT catalog.*, n_chars FROM catalog JOIN documents USING (doc_id)), g AS (SELECT key, n_chars % 5 = 0 AND status <> 'withdrawn' AS gone, n_chars % 3 = 0 AS edited FROM c)
SELECT 0 AS batch, key, 'NEW' AS change FROM c UNION ALL SELECT 1, key, CASE WHEN gone THEN 'CANCELLED' ELSE 'UPDATED' END FROM g WHERE gone OR edited""")
def q_batch_changes(spark, d):
    """What each batch of an ingest changed, noted as it was merged."""
    c = catalog(spark, d).join(read(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").drop("doc_id")
    cat, out = Catalog(spark, _fresh(spark, "catalog")), _fresh(spark, "changes")
    edited = c.withColumns({"content_hash": F.expr(_EDITED), "status": F.when(F.col("n_chars") % 5 == 0, "withdrawn").otherwise(F.col("status"))})
    for n, rows in enumerate((c, edited)):
        cat.apply(rows.drop("n_chars"), n, F.col("last_seen_at"), lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/of={n}"))
    return spark.read.parquet(out).select("batch", "key", "change")
