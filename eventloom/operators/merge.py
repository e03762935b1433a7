"""MERGE into the catalog, lifecycle transitions and change detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.operators.predicates import end

SNAPSHOT = ["key", "content_hash", "status", "version", "title", "location", "is_free", "price", "start_date", "end_date"]


def last_wins(batch: DataFrame, key: str, order: Column) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order.desc())
    return batch.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def upsert(catalog: DataFrame, batch: DataFrame, order: Column) -> DataFrame:
    """The catalog after the batch, with `action`: kept, inserted, touched or updated.

    Within the batch the last row of a key wins. An equal content hash only touches last_seen_at,
    status and its reason; another one rewrites the row, keeps first_seen_at and adds one to the version."""
    new = last_wins(batch, "key", order)
    cols = [c for c in catalog.columns if c != "key"]
    both = catalog.alias("o").join(new.alias("n"), "key", "full_outer")
    old, fresh = F.col("o.content_hash"), F.col("n.content_hash")
    action = F.when(fresh.isNull(), "kept").when(old.isNull(), "inserted").when(old == fresh, "touched").otherwise("updated")
    both = both.withColumn("action", action)

    def value(c: str) -> Column:
        o, n = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c == "first_seen_at":
            return F.when(F.col("action") == "inserted", n).otherwise(o)
        if c == "version":
            return F.when(F.col("action") == "inserted", F.lit(1)).when(F.col("action") == "updated", o + 1).otherwise(o)
        if c in ("last_seen_at", "status", "status_reason"):
            return F.when(F.col("action") == "kept", o).otherwise(n)
        return F.when(F.col("action").isin("kept", "touched"), o).otherwise(n)

    return both.select("key", *[value(c).alias(c) for c in cols], "action")


def expire(df: DataFrame, today: Column) -> DataFrame:
    return df.withColumn("status", F.when((F.col("status") == "active") & (end() < today), "expired").otherwise(F.col("status")))


def archive(df: DataFrame, cutoff: Column) -> DataFrame:
    return df.withColumn("status", F.when((F.col("status") == "expired") & (end() < cutoff), "archived").otherwise(F.col("status")))


def set_status(df: DataFrame, keys: DataFrame, status: str, reason: str | None) -> DataFrame:
    hit = df.join(keys.select("key").distinct().withColumn("_hit", F.lit(True)), "key", "left")
    on = F.coalesce("_hit", F.lit(False))
    return hit.withColumns({"status": F.when(on, F.lit(status)).otherwise(F.col("status")), "status_reason": F.when(on, F.lit(reason)).otherwise(F.col("status_reason"))}).drop("_hit")


def detect_changes(previous: DataFrame, current: DataFrame) -> DataFrame:
    """key, change: NEW; else CANCELLED; else EXPIRED; else UPDATED and what changed. Deleted keys are not reported.

    Status rules compare whether the row now is withdrawn (expired) with what it was, as the original does: `now is X` differs from the previous status."""
    p = previous.select(*[F.col(c).alias(f"p_{c}" if c != "key" else "key") for c in SNAPSHOT], F.lit(True).alias("p_there"))
    j = current.select(*SNAPSHOT).join(p, "key", "left")
    differ = lambda *cs: ~F.struct(*cs).eqNullSafe(F.struct(*[f"p_{c}" for c in cs]))
    gone = lambda s: (F.col("status") == s) & (F.col("p_status") != s)
    updated = F.array_compact(F.array(F.lit("UPDATED"), F.when(differ("location"), "VENUE_CHANGED"), F.when(differ("is_free", "price"), "COST_CHANGED"), F.when(differ("start_date", "end_date"), "DATE_CHANGED")))
    none = F.array().cast("array<string>")
    change = F.when(F.col("p_there").isNull(), F.array(F.lit("NEW"))).when(gone("withdrawn"), F.array(F.lit("CANCELLED"))).when(gone("expired"), F.array(F.lit("EXPIRED"))).when(F.col("content_hash") != F.col("p_content_hash"), updated).otherwise(none)
    return j.select("key", F.explode(change).alias("change"))


def lifecycle(today: Column, closing_days: int = 7, archive_days: int = 90) -> Column:
    return (
        F.when(F.col("status") == "archived", "archived")
        .when(F.datediff(today, end()) > archive_days, "archived")
        .when(end() < today, "completed")
        .when(F.col("start_date") <= today, "live_today")
        .when(F.col("start_date") <= F.date_add(today, closing_days), "registration_closing")
        .otherwise("upcoming")
    )


def registration(today: Column, closing_days: int = 7) -> Column:
    started = F.col("start_date") <= today
    return F.struct((~started & (F.col("start_date") <= F.date_add(today, closing_days))).alias("closing_soon"), started.alias("closed"), (started & (end() >= today)).alias("event_started"), (end() < today).alias("event_ended"))


def transitions(history: DataFrame, legal: DataFrame) -> DataFrame:
    """State changes of an audit log that the table of legal ones does not hold."""
    w = Window.partitionBy("key").orderBy("at", "state")
    steps = history.withColumn("before", F.lag("state").over(w)).filter("before is not null and before <> state")
    return steps.join(F.broadcast(legal.select(F.col("source").alias("before"), F.col("target").alias("state"))), ["before", "state"], "left_anti")


def checkpoint(catalog: DataFrame, per: str) -> DataFrame:
    """A fingerprint of each batch that does not depend on the order of its rows (M21): rows are hashed, the hashes of a key range
    (4096 of them) are folded, and then the ranges', so that no task holds the lines of a whole batch."""
    line = F.sha2(F.concat("key", F.lit(":"), "content_hash").cast("binary"), 256)
    fold = lambda x: F.sha2(F.array_join(x, "").cast("binary"), 256)
    rows = catalog.select(per, F.substring(F.sha2(F.col("key").cast("binary"), 256), 1, 3).alias("b"), line.alias("h"))
    ranges = rows.groupBy(per, "b").agg(fold(F.array_sort(F.collect_list("h"))).alias("h"))
    return ranges.groupBy(per).agg(fold(F.array_sort(F.collect_list(F.concat("b", "h")))).alias("checkpoint"))
