"""The incremental parts under Structured Streaming (Z01-Z03, Z05, Z06); batches into a catalog are in `ledger`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions.text import literal_map
from eventloom.operators.users import INTERACTIONS


def stream(spark: SparkSession, path: str, schema, per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def profile_stream(log: DataFrame, feats: DataFrame) -> DataFrame:
    """Running sums of user and feature over a log (Z05); features are a static side."""
    w = F.coalesce(F.try_element_at(literal_map(INTERACTIONS), F.col("type")), F.lit(0.0))
    return log.join(feats, log["event_key"] == feats["key"]).select("user_id", w.alias("w"), F.explode("features").alias("feature")).groupBy("user_id", "feature").agg(F.sum("w").alias("weight"))


def crawl_once(pages: DataFrame, hours: int = 24) -> DataFrame:
    """A url again within the watermark is dropped."""
    return pages.withWatermark("at", f"{hours} hours").dropDuplicatesWithinWatermark(["url"])


def windowed_counts(log: DataFrame, width: str, late: str) -> DataFrame:
    return log.withWatermark("at", late).groupBy(F.window("at", width), "type").agg(F.count(F.lit(1)).alias("n"))


def run_available(df: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], mode: str = "update") -> None:
    """One pass over what is there (Z01): availableNow, then stop; a rerun goes on from the checkpoint."""
    df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


STATE = "runs long, successes long, streak long, found double, circuit string, next_run timestamp"
THRESHOLD, BASE_S, MOST_S, COOLDOWN_S = 3, 60, 600, 900


def fold_runs(state: tuple | None, rows: list[tuple]) -> tuple:
    """The state of a source after runs (at, ok, found) in order: running mean, streak, backoff, open circuit."""
    import datetime as dt

    runs, good, streak, mean, circuit, nxt = state or (0, 0, 0, 0.0, "closed", None)
    for at, ok, found in sorted(rows):
        runs += 1
        if ok:
            good += 1
            mean += (found - mean) / good
            streak, circuit, nxt = 0, "closed", at
        else:
            streak += 1
            circuit = "open" if streak >= THRESHOLD else circuit
            nxt = at + dt.timedelta(seconds=COOLDOWN_S if circuit == "open" else min(BASE_S * 2 ** (streak - 1), MOST_S))
    return runs, good, streak, mean, circuit, nxt


def provider_stream(runs: DataFrame) -> DataFrame:
    """Per source, its state after every batch: runs has provider, at, ok, found."""
    from eventloom.session import ship

    ship(runs.sparkSession)

    def step(key, frames, state):
        import pandas as pd

        rows = [r for f in frames for r in zip(f["at"].dt.to_pydatetime(), f["ok"], f["found"], strict=True)]
        new = fold_runs(state.get if state.exists else None, rows)
        state.update(new)
        yield pd.DataFrame([(key[0], *new)], columns=["provider", *[c.split()[0] for c in STATE.split(", ")]])

    return runs.groupBy("provider").applyInPandasWithState(step, f"provider string, {STATE}", STATE, "update", "NoTimeout")


def admission_stream(requests: DataFrame, per: str, at: str, seconds: float, *keep: str) -> DataFrame:
    """per, at, keep..., admitted: each request as `admission.admitted` judges it (Z06). The state of a key is its last admission.
    Requests of a key come in order of time from batch to batch; inside a batch they are sorted by time and the columns kept."""
    from eventloom.session import ship

    ship(requests.sparkSession)
    gap = seconds * 1_000_000
    cols = [per, at, *keep]
    kinds = dict(requests.dtypes)

    def step(key, frames, state):
        import pandas as pd

        rows = pd.concat(list(frames), ignore_index=True).sort_values([at, *keep], kind="stable")
        last = state.get[0] if state.exists else None
        let = []
        for t in rows[at].astype("datetime64[us]").astype("int64"):
            let.append(last is None or t - last >= gap)
            last = int(t) if let[-1] else last
        state.update((last,))
        yield rows.assign(admitted=let)[[*cols, "admitted"]]

    schema = ", ".join(f"{c} {kinds[c]}" for c in cols)
    return requests.select(*cols).groupBy(per).applyInPandasWithState(step, f"{schema}, admitted boolean", "last long", "append", "NoTimeout")
