"""A catalog that batches change in place of their keys' buckets, exactly once.

Rows live in Parquet by a hash bucket of their key. A batch reads and writes only the buckets that it hits, into
files of its own; what it wrote counts from the moment its line in the ledger appears, which is one file appended last. Of a
bucket, the last batch in the ledger counts. So a batch that broke off before its line left nothing, one
that comes again after its line changes nothing, and buckets that it did not hit keep their files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.operators.merge import detect_changes, upsert
from eventloom.staging import staged

#: Buckets of a catalog; a hit bucket is rewritten whole.
BUCKETS = 64
_LEDGER = "batch long, bucket int"


class Catalog:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets

    def _exists(self, part: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def ledger(self) -> DataFrame:
        """batch, bucket of everything that counts."""
        return self.spark.read.schema(_LEDGER).parquet(f"{self.path}/ledger") if self._exists("ledger") else self.spark.createDataFrame([], _LEDGER)

    def current(self) -> dict[int, int]:
        """The batch that holds each bucket: one number a bucket."""
        return {r.bucket: r.batch for r in self.ledger().groupBy("bucket").agg(F.max("batch").alias("batch")).collect()}

    def read(self, only: set[int] | None = None, at: dict[int, int] | None = None) -> DataFrame | None:
        """The rows that are there, of some buckets: other buckets' and older files are not opened."""
        held = {b: n for b, n in (self.current() if at is None else at).items() if only is None or b in only}
        if not held:
            return None
        paths = [f"{self.path}/data/batch={n}/bucket={b}" for b, n in sorted(held.items())]
        return self.spark.read.option("basePath", f"{self.path}/data").parquet(*paths).drop("batch", "bucket")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int")

    def apply(self, rows: DataFrame, batch: int, order: Column, changes: Callable[[DataFrame, int], None] | None = None) -> bool:
        """MERGE a batch; False if it has been applied before. changes: gets what the batch changed (key, change), before it counts."""
        if self.ledger().filter(F.col("batch") == batch).limit(1).count():
            return False
        new = staged(rows.withColumn("bucket", self._bucket()), "batch")
        hit = {r.bucket for r in new.select("bucket").distinct().collect()}  # at most so many as there are buckets
        old = self.read(hit)
        base = old if old is not None else new.drop("bucket").limit(0)
        merged = upsert(base, new.drop("bucket"), order).drop("action").withColumn("bucket", self._bucket())
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/batch={batch}")
        if changes is not None:
            written = self.spark.read.parquet(f"{self.path}/data/batch={batch}").drop("bucket")
            changes(detect_changes(base, written), batch)
        self._commit(batch, hit)
        return True

    def _commit(self, batch: int, hit: set[int]) -> None:
        self.spark.createDataFrame([(batch, b) for b in sorted(hit)], _LEDGER).coalesce(1).write.mode("append").parquet(f"{self.path}/ledger")

    def sink(self, order: str) -> Callable[[DataFrame, int], None]:
        """foreachBatch of an ingest: a stream that resumes after a crash gives its last batch again, which takes effect once."""
        return lambda rows, n: self.apply(rows, n, F.col(order)) and None

    def vacuum(self) -> int:
        """Files of buckets that later batches have rewritten go; how many folders."""
        held = set(self.current().items())
        gone = [(r.batch, r.bucket) for r in self.ledger().distinct().collect() if (r.bucket, r.batch) not in held]
        jvm = self.spark.sparkContext._jvm
        for n, b in gone:
            at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/data/batch={n}/bucket={b}")
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        return len(gone)
