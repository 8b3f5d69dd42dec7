"""Keyed Parquet tables kept current by micro-batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import insert_if_absent, replace_partitions, upsert_latest


class KeyedTable:
    """A table partitioned by a hash of its key; a batch rewrites only the buckets it touches.

    The merged buckets are staged under the batch id first. A batch that is run again after a crash
    finds its complete staging and only repeats the partition overwrite, so a merge happens once.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], order: str, buckets: int = 16):
        self.spark, self.path, self.keys, self.order, self.buckets = spark, path.rstrip("/"), list(keys), order, buckets
        self.data = f"{self.path}/data"

    def _exists(self, path: str) -> bool:
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target)

    def read(self, schema=None) -> DataFrame | None:
        if not self._exists(self.data):
            return None
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(self.data).drop("_bucket")

    def _merge(self, batch: DataFrame, batch_id: int, how) -> None:
        staging = f"{self.path}/staging/{batch_id}"
        if not self._exists(f"{staging}/_SUCCESS"):
            bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
            incoming = batch.withColumn("_bucket", bucket)
            touched = [r[0] for r in incoming.select("_bucket").distinct().collect()]  # at most ``buckets`` numbers
            if not touched:
                return
            old = None
            if self._exists(self.data):
                old = self.spark.read.schema(incoming.schema).parquet(self.data).filter(F.col("_bucket").isin(touched))
            how(old, incoming, [*self.keys, "_bucket"], self.order).write.mode("overwrite").parquet(staging)
        merged = self.spark.read.parquet(staging)
        replace_partitions(merged, self.data, "_bucket")

    def upsert(self, batch: DataFrame, batch_id: int) -> None:
        self._merge(batch, batch_id, upsert_latest)

    def insert(self, batch: DataFrame, batch_id: int) -> None:
        self._merge(batch, batch_id, insert_if_absent)
