"""Incremental upserts: state lies in hash buckets of its keys, and a batch writes only the buckets that it touches.

``<folder>/state/batch=N/bucket=B`` holds a bucket as batch N left it, ``<folder>/manifest/batch=N`` names the buckets of
batch N. A restart from the folder's checkpoint reads the manifests of earlier batches; a batch that is tried again overwrites its own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.sources.shared import new_folder

__all__ = ["new_folder", "run_to_end", "state"]

BUCKETS = 16
Fold = Callable[[DataFrame | None, DataFrame], DataFrame]


def _newest(spark: SparkSession, folder: str, before: int | None = None) -> dict[int, int]:
    """The last batch of each bucket, of the batches before a number."""
    told = spark.read.schema("bucket int, batch long").option("basePath", f"{folder}/manifest").parquet(f"{folder}/manifest")
    told = told if before is None else told.where(F.col("batch") < before)
    return {r["bucket"]: r["batch"] for r in told.groupBy("bucket").agg(F.max("batch").alias("batch")).collect()}


def _tell(spark: SparkSession, folder: str, batch: int, buckets: list[int]) -> None:
    spark.createDataFrame([(b,) for b in buckets], "bucket int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest/batch={batch}")


def _read(spark: SparkSession, folder: str, newest: dict[int, int]) -> DataFrame | None:
    paths = [f"{folder}/state/batch={batch}/bucket={bucket}" for bucket, batch in sorted(newest.items())]
    return spark.read.parquet(*paths) if paths else None


def state(spark: SparkSession, folder: str) -> DataFrame | None:
    """The state that all batches so far have left; None before the first."""
    return _read(spark, folder, _newest(spark, folder))


def run_to_end(stream: DataFrame, folder: str, keys: Sequence[str], fold: Fold, mode: str = "append") -> DataFrame:
    """Read all that is there now and give the state. ``fold`` makes the next state from the last one (null at first) and a batch; both have the keys."""
    spark: SparkSession = stream.sparkSession
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")
    _tell(spark, folder, -1, [])

    def write(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        batch.persist()
        try:
            touched = [r["bucket"] for r in batch.select(bucket.alias("bucket")).distinct().collect()]
            newest = _newest(own, folder, number)
            last = _read(own, folder, {b: newest[b] for b in touched if b in newest})
            fold(last, batch).withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/state/batch={number}")
            _tell(own, folder, number, touched)
        finally:
            batch.unpersist()

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    now = state(spark, folder)
    return fold(None, spark.createDataFrame([], stream.schema)) if now is None else now
