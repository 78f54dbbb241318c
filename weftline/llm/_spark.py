"""Small Spark helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Hash buckets that a global numbering is cut into; a bucket holds 1/4096 of a group's rows.
RANK_BUCKETS = 4096
#: Bytes of an Arrow batch, unless the session names a size of its own. A longer row is still one batch.
BATCH_BYTES = 2 << 20


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """A table of the corpus, only the named columns."""
    frame = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return frame.select(*columns) if columns else frame


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: the session's ``spark.checkpoint.dir``.

    Only in a local session that names none (tests) a temporary folder becomes its checkpoint folder; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="weftline-"))
    return spark.sparkContext.getCheckpointDir()


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ``BATCH_BYTES``, so that a Python worker holds little text at a time."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "67108864b") in ("67108864b", "67108864", "64m", "64MB"):
        spark.conf.set(key, BATCH_BYTES)


def map_texts(documents: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, *more: Column) -> DataFrame:
    """``function`` over small batches of doc_id (long), text (UTF-8 bytes) and the columns of ``more``."""
    small_batches(documents.sparkSession)
    given = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), *more)
    return given.mapInArrow(function, schema)


def materialize(frame: DataFrame, label: str) -> DataFrame:
    """Cut lineage with a table in the shared folder, so that a lost executor costs no recomputation of what came before."""
    spark = frame.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/weftline-{label}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def fresh(frame: DataFrame, name: str) -> str:
    """A name that none of the frame's columns has (Spark compares names without case)."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def spread(*columns: str | Column) -> Column:
    """Hash bucket of a row, 0 to RANK_BUCKETS - 1."""
    return F.pmod(F.xxhash64(*columns), F.lit(RANK_BUCKETS)).cast("int")


def number_rows(frame: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str | Column], name: str) -> DataFrame:
    """Number each key's rows from 0, in the order of ``bucket`` (int, not null) and then ``order``.

    Two levels, so that no task sees a whole key: counts per (key, bucket) are summed into offsets, a table of at most
    keys x buckets rows, and only the rows of one bucket are sorted together. Keys must not be null.
    """
    cells = frame.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("__rank_n"))
    before = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = before.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*keys, bucket, F.coalesce(F.sum("__rank_n").over(before), F.lit(0)).alias("__rank_before"))
    inside = Window.partitionBy(*keys, bucket).orderBy(*order)
    numbered = frame.join(cells, [*keys, bucket]).withColumn(name, F.col("__rank_before") + F.row_number().over(inside) - 1)
    return numbered.drop("__rank_before")
