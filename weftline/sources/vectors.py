"""Stored vectors with the identity of what made them: a store is refused by whoever embeds otherwise.

``<path>/identity`` names the format, the model and the width, ``<path>/vectors`` holds id and vector. A model of the same
width is another one, and a width can differ under a name that was not changed: both are checked, on every write and read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.vectors import checked_width, normalised

FORMAT = 1
_IDENTITY = "format int, model string, width int"


class Stale(ValueError):
    """The stored vectors were made by something else."""


def export_vectors(rows: DataFrame, path: str, model: str, width: int) -> None:
    """Store vectors (id, embedding), scaled to length one. One of another width fails the write; null ids and vectors are left out."""
    x = checked_width(F.col("embedding").cast("array<double>"), width, F.col("id").cast("string"))
    kept = rows.where("id is not null and embedding is not null").select("id", normalised(x).alias("embedding"))
    kept.write.mode("errorifexists").parquet(f"{path}/vectors")
    # Last: a store without it is one whose writing has failed.
    rows.sparkSession.createDataFrame([(FORMAT, model, width)], _IDENTITY).coalesce(1).write.mode("errorifexists").json(f"{path}/identity")


def import_vectors(spark: SparkSession, path: str, model: str, width: int) -> DataFrame:
    """The stored vectors, if they are of this model and width."""
    try:
        told = spark.read.schema(_IDENTITY).json(f"{path}/identity").first()
    except Exception as e:  # noqa: BLE001  Spark's own errors differ by file system
        raise Stale(f"{path} has no identity") from e
    if told is None or told["format"] != FORMAT:
        raise Stale(f"{path} has another format: {told and told['format']}")
    if told["model"] != model:
        raise Stale(f"{path} was made by {told['model']!r}, not by {model!r}")
    if told["width"] != width:
        raise Stale(f"{path} holds vectors of width {told['width']}, not {width}")
    return spark.read.parquet(f"{path}/vectors")
