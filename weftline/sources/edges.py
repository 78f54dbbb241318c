"""Edges stored by hashed origin, seen from both ends, so that a frontier reads the buckets of its origins.

``<path>/bucket=B`` holds origin, id, relation, confidence and the neighbour's ts, sorted by origin: a walk needs no other
table. An edge lies in the buckets of both its ends (a loop once); an end that is no known entity makes no row. A hub's edges
are dealt over ``HUB_FILES`` files of its bucket. The number of buckets follows the number of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.sources.shared import SMALL_ROWS, new_folder, tasks_for

BUCKET_ROWS, MAX_BUCKETS, HUB_FILES = 1_000_000, 4096, 8
#: At least so many, so that a few origins prune most of a small graph.
MIN_BUCKETS = 32


@dataclass(frozen=True)
class EdgeStore:
    spark: SparkSession
    path: str
    buckets: int

    @staticmethod
    def write(edges: DataFrame, entity: DataFrame, path: str | None = None, buckets: int | None = None) -> EdgeStore:
        """Store edges (src, dst, relation, confidence) with the times of entity (id, ts)."""
        from weftline.operators.graph import both_ways

        rows = both_ways(edges).join(entity.select("id", "ts"), "id")
        names = {c: F.col(c) for c in ("origin", "id", "relation", "confidence")}
        return EdgeStore.place(rows, 2 * edges.count(), names, ["origin"], F.col("id"), path, buckets)

    @staticmethod
    def place(rows: DataFrame, n: int, names: dict[str, Column], order: list[str], spread: Column, path: str | None = None, buckets: int | None = None) -> EdgeStore:
        """Store about n rows with a ts, as seen from their origins. ``names`` makes origin, id, relation and confidence, after the one shuffle; rows lie in ``order``, a hub's are dealt by ``spread``."""
        spark = rows.sparkSession
        path = path or new_folder(spark, "edges")
        if buckets is None:
            buckets = max(MIN_BUCKETS, min(MAX_BUCKETS, -(-n // BUCKET_ROWS)))
        placed = rows.withColumn("bucket", _bucket(names["origin"], buckets))
        placed = placed.repartition(tasks_for(spark, n), "bucket", F.pmod(F.xxhash64(spread), F.lit(HUB_FILES))).sortWithinPartitions("bucket", *order)
        placed.select(*[names[c].alias(c) for c in ("origin", "id", "relation", "confidence")], "ts", "bucket").write.partitionBy("bucket").parquet(path)
        return EdgeStore(spark, path, buckets)

    def rows(self) -> DataFrame:
        return self.spark.read.schema("origin string, id string, relation string, confidence double, ts timestamp, bucket int").parquet(self.path)

    def at(self, origins: DataFrame) -> DataFrame:
        """origin, id, relation, confidence, ts and the origins' other columns, of every edge at an origin (a written table).

        Up to SMALL_ROWS origins are sent to the scan, which reads their buckets alone; more meet the edges by a shuffle.
        """
        own = origins.withColumn("bucket", _bucket(F.col("origin"), self.buckets))
        if origins.count() > SMALL_ROWS:
            return self.rows().join(own, ["bucket", "origin"]).drop("bucket")
        wanted = [r["bucket"] for r in own.select("bucket").distinct().collect()]  # at most as many as buckets
        return self.rows().where(F.col("bucket").isin(wanted)).join(F.broadcast(own.drop("bucket")), "origin").drop("bucket")


def _bucket(origin: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(origin), F.lit(buckets)).cast("int")


_stores: dict[tuple[str, str], EdgeStore] = {}


def stored(spark: SparkSession, folder: str) -> EdgeStore:
    """The store of the graph view of a folder of tables, written once by an application."""
    from weftline.sources.graph import numbered_ends, numbered_names, relation_rows

    key = (spark.sparkContext.applicationId, folder)
    if key not in _stores:
        _stores[key] = EdgeStore.place(numbered_ends(spark, folder), 2 * relation_rows(spark, folder), numbered_names(), ["kind", "origin_key"], F.col("key"))
    return _stores[key]
