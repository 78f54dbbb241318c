"""Reads of the graph: neighbours, frontiers, degrees, hubs, subgraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.sources.edges import EdgeStore
from weftline.sources.shared import sent_if_small, tasks_for, written


def both_ways(edges: DataFrame) -> DataFrame:
    """origin, id, relation, confidence: every edge seen from either end; a loop once."""
    ends = [F.struct(F.col(a).alias("origin"), F.col(b).alias("id")) for a, b in (("src", "dst"), ("dst", "src"))]
    sides = F.when(F.col("src") == F.col("dst"), F.array(ends[0])).otherwise(F.array(*ends))
    return edges.select(F.explode(sides).alias("e"), "relation", "confidence").select("e.origin", "e.id", "relation", "confidence")


def at_origins(edges: DataFrame, origins: DataFrame) -> DataFrame:
    """The same, of the edges at an origin (with the origins' other columns).

    Each end is a semi join of its own, which Spark moves below unions and distincts into the scans: with a small set of
    origins no edge is shuffled that is not at one of them.
    """
    names = origins.select("origin")
    ends = lambda a, b: edges.select(F.col(a).alias("origin"), F.col(b).alias("id"), "relation", "confidence").join(names, "origin", "left_semi")
    return ends("src", "dst").unionAll(ends("dst", "src").where("origin <> id")).join(origins, "origin")


def neighbours(edges: DataFrame, k: int, origins: DataFrame | None = None) -> DataFrame:
    """Of each origin (every node, if none are named) the k edges of greatest confidence, ties by neighbour and relation."""
    found = both_ways(edges) if origins is None else at_origins(edges, origins.select("origin").distinct())
    rank = F.row_number().over(Window.partitionBy("origin").orderBy(F.desc("confidence"), "id", "relation"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def capped(near: DataFrame, k: int, max_degree: int | None) -> DataFrame:
    """near: origin, id, relation, confidence, ts. At most ``max_degree`` neighbours of each (origin, relation), then k rows of each origin.

    Order: confidence, then the neighbour's time, newest first and unknown last, then its id.
    """
    order = [F.desc("confidence"), F.desc_nulls_last("ts"), "id", "relation"]
    if max_degree is not None:
        near = near.withColumn("in_relation", F.dense_rank().over(Window.partitionBy("origin", "relation").orderBy(*order[:3]))).where(F.col("in_relation") <= max_degree).drop("in_relation")
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("origin").orderBy(*order))).where(F.col("rank") <= k)


def frontier(edges: DataFrame, entity: DataFrame, origins: DataFrame, k: int, max_degree: int | None) -> DataFrame:
    """Expand many origins (with any other columns) at once, by the rule of ``capped``."""
    return capped(at_origins(edges, origins).join(entity.select("id", "ts"), "id"), k, max_degree)


def small_frontier(edges: DataFrame | EdgeStore, entity: DataFrame, origins: DataFrame, k: int, max_degree: int | None) -> DataFrame:
    """The same for a few origins (a written table, if the edges are stored), as a walk has them: they, and then their neighbours' ids, are sent to the scans as long as they are few."""
    if isinstance(edges, EdgeStore):  # it has the times, and reads the origins' buckets alone
        return written(capped(edges.at(origins), k, max_degree), "frontier")
    origins = sent_if_small(written(origins, "origins"))
    near = written(at_origins(edges, origins), "near")
    times = entity.select("id", "ts").join(sent_if_small(near.select("id").distinct(), near.count()), "id", "left_semi")
    return written(capped(near.join(times, "id"), k, max_degree), "frontier")


def degrees(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """Distinct neighbours of every node. ``rows``, the number of edges if known, deals the pairs over as many tasks as they need; no pair is held before."""
    pairs = both_ways(edges).where("origin <> id").select(F.col("origin").alias("id"), F.col("id").alias("other"))
    if rows is not None:
        pairs = pairs.repartition(tasks_for(edges.sparkSession, 2 * rows), "id", "other")
    pairs = pairs.distinct()
    return pairs.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def hubs(edges: DataFrame, entity: DataFrame, limit: int, rows: int | None = None) -> DataFrame:
    """The busiest entities, ties by label."""
    return degrees(edges, rows).join(entity.select("id", "label", "type"), "id").orderBy(F.desc("degree"), "label", "id").limit(limit)


def subgraph_nodes(edges: DataFrame, entity: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted nodes and their direct neighbours; ``requested`` tells which."""
    near = both_ways(edges).join(wanted.select(F.col("id").alias("origin")), "origin").select("id", F.lit(0).alias("requested"))
    ids = wanted.select("id", F.lit(1).alias("requested")).unionAll(near).groupBy("id").agg(F.max("requested").alias("requested"))
    return ids.join(entity, "id").withColumn("requested", F.col("requested") == 1)


def subgraph_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    ends = nodes.select("id")
    return edges.join(ends.withColumnRenamed("id", "src"), "src", "left_semi").join(ends.withColumnRenamed("id", "dst"), "dst", "left_semi").withColumn("relation", F.coalesce("relation", F.lit("CO_OCCURS")))


def documents_for(ids: DataFrame, mentions: DataFrame, documents: DataFrame) -> DataFrame:
    """Every asked id with its documents in order of id; an empty list where there are none."""
    found = ids.select("id").distinct().join(mentions.select(F.col("entity").alias("id"), "doc").distinct(), "id", "left").join(documents.select(F.col("id").alias("doc"), "path", F.lit(True).alias("known")), "doc", "left")
    return found.groupBy("id").agg(F.array_sort(F.collect_list(F.when(F.col("known"), F.struct("doc", "path")))).alias("documents"))
