"""Vector search, walks and their fusion."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import scoring, vectors
from weftline.operators.graph import documents_for, small_frontier
from weftline.operators.records import hit_payload
from weftline.options import DEFAULTS, Options
from weftline.plans.index import VectorIndex, best, units
from weftline.sources.edges import EdgeStore
from weftline.sources.shared import new_folder, written


#: Questions (2 MB for 64 numbers) that are sent to every task.
BROADCAST_QUESTIONS = 4096


def literal_vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def vector_search(table: DataFrame, query: Sequence[float], k: int, floor: float | None = None) -> DataFrame:
    """The k rows (id, embedding) most like the query by cosine, ties by id. A scan with a bounded heap per task, no shuffle."""
    scored = table.where("embedding is not null").select("id", vectors.cosine(F.col("embedding"), literal_vector(query)).alias("similarity"))
    if floor is not None:
        scored = scored.where(F.col("similarity") >= floor)
    return scored.orderBy(F.desc("similarity"), "id").limit(k)


def vector_search_all(table: DataFrame, queries: DataFrame, k: int, floor: float | None = None) -> DataFrame:
    """query, id, similarity and rank: of each query (id, embedding) the k rows most like it but itself, ties by id.

    Up to BROADCAST_QUESTIONS are sent to one scan, whose tasks send out k rows for each at most. More are answered from an
    index of the rows: questions and rows meet as blocks, a cell at a time, where bounds allow it.
    """
    spark, kind = table.sparkSession, dict(table.dtypes)["id"]
    asked = queries.where("id is not null and embedding is not null").select("id", F.col("embedding").cast("array<double>").alias("embedding"))
    few = asked.limit(BROADCAST_QUESTIONS + 1).toPandas()
    if len(few) > BROADCAST_QUESTIONS:
        return VectorIndex.build(table, new_folder(spark, "search")).search(queries, k, floor)
    sent = spark.sparkContext.broadcast((few["id"].to_numpy(object), units(few["embedding"]) if len(few) else None))

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        named, matrix = sent.value
        least = np.full(len(named), -np.inf if floor is None else floor)
        held = pd.DataFrame({"query": [], "id": [], "similarity": []}).astype({"query": object, "id": object, "similarity": "float64"})
        for frame in frames if matrix is not None else ():
            for at in range(0, len(frame), 4096):
                part = frame.iloc[at : at + 4096]
                q, found, near = best(named, matrix, part["id"].to_numpy(object), units(part["embedding"]), k, least)
                new = pd.DataFrame({"query": named[q], "id": found, "similarity": near})
                held = pd.concat([held, new]).sort_values(["similarity", "id"], ascending=[False, True]).groupby("query").head(k)
        yield held

    rows = table.where("id is not null and embedding is not null").select("id", "embedding")
    order = Window.partitionBy("query").orderBy(F.desc("similarity"), "id")
    found = rows.mapInPandas(compare, f"query {kind}, id {kind}, similarity double")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def select_seeds(exact: DataFrame, vector_hits: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """Seeds of the first tier that has any: exact labels, similar enough hits, any hits (the last two: the first few)."""
    top = Window.partitionBy("tier").orderBy(F.desc("similarity"), "id")
    near = vector_hits.withColumn("tier", F.when(F.col("similarity") >= options.seed_similarity, 1).otherwise(2)).withColumn("n", F.row_number().over(top)).where(F.col("n") <= options.seed_top)
    tiers = exact.select("id", F.lit(0).alias("tier")).unionAll(near.select("id", "tier"))
    first = F.min("tier").over(Window.partitionBy(F.lit(0)))  # at most the exact hits and twice the seeds
    return tiers.withColumn("first", first).where("tier = first").select("id").distinct()


def best_path_walk(edges: DataFrame | EdgeStore, entity: DataFrame, seeds: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """id, score and hops of what the seeds reach: the greatest product of confidences over paths of at most ``max_hops`` edges.

    Level by level: only nodes whose score a level improved expand in the next. Seeds are left out.
    """
    seeds = written(seeds.select("id"), "seeds")
    best = seeds.select("id", F.lit(1.0).alias("score"), F.lit(0).alias("hops"))
    front = best.select(F.col("id").alias("origin"), F.col("score").alias("carried"))
    for hop in range(1, options.max_hops + 1):
        reached = small_frontier(edges, entity, front, options.k_graph, options.max_degree).groupBy("id").agg(F.max(F.col("carried") * F.col("confidence")).alias("found"))
        both = best.join(reached, "id", "full_outer")
        better = F.col("found") > F.coalesce("score", F.lit(0.0))
        both = both.select("id", F.when(better, F.col("found")).otherwise(F.col("score")).alias("score"), F.when(better, hop).otherwise(F.col("hops")).alias("hops"), F.coalesce(better, F.lit(False)).alias("better"))
        both = written(both, "walk")  # at most origins x k rows, read as result and as frontier
        front = both.where("better").select(F.col("id").alias("origin"), F.col("score").alias("carried"))
        best = both.drop("better")
    hits = best.join(seeds.select("id"), "id", "left_anti").where("score > 0")
    return hits.orderBy(F.desc("score"), "id").limit(options.k_graph)


def router_walk(edges: DataFrame | EdgeStore, entity: DataFrame, seeds: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """id and score: the best sighting of each node, where a node expands once and carries its first sighting. Seeds stay, at 1.

    First is by the origin's place in its frontier, then by the neighbour's rank at the origin.
    """
    front = seeds.select(F.col("id").alias("origin"), F.lit(1.0).alias("carried"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("id")).cast("long").alias("place"))
    score, visited = seeds.select("id", F.lit(1.0).alias("score")), seeds.select("id")
    for _ in range(options.max_hops):
        seen = small_frontier(edges, entity, front, options.router_k, options.max_degree).select("id", (F.col("carried") * F.col("confidence")).alias("s"), (F.col("place") * 1000 + F.col("rank")).alias("turn"))
        per = seen.groupBy("id").agg(F.max("s").alias("s"), F.min_by("s", "turn").alias("carried"), F.min("turn").alias("place"))
        score = score.join(per.select("id", "s"), "id", "full_outer").select("id", F.greatest("score", "s").alias("score"))
        fresh = written(per.join(visited, "id", "left_anti"), "walk")
        visited = visited.unionAll(fresh.select("id"))
        front = fresh.select(F.col("id").alias("origin"), "carried", "place")
    return score


def impact(edges: DataFrame | EdgeStore, entity: DataFrame, seed: DataFrame, hops: int = 3, options: Options = DEFAULTS) -> DataFrame:
    """id, hops and confidence of what a seed may affect: the first ring is wide, later ones narrow, each node expands once; its strongest sighting counts."""
    front = seed.select(F.col("id").alias("origin"), F.lit(1.0).alias("carried"))
    visited, sightings = seed.select("id"), None
    for hop in range(1, min(hops, options.impact_hops) + 1):
        cap = options.impact_first_cap if hop == 1 else options.max_degree
        k = max(cap, options.impact_k) if hop == 1 else options.impact_k
        seen = small_frontier(edges, entity, front, k, cap).select("id", (F.col("carried") * F.col("confidence")).alias("confidence"), F.lit(hop).alias("hops"))
        sightings = seen if sightings is None else sightings.unionAll(seen)
        fresh = written(seen.groupBy("id").agg(F.max("confidence").alias("carried")).join(visited, "id", "left_anti").where("carried > 0"), "walk")
        visited = visited.unionAll(fresh.select("id"))
        front = fresh.select(F.col("id").alias("origin"), "carried")
    strongest = sightings.groupBy("id").agg(F.max_by("hops", F.struct("confidence", -F.col("hops"))).alias("hops"), F.round(F.max("confidence"), 4).alias("confidence"))
    return strongest.orderBy(F.desc("confidence"), "hops", "id").limit(options.impact_rows)


def impact_report(hits: DataFrame, mentions: DataFrame, documents: DataFrame, per_entity: int = 2) -> DataFrame:
    """Impacted nodes (id, hops, confidence) with the first documents that support each: (doc, path) of documents (id, path)."""
    found = documents_for(hits.select("id"), mentions, documents)
    return hits.join(found, "id").select("id", "hops", "confidence", F.slice("documents", 1, per_entity).alias("citations"))


def routed_response(fused: DataFrame, mentions: DataFrame, documents: DataFrame) -> DataFrame:
    """Fused hits with all parts of their score, whether both arms found them, and their documents (doc, path)."""
    return hit_payload(fused).join(documents_for(fused.select("id"), mentions, documents), "id")


def fuse(vector_hits: DataFrame, graph_hits: DataFrame, attributes: DataFrame, intent: str, now: Column, options: Options = DEFAULTS) -> DataFrame:
    """Both arms by id, scored (a * vector + b * graph) * decay. The vector arm may fill what the graph arm leaves of ``total_k``, and two at least."""
    one = Window.partitionBy(F.lit(0))  # both arms are limited to a few rows
    graph = graph_hits.select("id", F.col("score").alias("graph"), F.lit(None).cast("double").alias("vector"))
    vector = vector_hits.select("id", F.lit(None).cast("double").alias("graph"), F.col("similarity").alias("vector"))
    rows = graph.unionAll(vector).withColumn("n_graph", F.count("graph").over(one))
    rows = rows.withColumn("turn", F.row_number().over(one.orderBy(F.desc_nulls_last("vector"), "id")))
    rows = rows.where(F.col("graph").isNotNull() | (F.col("turn") <= F.greatest(F.lit(options.min_vector_k), F.lit(options.total_k) - F.col("n_graph"))))
    both = rows.groupBy("id").agg(F.max("vector").alias("vector"), F.max("graph").alias("graph")).join(attributes.select("id", "label", "type", "ts"), "id", "left")
    recency = scoring.decay(F.col("ts"), F.col("type"), now, options)
    score = scoring.fused(F.col("vector"), F.col("graph"), recency, intent, options)
    scored = both.select("id", "label", "type", F.coalesce("vector", F.lit(0.0)).alias("vector_score"), F.coalesce("graph", F.lit(0.0)).alias("graph_score"), recency.alias("recency"), score.alias("score"))
    return scored.orderBy(F.desc("score"), "id").limit(options.total_k)
