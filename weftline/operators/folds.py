"""Upserts as folds: the state after a batch is an aggregate of the state before and the batch, in order of ``seq``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert_entities(rows: DataFrame) -> DataFrame:
    """rows: id, label, type, ts, seq. Label and type of the first row stay, the latest known time wins."""
    return rows.groupBy("id").agg(F.min_by(F.struct("label", "type"), "seq").alias("first"), F.max("ts").alias("ts")).select("id", "first.label", "first.type", "ts")


def upsert_relations(rows: DataFrame, entity: DataFrame) -> DataFrame:
    """rows: src, dst, relation, confidence, seq. One row per ordered pair with both ends known: the greatest confidence, the earliest of equals."""
    ids = entity.select("id")
    known = rows.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    best = F.max_by(F.struct("relation", "confidence"), F.struct("confidence", -F.col("seq"))).alias("best")
    return known.groupBy("src", "dst").agg(best).select("src", "dst", "best.relation", "best.confidence")


def upsert_documents(rows: DataFrame) -> DataFrame:
    """rows: id, path, content, seq. The last row wins."""
    return rows.groupBy("id").agg(F.max_by(F.struct("path", "content"), "seq").alias("last")).select("id", "last.path", "last.content")


def add_mentions(rows: DataFrame, documents: DataFrame, entity: DataFrame) -> DataFrame:
    """Distinct (doc, entity) pairs with both ends known."""
    return rows.join(documents.select(F.col("id").alias("doc")), "doc", "left_semi").join(entity.select(F.col("id").alias("entity")), "entity", "left_semi").select("doc", "entity").distinct()


def overwrite_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes by (org_id, node_id): the new row wins, only created_at stays."""
    after = new.select("org_id", "node_id", F.col("name").alias("n"), F.col("created_at").alias("c"), F.lit(True).alias("hit"))
    both = old.join(after, ["org_id", "node_id"], "full_outer")
    return both.select("org_id", "node_id", F.when(F.col("hit"), F.col("n")).otherwise(F.col("name")).alias("name"), F.coalesce("created_at", "c").alias("created_at"))


def overwrite_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges by (org_id, source_id, target_id, relation_type): only the weight is replaced."""
    key = ["org_id", "source_id", "target_id", "relation_type"]
    both = old.select(*key, "weight").join(new.select(*key, F.col("weight").alias("w")), key, "full_outer")
    return both.select(*key, F.coalesce("w", "weight").alias("weight"))


def drop_text_edges(edges: DataFrame, read_again: DataFrame) -> DataFrame:
    """Edges without the text relations of items that are read again."""
    stale = read_again.select(F.col("node_id").alias("source_id")).distinct()
    is_text = F.col("relation_type").isin("MENTIONS", "RESOLVES")
    return edges.where(~is_text).unionByName(edges.where(is_text).join(stale, "source_id", "left_anti").select(*edges.columns))


def drop_orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without the extracted entities that no edge points at."""
    targets = edges.select("org_id", F.col("target_id").alias("node_id")).distinct()
    extracted = F.startswith("node_id", F.lit("entity:"))
    return nodes.where(~extracted).unionByName(nodes.where(extracted).join(targets, ["org_id", "node_id"], "left_semi").select(*nodes.columns))


def first_nodes(rows: DataFrame, *columns: str) -> DataFrame:
    """First row of each id, in order of ``seq``."""
    return rows.groupBy("id").agg(F.min_by(F.struct(*columns), "seq").alias("first")).select("id", *[f"first.{c}" for c in columns])
