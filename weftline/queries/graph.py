"""Reads of the graph view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import graph
from weftline.queries import query, sql
from weftline.sources.graph import entities, relation_rows, relations, table

_NATIONS = "SELECT 'nation:' || n_nationkey AS id FROM nation"


@query(f"WITH {sql.EDGES} SELECT origin AS id, count(DISTINCT id) AS degree FROM both_ways WHERE origin <> id GROUP BY origin")
def node_degree(spark: SparkSession, folder: str) -> DataFrame:
    return graph.degrees(relations(spark, folder), relation_rows(spark, folder))


@query(f"""
    WITH {sql.GRAPH}, d AS (SELECT origin AS id, count(DISTINCT id) AS degree FROM both_ways WHERE origin <> id GROUP BY origin)
    SELECT id, degree, label, type FROM d JOIN entity USING (id) ORDER BY degree DESC, label, id LIMIT 12
""")
def top_hubs(spark: SparkSession, folder: str) -> DataFrame:
    return graph.hubs(relations(spark, folder), entities(spark, folder), 12, relation_rows(spark, folder))


@query(f"""
    WITH {sql.EDGES} SELECT origin, id, relation, confidence, row_number() OVER (PARTITION BY origin ORDER BY confidence DESC, id, relation)::INTEGER AS rank
    FROM both_ways QUALIFY rank <= 10
""")
def neighbors_topk(spark: SparkSession, folder: str) -> DataFrame:
    return graph.neighbours(relations(spark, folder), 10).select("origin", "id", "relation", "confidence", "rank")


@query(f"""
    WITH {sql.GRAPH}, front AS (SELECT DISTINCT 'supp:' || s_suppkey AS origin, 1.0::DOUBLE AS carried FROM supplier), {sql.frontier("h", "front", 10, 5)}
    SELECT origin, id, relation, confidence, ts, rank::INTEGER AS rank FROM h
""")
def frontier_hub_cap(spark: SparkSession, folder: str) -> DataFrame:
    entity = entities(spark, folder)
    front = entity.where("type = 'Service'").select(F.col("id").alias("origin"), F.lit(1.0).alias("carried"))
    return graph.frontier(relations(spark, folder), entity, front, 10, 5).select("origin", "id", "relation", "confidence", "ts", "rank")


_SUBGRAPH = f"""
    {sql.GRAPH}, wanted AS MATERIALIZED ({_NATIONS}),
    nodes AS MATERIALIZED (SELECT id, max(requested) = 1 AS requested FROM (SELECT id, 1 AS requested FROM wanted UNION ALL SELECT id, 0 FROM both_ways WHERE origin IN (SELECT id FROM wanted)) GROUP BY id)
"""


def _subgraph(spark: SparkSession, folder: str) -> DataFrame:
    wanted = entities(spark, folder).where("type = 'Repo'").select("id")
    return graph.subgraph_nodes(relations(spark, folder), entities(spark, folder), wanted)


@query(f"WITH {_SUBGRAPH} SELECT id, requested, label, type, ts FROM nodes JOIN entity USING (id)")
def subgraph_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return _subgraph(spark, folder).select("id", "requested", "label", "type", "ts")


@query(f"WITH {_SUBGRAPH} SELECT src, dst, relation, confidence FROM edges WHERE src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes)")
def subgraph_edges(spark: SparkSession, folder: str) -> DataFrame:
    return graph.subgraph_edges(relations(spark, folder), _subgraph(spark, folder)).select("src", "dst", "relation", "confidence")


@query(f"""
    WITH {sql.ENTITY}, docs AS (SELECT 'doc:' || doc_id AS doc, source AS path, 'part:' || (doc_id % 500) AS entity FROM documents)
    SELECT e.id, count(d.doc) AS n, coalesce(string_agg(d.doc || '@' || d.path, ',' ORDER BY d.doc, d.path), '') AS documents
    FROM entity e LEFT JOIN docs d ON d.entity = e.id WHERE e.type = 'File' GROUP BY e.id
""")
def docs_for_entities(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(F.concat(F.lit("doc:"), "doc_id").alias("id"), F.col("source").alias("path"), F.concat(F.lit("part:"), F.col("doc_id") % 500).alias("entity"))
    found = graph.documents_for(entities(spark, folder).where("type = 'File'"), docs.select(F.col("id").alias("doc"), "entity"), docs.select("id", "path"))
    lines = F.transform("documents", lambda d: F.concat(d["doc"], F.lit("@"), d["path"]))
    return found.select("id", F.size("documents").cast("long").alias("n"), F.array_join(lines, ",").alias("documents"))


@query(f"WITH {sql.GRAPH} SELECT DISTINCT e.id, e.label, e.type, e.ts FROM entity e JOIN both_ways b ON b.id = e.id WHERE b.relation = 'REVIEWED'")
def attributes_bulk(spark: SparkSession, folder: str) -> DataFrame:
    ids = graph.both_ways(relations(spark, folder).where("relation = 'REVIEWED'")).select("id").distinct()
    return entities(spark, folder).join(ids, "id", "left_semi").select("id", "label", "type", "ts")


@query(f"WITH {sql.ENTITY} SELECT e.id, e.label FROM entity e JOIN (SELECT DISTINCT lower(s_name) AS asked FROM supplier) s ON lower(e.label) = s.asked")
def label_lookup(spark: SparkSession, folder: str) -> DataFrame:
    asked = table(spark, folder, "supplier").select(F.lower("s_name").alias("asked")).distinct()
    return entities(spark, folder).withColumn("asked", F.lower("label")).join(asked, "asked", "left_semi").select("id", "label")
