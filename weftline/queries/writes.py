"""Upserts as folds over two versions of the tables, and the compiled snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.scoring import edge_price
from weftline.operators import control, folds
from weftline.plans import persist
from weftline.plans.build import build
from weftline.queries import query, sql
from weftline.sources import landing
from weftline.sources.graph import entities, relation_rows, relations, table
from weftline.sources.payloads import payloads
from weftline.sources.shared import tasks_for
from weftline.streaming import claims, debounce, ingest


def _versions(spark: SparkSession, folder: str) -> DataFrame:
    """Every order as an entity, twice: later rows (greater seq) rename it and bring a later time, or none."""
    orders = table(spark, folder, "orders")
    first = orders.select(F.concat(F.lit("ord:"), "o_orderkey").alias("id"), F.col("o_orderpriority").alias("label"), F.lit("PR").alias("type"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.lit(1).alias("seq"))
    later = orders.select(F.concat(F.lit("ord:"), "o_orderkey").alias("id"), F.col("o_orderstatus").alias("label"), F.lit("Ticket").alias("type"), F.when(F.col("o_orderkey") % 2 == 0, F.expr("CAST(o_orderdate AS TIMESTAMP) + INTERVAL 1 DAY")).alias("ts"), F.lit(2).alias("seq"))
    return first.unionByName(later)


@query("SELECT 'ord:' || o_orderkey AS id, o_orderpriority AS label, 'PR' AS type, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate::TIMESTAMP + INTERVAL 1 DAY ELSE o_orderdate::TIMESTAMP END AS ts FROM orders")
def upsert_entities(spark: SparkSession, folder: str) -> DataFrame:
    return folds.upsert_entities(_versions(spark, folder))


@query(f"""
    WITH {sql.ENTITY}, r AS (
        SELECT 'supp:' || l_suppkey AS src, 'part:' || l_partkey AS dst, CASE WHEN l_linenumber % 2 = 0 THEN 'REVIEWED' ELSE 'TOUCHES' END AS relation,
            CASE WHEN l_linenumber % 2 = 0 THEN 0.85::DOUBLE ELSE 0.8::DOUBLE END AS confidence FROM lineitem
        UNION ALL SELECT 'supp:none', 'part:' || p_partkey, 'TOUCHES', 0.99::DOUBLE FROM part)
    SELECT src, dst, arg_max(relation, confidence) AS relation, max(confidence) AS confidence FROM r WHERE src IN (SELECT id FROM entity) AND dst IN (SELECT id FROM entity) GROUP BY src, dst
""")
def upsert_edges(spark: SparkSession, folder: str) -> DataFrame:
    even = F.col("l_linenumber") % 2 == 0
    lines = table(spark, folder, "lineitem").select(
        F.concat(F.lit("supp:"), "l_suppkey").alias("src"), F.concat(F.lit("part:"), "l_partkey").alias("dst"), F.when(even, "REVIEWED").otherwise("TOUCHES").alias("relation"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
    )
    lost = table(spark, folder, "part").select(F.lit("supp:none").alias("src"), F.concat(F.lit("part:"), "p_partkey").alias("dst"), F.lit("TOUCHES").alias("relation"), F.lit(0).cast("long").alias("seq"))
    rows = lines.withColumn("confidence", edge_price(F.col("relation"), F.lit(None).cast("double"))).unionByName(lost.withColumn("confidence", F.lit(0.99)))
    return folds.upsert_relations(rows, entities(spark, folder))


@query("""
    SELECT 'src:' || source AS id, arg_max(lang, doc_id) AS path, md5(arg_max(text, doc_id)) AS digest FROM documents GROUP BY source
""")
def upsert_documents(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select(F.concat(F.lit("src:"), "source").alias("id"), F.col("lang").alias("path"), F.md5(F.col("text").cast("binary")).alias("content"), F.col("doc_id").alias("seq"))
    return folds.upsert_documents(rows).withColumnRenamed("content", "digest")


@query(f"""
    WITH {sql.ENTITY} SELECT DISTINCT 'doc:' || doc_id AS doc, 'part:' || (doc_id % 3000) AS entity FROM documents WHERE 'part:' || (doc_id % 3000) IN (SELECT id FROM entity)
""")
def add_mentions(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(F.concat(F.lit("doc:"), "doc_id").alias("doc"), F.concat(F.lit("part:"), F.col("doc_id") % 3000).alias("entity"))
    return folds.add_mentions(docs.unionAll(docs), docs.select(F.col("doc").alias("id")), entities(spark, folder))


@query("""
    SELECT 'org' || (p_partkey % 5) AS org_id, 'part:' || p_partkey AS node_id, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE p_name END AS name,
        CASE WHEN p_partkey % 2 = 0 OR p_partkey % 3 <> 0 THEN 100 ELSE 200 END AS created_at
    FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0
""")
def tenant_upsert(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "part").select(F.concat(F.lit("org"), F.col("p_partkey") % 5).alias("org_id"), F.concat(F.lit("part:"), "p_partkey").alias("node_id"), "p_partkey", "p_name", "p_brand")
    old = rows.where("p_partkey % 2 = 0").select("org_id", "node_id", F.col("p_name").alias("name"), F.lit(100).alias("created_at"))
    new = rows.where("p_partkey % 3 = 0").select("org_id", "node_id", F.col("p_brand").alias("name"), F.lit(200).alias("created_at"))
    return folds.overwrite_nodes(old, new)


def _tenant_edges(spark: SparkSession, folder: str, status: str) -> DataFrame:
    orders = table(spark, folder, "orders").where(status)
    return orders.select(F.lit("org").alias("org_id"), F.concat(F.lit("cust:"), "o_custkey").alias("source_id"), F.concat(F.lit("ord:"), "o_orderkey").alias("target_id"), F.when(F.col("o_orderkey") % 3 == 0, "MENTIONS").otherwise("AUTHORED").alias("relation_type"), F.col("o_totalprice").alias("weight"))


@query("""
    SELECT 'org' AS org_id, 'cust:' || o_custkey AS source_id, 'ord:' || o_orderkey AS target_id, CASE WHEN o_orderkey % 3 = 0 THEN 'MENTIONS' ELSE 'AUTHORED' END AS relation_type,
        round(CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice * 2 ELSE o_totalprice END, 4) AS weight FROM orders
""")
def tenant_upsert_edges(spark: SparkSession, folder: str) -> DataFrame:
    new = _tenant_edges(spark, folder, "o_orderkey % 4 = 0").withColumn("weight", F.col("weight") * 2)
    return folds.overwrite_edges(_tenant_edges(spark, folder, "true"), new).withColumn("weight", F.round("weight", 4))


@query("""
    SELECT 'cust:' || o_custkey AS source_id, 'ord:' || o_orderkey AS target_id FROM orders WHERE NOT (o_orderkey % 3 = 0 AND o_custkey % 2 = 0)
""")
def text_edge_rewrite(spark: SparkSession, folder: str) -> DataFrame:
    again = table(spark, folder, "customer").where("c_custkey % 2 = 0").select(F.concat(F.lit("cust:"), "c_custkey").alias("node_id"))
    return folds.drop_text_edges(_tenant_edges(spark, folder, "true"), again).select("source_id", "target_id")


@query("""
    WITH n AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'entity:part:' ELSE 'part:' END || p_partkey AS node_id FROM part),
    t AS (SELECT DISTINCT 'entity:part:' || l_partkey AS node_id FROM lineitem WHERE l_linenumber = 7)
    SELECT 'org' AS org_id, node_id FROM n WHERE NOT starts_with(node_id, 'entity:') OR node_id IN (SELECT node_id FROM t)
""")
def orphan_removal(spark: SparkSession, folder: str) -> DataFrame:
    nodes = table(spark, folder, "part").select(F.lit("org").alias("org_id"), F.concat(F.when(F.col("p_partkey") % 2 == 0, "entity:part:").otherwise("part:"), "p_partkey").alias("node_id"))
    edges = table(spark, folder, "lineitem").where("l_linenumber = 7").select(F.lit("org").alias("org_id"), F.concat(F.lit("entity:part:"), "l_partkey").alias("target_id"))
    return folds.drop_orphans(nodes, edges)


@query("SELECT 'cust:' || o_custkey AS id, arg_min(o_orderpriority, o_orderkey) AS label, arg_min(o_orderstatus, o_orderkey) AS type FROM orders GROUP BY o_custkey")
def first_wins_nodes(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").select(F.concat(F.lit("cust:"), "o_custkey").alias("id"), F.col("o_orderpriority").alias("label"), F.col("o_orderstatus").alias("type"), F.col("o_orderkey").alias("seq"))
    return folds.first_nodes(rows, "label", "type")


@query(f"""
    WITH {sql.EDGES} SELECT src, dst, arg_max(relation, (confidence, relation)) AS relation, round(max(confidence), 6) AS confidence
    FROM (SELECT src, dst, relation, confidence * CASE WHEN relation = 'TOUCHES' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS confidence FROM edges) GROUP BY src, dst
""")
def compile_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    weight = F.when(F.col("relation") == "TOUCHES", 0.5)
    priced = relations(spark, folder).select("src", "dst", "relation", edge_price(F.col("relation"), weight).alias("confidence"))
    priced = priced.repartition(tasks_for(spark, relation_rows(spark, folder)), "src", "dst")  # sorted once, where pairs meet
    best = priced.groupBy("src", "dst").agg(F.max(F.struct("confidence", "relation")).alias("b"))
    return best.select("src", "dst", "b.relation", F.round("b.confidence", 6).alias("confidence"))


@query("""
    SELECT o_orderkey AS number, o_orderdate::TIMESTAMP AS updated_at FROM orders
    WHERE o_orderkey % 50 = 0 OR o_orderdate > (SELECT max(o_orderdate) FROM orders WHERE o_orderkey % 100 = 7)
""")
def delta_cursor(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("at"))
    cursor = orders.where("o_orderkey % 100 = 7").agg(F.max("at")).first()[0]
    rows = orders.select(F.col("o_orderkey").alias("number"), F.when(F.col("o_orderkey") % 50 != 0, F.col("at")).alias("updated_at"), "at")
    return control.delta(rows, F.lit(cursor)).select("number", F.col("at").alias("updated_at"))


@query("""
    SELECT o_custkey, o_orderkey AS number, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC)::INTEGER AS seq FROM orders
""")
def ingest_order(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").select("o_custkey", F.col("o_orderdate").alias("updated_at"), F.col("o_orderkey").alias("number"), F.lit("").alias("sha"))
    return control.ingest_order(rows, "o_custkey").select("o_custkey", "number", "seq")


_HOUR = 3_600_000_000
_BURSTS = f"""
    WITH RECURSIVE e AS (SELECT user_id AS key, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    s AS (
        SELECT key, k, t AS first, t AS last, 1::BIGINT AS n FROM e WHERE k = 1
        UNION ALL SELECT e.key, e.k, CASE WHEN e.t < least(s.last + {6 * _HOUR}, s.first + {24 * _HOUR}) THEN s.first ELSE e.t END, e.t,
            CASE WHEN e.t < least(s.last + {6 * _HOUR}, s.first + {24 * _HOUR}) THEN s.n + 1 ELSE 1 END FROM s JOIN e ON e.key = s.key AND e.k = s.k + 1
    ) SELECT key, first, max(last) AS last, least(max(last) + {6 * _HOUR}, first + {24 * _HOUR}) AS deadline, max(n) AS n FROM s GROUP BY key, first
"""


@query(_BURSTS)
def debounce_batch(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select(F.col("user_id").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return debounce.bursts(rows, 6 * _HOUR, 24 * _HOUR)


def _stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table's files as a stream, whether the table is one file or a folder of them."""
    schema = table(spark, folder, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{name}.parque[t]")


@query(f"""
    WITH b AS ({_BURSTS}) SELECT * FROM b WHERE deadline <= (SELECT max(epoch_us(ts)) // 1000 * 1000 - 600000000 FROM events)
""")
def claimed_bursts(spark: SparkSession, folder: str) -> DataFrame:
    """The bursts whose deadline the watermark has passed, each given out once by its timer."""
    rows = _stream(spark, folder, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    return claims.claim_to_end(rows, ingest.new_folder(spark, "claims"), 6 * _HOUR, 24 * _HOUR)


@query(_BURSTS)
def debounce_stream(spark: SparkSession, folder: str) -> DataFrame:
    rows = _stream(spark, folder, "events").select(F.col("user_id").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))

    def latest(last: DataFrame | None, batch: DataFrame) -> DataFrame:
        both = batch if last is None else last.unionByName(batch)
        return both.groupBy("key", "first").agg(F.max("last").alias("last"), F.max("deadline").alias("deadline"), F.max("n").alias("n"))

    return ingest.run_to_end(debounce.burst_stream(rows, 6 * _HOUR, 24 * _HOUR), ingest.new_folder(spark, "debounce"), ["key", "first"], latest, "update")


@query("SELECT 'user:' || user_id AS id, arg_min(event_type, event_id) AS label, 'Person' AS type, max(ts)::TIMESTAMP AS ts FROM events GROUP BY user_id")
def incremental_ingest_stream(spark: SparkSession, folder: str) -> DataFrame:
    rows = _stream(spark, folder, "events").select(F.concat(F.lit("user:"), "user_id").alias("id"), F.col("event_type").alias("label"), F.lit("Person").alias("type"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"))

    def fold(last: DataFrame | None, batch: DataFrame) -> DataFrame:
        both = batch if last is None else last.withColumn("seq", F.lit(-1).cast("long")).unionByName(batch)
        return folds.upsert_entities(both)

    return ingest.run_to_end(rows, ingest.new_folder(spark, "ingest"), ["id"], fold)


_BUILT = """
    p AS (SELECT *, 'pr:' || doc_id AS id, 'person:u' || (doc_id % 50) AS who FROM documents WHERE doc_id % 3 = 0), i AS (SELECT *, 'ticket:' || doc_id AS id, 'person:u' || (doc_id % 50) AS who FROM documents WHERE doc_id % 3 = 1),
    c AS (SELECT *, 'commit:c' || doc_id AS id FROM documents WHERE doc_id % 3 = 2), r AS (SELECT doc_id - doc_id % 3 AS pr, 'person:u' || (doc_id % 50) AS who FROM documents WHERE doc_id % 3 < 2),
    f AS (SELECT doc_id - doc_id % 3 + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS pr, 'file:' || source || '/f' || (doc_id % 20) || '.py' AS file FROM documents WHERE doc_id % 3 <> 1),
    said AS (SELECT id AS src, doc_id + 1 AS n FROM p UNION ALL SELECT id, doc_id + 300000000 FROM p UNION ALL SELECT id, doc_id - 1 FROM c UNION ALL SELECT id, doc_id - 2 FROM c),
    named AS (SELECT doc_id AS n, id AS dst FROM i UNION ALL SELECT doc_id, id FROM p)
"""


@query(f"""
    WITH {_BUILT} SELECT DISTINCT * FROM (
        SELECT who AS src, id AS dst, 'AUTHORED' AS relation, 0.95::DOUBLE AS confidence FROM p UNION ALL SELECT who, id, 'REPORTED', 0.75 FROM i
        UNION ALL SELECT 'person:u' || (doc_id % 50), id, 'AUTHORED', 0.95 FROM c WHERE doc_id % 2 = 0 UNION ALL SELECT id, 'repo:acme/tools', 'PART_OF', 0.80 FROM (SELECT id FROM p UNION ALL SELECT id FROM i UNION ALL SELECT id FROM c)
        UNION ALL SELECT r.who, p.id, 'REVIEWED', 0.85 FROM r JOIN p ON p.doc_id = r.pr WHERE r.who <> p.who UNION ALL SELECT p.id, f.file, 'TOUCHES', 0.80 FROM f JOIN p ON p.doc_id = f.pr
        UNION ALL SELECT src, dst, 'RESOLVES', 0.92 FROM said JOIN named USING (n) WHERE src <> dst)
""")
def graph_build(spark: SparkSession, folder: str) -> DataFrame:
    made = payloads(spark, folder)
    return build(*[made[k] for k in ("repository", "pull_requests", "issues", "commits", "reviews", "files")])["relates_to"].select("src", "dst", "relation", "confidence")


@query(f"""
    WITH {_BUILT} SELECT type, count(*) AS n, count(DISTINCT id) AS ids FROM (
        SELECT 'Repo' AS type, 'repo:acme/tools' AS id UNION ALL SELECT 'PR', id FROM p UNION ALL SELECT 'Ticket', id FROM i UNION ALL SELECT 'Commit', id FROM c
        UNION ALL SELECT DISTINCT 'Person', who FROM (SELECT who FROM p UNION ALL SELECT who FROM i UNION ALL SELECT who FROM r UNION ALL SELECT 'person:u' || (doc_id % 50) FROM c WHERE doc_id % 2 = 0)
        UNION ALL SELECT DISTINCT 'File', file FROM f) GROUP BY type
""")
def graph_build_nodes(spark: SparkSession, folder: str) -> DataFrame:
    made = payloads(spark, folder)
    nodes = build(*[made[k] for k in ("repository", "pull_requests", "issues", "commits", "reviews", "files")])["entity"]
    return nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"))


@query(f"""
    WITH {_BUILT}, w AS (SELECT who FROM p UNION SELECT who FROM i UNION SELECT who FROM r UNION SELECT 'person:u' || (doc_id % 50) FROM c WHERE doc_id % 2 = 0),
    e AS (
        SELECT who AS src, id AS dst, 'AUTHORED' AS relation FROM p UNION ALL SELECT who, id, 'REPORTED' FROM i UNION ALL SELECT 'person:u' || (doc_id % 50), id, 'AUTHORED' FROM c WHERE doc_id % 2 = 0
        UNION ALL SELECT id, 'repo:acme/tools', 'PART_OF' FROM (SELECT id FROM p UNION ALL SELECT id FROM i UNION ALL SELECT id FROM c) UNION ALL SELECT r.who, p.id, 'REVIEWED' FROM r JOIN p ON p.doc_id = r.pr WHERE r.who <> p.who
        UNION ALL SELECT p.id, f.file, 'TOUCHES' FROM f JOIN p ON p.doc_id = f.pr UNION ALL SELECT src, dst, 'RESOLVES' FROM said JOIN named USING (n) WHERE src <> dst
    )
    SELECT 'pull_requests' AS stage, 'rows' AS counter, count(*) AS n FROM p UNION ALL SELECT 'issues', 'rows', count(*) FROM i UNION ALL SELECT 'commits', 'rows', count(*) FROM c
    UNION ALL SELECT 'commits', 'without_author', count(*) FROM c WHERE doc_id % 2 <> 0 UNION ALL SELECT 'reviews', 'rows', count(*) FROM r
    UNION ALL SELECT 'reviews', 'orphans', count(*) FROM r WHERE pr NOT IN (SELECT doc_id FROM p) UNION ALL SELECT 'reviews', 'self_reviews', count(*) FROM r JOIN p ON p.doc_id = r.pr WHERE r.who = p.who
    UNION ALL SELECT 'changed_files', 'rows', count(*) FROM f UNION ALL SELECT 'changed_files', 'orphans', count(*) FROM f WHERE pr NOT IN (SELECT doc_id FROM p)
    UNION ALL SELECT 'edge_rows', 'rows', count(*) FROM e UNION ALL SELECT 'edges', 'rows', count(*) FROM (SELECT DISTINCT * FROM e)
    UNION ALL SELECT 'written_unresolved', 'rows', count(*) FROM said WHERE n NOT IN (SELECT n FROM named)
    UNION ALL SELECT 'nodes', 'rows', 1 + (SELECT count(DISTINCT id) FROM (SELECT id FROM p UNION ALL SELECT id FROM i UNION ALL SELECT id FROM c)) + (SELECT count(*) FROM w) + (SELECT count(DISTINCT file) FROM f)
""")
def build_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """What was counted while a graph was built and written."""
    counted = persist.build_and_write(payloads(spark, folder), ingest.new_folder(spark, "graph"))
    shown = ("pull_requests", "issues", "commits", "reviews", "changed_files", "edge_rows", "edges", "nodes", "written_unresolved")
    return spark.createDataFrame([(stage, k, int(v)) for stage in shown for k, v in counted[stage].items()], "stage string, counter string, n long")


@query(f"WITH {_BUILT} SELECT src, n FROM said WHERE n NOT IN (SELECT n FROM named)")
def unresolved_references(spark: SparkSession, folder: str) -> DataFrame:
    made = payloads(spark, folder)
    return build(*[made[k] for k in ("repository", "pull_requests", "issues", "commits", "reviews", "files")])["unresolved"].select("src", "n")


@query("""
    WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'PullRequest' ELSE 'Issue' END AS kind, doc_id % 3 = 0 AS merged FROM documents WHERE doc_id % 3 < 2)
    SELECT kind, doc_id::INTEGER AS number, 'u' || (doc_id % 50) AS author, merged, make_timestamp((1704067200 + 2 * doc_id) * 1000000) AS updated_at FROM d
""")
def delta_items(spark: SparkSession, folder: str) -> DataFrame:
    made = payloads(spark, folder)
    changes = made["pull_requests"].withColumns({"merged_at": F.col("updated_at"), "merge_commit_sha": F.lit(None).cast("string")})
    return landing.delta_items(changes, made["issues"]).select("kind", "number", "author", "merged", "updated_at")
