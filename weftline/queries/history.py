"""Recorded runs, sessions and viewer derivations over conversations, events and the graph view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import history
from weftline.queries import query, sql
from weftline.sources.graph import relations, table


@query("SELECT conv_id AS run, md5(arg_min(text, turn) FILTER (role = 'user')) AS query, md5(arg_max(text, turn) FILTER (role = 'assistant')) AS answer, count(*) AS steps FROM conversations GROUP BY conv_id")
def recorded_runs(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations")
    said = F.md5(F.col("text").cast("binary"))
    return history.recorded(turns.select(F.col("conv_id").alias("run"), F.col("turn").alias("seq"), F.when(F.col("role") == "user", said).alias("query"), F.when(F.col("role") == "assistant", said).alias("answer")))


@query("SELECT user_id, event_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id)::INTEGER AS place FROM events WHERE event_type = 'signup' AND user_id = user_id")
def session_list(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").where("event_type = 'signup'").select("user_id", F.col("event_id").alias("session_id"), F.col("ts").alias("created_at"))
    return history.sessions_of(rows, F.col("user_id")).select("user_id", "session_id", "place")


@query("SELECT user_id, query, place::INTEGER AS place FROM (SELECT user_id, event_type AS query, row_number() OVER (PARTITION BY user_id ORDER BY max(ts) DESC, event_type) AS place FROM events GROUP BY user_id, event_type) WHERE place <= 3")
def recent_queries(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select("user_id", F.col("event_type").alias("query"), F.col("ts").alias("at"))
    return history.recent(rows, 3).select("user_id", "query", "place")


@query("""
    WITH s AS (SELECT user_id AS run, event_id // 2 AS id, epoch_us(ts) AS ms FROM events WHERE event_type IN ('view', 'click') AND event_id % 2 = 0),
    e AS (SELECT user_id AS run, event_id // 2 AS id, epoch_us(ts) AS ms FROM events WHERE event_type IN ('view', 'click', 'error') AND event_id % 2 = 1)
    SELECT run, id, coalesce(s.ms, e.ms) AS start_ms, e.ms AS end_ms, CASE WHEN e.ms IS NULL THEN 'open' WHEN s.ms IS NULL THEN 'unmatched' ELSE 'ok' END AS status
    FROM s FULL JOIN e USING (run, id)
""")
def span_pairing(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select(F.col("user_id").alias("run"), F.floor(F.col("event_id") / 2).alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ms"), "event_type", "event_id")
    return history.paired_spans(events.where("event_type IN ('view', 'click') AND event_id % 2 = 0"), events.where("event_type IN ('view', 'click', 'error') AND event_id % 2 = 1"))


@query(f"WITH {sql.EDGES} SELECT origin, round(sum(confidence::DECIMAL(18,9))::DOUBLE / count(*), 6) AS confidence, round(greatest(0.02, least(0.2, (max(confidence) - min(confidence)) / 2)), 6) AS band FROM both_ways GROUP BY origin")
def derived_confidence(spark: SparkSession, folder: str) -> DataFrame:
    from weftline.operators.graph import both_ways

    rows = history.derived_confidence(both_ways(relations(spark, folder)), "origin")
    return rows.select("origin", F.round("confidence", 6).alias("confidence"), F.round("band", 6).alias("band"))


@query(f"WITH {sql.EDGES} SELECT id, count(*) AS n FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id")
def connection_counts(spark: SparkSession, folder: str) -> DataFrame:
    return history.connections(relations(spark, folder))


@query("""
    WITH h AS (SELECT DISTINCT least('ord:' || o_orderkey, 'cust:' || (o_custkey + o_orderkey % 2)) AS a, greatest('ord:' || o_orderkey, 'cust:' || (o_custkey + o_orderkey % 2)) AS b FROM orders)
    SELECT a, b FROM h WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE least('ord:' || o.o_orderkey, 'cust:' || o.o_custkey) = h.a AND greatest('ord:' || o.o_orderkey, 'cust:' || o.o_custkey) = h.b)
""")
def uncovered_hops(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    hops = orders.select(F.concat(F.lit("ord:"), "o_orderkey").alias("src"), F.concat(F.lit("cust:"), F.col("o_custkey") + F.col("o_orderkey") % 2).alias("dst"))
    return history.uncovered(hops, orders.select(F.concat(F.lit("cust:"), "o_custkey").alias("src"), F.concat(F.lit("ord:"), "o_orderkey").alias("dst")))


@query("SELECT 'part:' || l_partkey AS entity, count(DISTINCT l_orderkey) AS n, string_agg(DISTINCT 'ord:' || l_orderkey, ',' ORDER BY 'ord:' || l_orderkey) AS chunks FROM lineitem GROUP BY l_partkey")
def chunk_table(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select(F.concat(F.lit("part:"), "l_partkey").alias("entity"), F.concat(F.lit("ord:"), "l_orderkey").alias("doc"))
    return history.chunk_lists(rows).select("entity", F.col("n").cast("long").alias("n"), F.array_join("chunks", ",").alias("chunks"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'doc:' || doc_id ELSE 'doc_' || substr(sha1(text), 1, 10) END AS id FROM documents")
def content_ids(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("doc:"), "doc_id")).alias("id"), F.col("text").alias("content"))
    return history.document_ids(docs).select("doc_id", "id")


@query("SELECT event_id, 'acme/' || user_id AS repository FROM events WHERE (event_type = 'view' OR event_type = 'click' AND user_id % 2 = 0) AND event_id % 5 <> 0")
def webhook_filter(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "push").when(F.col("event_type") == "click", "pull_request").otherwise("star")
    named = F.when(F.col("event_id") % 5 != 0, F.struct(F.concat(F.lit("acme/"), "user_id").alias("full_name")))
    payload = F.to_json(F.struct(F.lit("closed").alias("action"), (F.col("user_id") % 2 == 0).alias("merged"), named.alias("repository")))
    return history.changes_to_follow(table(spark, folder, "events").select("event_id", kind.alias("kind"), payload.alias("payload"))).select("event_id", "repository")


@query("SELECT s_suppkey, s_name, NULL::DOUBLE AS score FROM supplier")
def schema_migration(spark: SparkSession, folder: str) -> DataFrame:
    suppliers = table(spark, folder, "supplier")
    return history.migrated(suppliers.select("s_suppkey", "s_name"), suppliers.select("s_suppkey", F.lit(0.0).alias("score")))
