"""Control-plane reads, with suppliers as pods, customers as organisations and orders as jobs and artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.text import eligible_source
from weftline.operators import control
from weftline.queries import query
from weftline.sources.graph import table


@query("""
    SELECT 'pod' || s_suppkey AS pod_id, count(c_custkey) AS n FROM supplier LEFT JOIN customer ON c_custkey % 7 = s_suppkey % 7 AND c_nationkey = s_nationkey
    WHERE s_suppkey % 4 <> 0 AND (s_suppkey % 3 = 0 OR 1000 - (900 + s_suppkey % 50) <= 90) GROUP BY s_suppkey
""")
def pod_placement(spark: SparkSession, folder: str) -> DataFrame:
    suppliers = table(spark, folder, "supplier")
    pods = suppliers.select(F.concat(F.lit("pod"), "s_suppkey").alias("pod_id"), F.when(F.col("s_suppkey") % 4 != 0, "ready").otherwise("lost").alias("status"), F.when(F.col("s_suppkey") % 3 != 0, 870 + F.col("s_suppkey") % 50).alias("last_heartbeat_at"))
    held = table(spark, folder, "customer").select(F.col("c_nationkey").alias("nation"), (F.col("c_custkey") % 7).alias("seven")).groupBy("nation", "seven").agg(F.count(F.lit(1)).alias("n"))
    owners = suppliers.select(F.concat(F.lit("pod"), "s_suppkey").alias("pod_id"), F.col("s_nationkey").alias("nation"), (F.col("s_suppkey") % 7).alias("seven"))
    return control.loads(pods, held.join(owners, ["nation", "seven"]), F.lit(1000))


@query("""
    WITH a AS (SELECT 'org' || (o_custkey % 100) AS org_id, 'pod' || (o_orderkey % 5) AS pod_id, CASE WHEN o_orderstatus = 'F' THEN 'ready' ELSE 'pulling' END AS load_status FROM orders),
    r AS (SELECT *, CASE WHEN pod_id = 'pod3' AND load_status = 'ready' THEN 0 WHEN pod_id = 'pod3' THEN 1 WHEN load_status = 'ready' THEN 2 ELSE 3 END AS rank FROM a)
    SELECT org_id, min(rank) AS rank, arg_min(pod_id, (rank, pod_id)) AS pod_id FROM r GROUP BY org_id
""")
def tenant_routing(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    rows = orders.select(F.concat(F.lit("org"), F.col("o_custkey") % 100).alias("org_id"), F.concat(F.lit("pod"), F.col("o_orderkey") % 5).alias("pod_id"), F.when(F.col("o_orderstatus") == "F", "ready").otherwise("pulling").alias("load_status"))
    return control.routing(rows, "pod3")


@query("""
    SELECT event_id AS job_id, event_type AS status FROM events
    WHERE event_type IN ('view', 'click') AND epoch(CASE WHEN event_id % 2 = 0 THEN ts ELSE ts - INTERVAL 1 HOUR END) < epoch(TIMESTAMP '2024-01-15') - 1800
""")
def abandoned_jobs(spark: SparkSession, folder: str) -> DataFrame:
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    jobs = table(spark, folder, "events").select(F.col("event_id").alias("job_id"), F.col("event_type").alias("status"), F.when(F.col("event_id") % 2 == 0, at).alias("started_at"), (at - 3600).alias("queued_at"))
    return control.abandoned(jobs, F.unix_seconds(F.lit("2024-01-15 00:00:00").cast("timestamp")), 1800, ["view", "click"]).select("job_id", "status")


@query("SELECT 'org' || o_custkey AS org_id, max(o_orderkey % 97) + 1 AS next_version FROM orders GROUP BY o_custkey")
def next_version(spark: SparkSession, folder: str) -> DataFrame:
    return control.next_versions(table(spark, folder, "orders").select(F.concat(F.lit("org"), "o_custkey").alias("org_id"), (F.col("o_orderkey") % 97).alias("version")))


@query("""
    WITH d AS (SELECT o_custkey, max(o_orderkey) AS desired, min(o_orderkey) AS loaded FROM orders GROUP BY o_custkey)
    SELECT 'org' || d.o_custkey AS org_id, 'pod' || (d.o_custkey % 3) AS pod_id, CASE WHEN d.o_custkey % 5 <> 0 THEN loaded END AS artifact_id, desired, o.o_orderpriority AS checksum
    FROM d JOIN orders o ON o.o_orderkey = d.desired WHERE o.o_orderstatus IN ('F', 'O') AND (CASE WHEN d.o_custkey % 5 <> 0 THEN loaded END) IS DISTINCT FROM desired
""")
def reconcile_diff(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    wanted = orders.groupBy("o_custkey").agg(F.max("o_orderkey").alias("desired"), F.min("o_orderkey").alias("loaded"))
    org = F.concat(F.lit("org"), "o_custkey").alias("org_id")
    assigned = wanted.select(org, F.concat(F.lit("pod"), F.col("o_custkey") % 3).alias("pod_id"), F.when(F.col("o_custkey") % 5 != 0, F.col("loaded")).alias("artifact_id"))
    state = F.when(F.col("o_orderstatus") == "F", "ready").when(F.col("o_orderstatus") == "O", "active").otherwise("building")
    artifacts = orders.select(F.col("o_orderkey").alias("artifact_id"), state.alias("status"), F.col("o_orderpriority").alias("checksum"))
    return control.to_swap(wanted.select(org, "desired"), assigned, artifacts)


@query("SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts::TIMESTAMP) AS window_start, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def rate_limit_window(spark: SparkSession, folder: str) -> DataFrame:
    return control.over_rate(table(spark, folder, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts")), 1, "1 hour")


@query(r"""
    WITH f AS (SELECT page_id, regexp_extract(url, '://[^/?#]*/([^?#]*)', 1) || CASE page_id % 4 WHEN 0 THEN '.py' WHEN 1 THEN '/build/a.py' WHEN 2 THEN '.MD' ELSE '.exe' END AS path, length(html) * (page_id % 40) AS size FROM pages)
    SELECT page_id, path FROM f WHERE page_id % 4 IN (0, 2) AND size > 0 AND size <= 131072 AND NOT starts_with(path, '/') AND NOT list_has_any(string_split(lower(path), '/'),
        ['.git', '.venv', 'venv', 'node_modules', 'vendor', 'dist', 'build', '__pycache__', '.next', 'coverage', '.ssh', 'secrets', 'credentials'])
        AND regexp_matches(regexp_extract(lower(path), '[^/]*$'), '.\.(py|md)$')
""")
def eligible_files(spark: SparkSession, folder: str) -> DataFrame:
    ending = F.element_at(F.array(*[F.lit(x) for x in (".py", "/build/a.py", ".MD", ".exe")]), (F.col("page_id") % 4 + 1).cast("int"))
    files = table(spark, folder, "pages").select("page_id", F.concat(F.regexp_extract("url", "://[^/?#]*/([^?#]*)", 1), ending).alias("path"), (F.length("html") * (F.col("page_id") % 40)).alias("size"))
    return files.where(eligible_source(F.col("path"), F.lit("blob"), F.lit("100644"), F.col("size"))).select("page_id", "path")
