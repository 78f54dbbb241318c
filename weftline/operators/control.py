"""Reads of the control plane: placement, routing, jobs, versions, reconciliation, rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.options import DEFAULTS


def fresh(heartbeat: Column, now: Column, limit: int = DEFAULTS.heartbeat_s) -> Column:
    return heartbeat.isNull() | (now - heartbeat <= limit)


def loads(pods: DataFrame, assignments: DataFrame, now: Column) -> DataFrame:
    """Ready and fresh pods with the number of their assignments (a row each, or ``n`` of them), the least loaded first."""
    counts = assignments.groupBy("pod_id").agg(F.sum("n" if "n" in assignments.columns else F.lit(1)).alias("n"))
    healthy = pods.where((F.col("status") == "ready") & fresh(F.col("last_heartbeat_at"), now))
    return healthy.join(counts, "pod_id", "left").select("pod_id", F.coalesce("n", F.lit(0)).alias("n")).orderBy("n", "pod_id")


def routing(assignments: DataFrame, pod: str) -> DataFrame:
    """Of each organisation the assignment that answers for it: mine ready, mine, ready elsewhere, any."""
    mine, ready = F.col("pod_id") == pod, F.col("load_status") == "ready"
    rank = F.when(mine & ready, 0).when(mine, 1).when(ready, 2).otherwise(3)
    best = F.min(F.struct(rank.alias("rank"), "pod_id")).alias("best")
    return assignments.groupBy("org_id").agg(best).select("org_id", F.col("best.rank").alias("rank"), F.col("best.pod_id").alias("pod_id"))


def abandoned(jobs: DataFrame, now: Column, ttl: int, held: list[str]) -> DataFrame:
    return jobs.where(F.col("status").isin(held) & (F.coalesce("started_at", "queued_at") < now - ttl))


def next_versions(artifacts: DataFrame) -> DataFrame:
    return artifacts.groupBy("org_id").agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("next_version"))


def to_swap(organisations: DataFrame, assignments: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Assignments whose organisation wants another artifact that may be served."""
    servable = artifacts.where(F.col("status").isin("ready", "active") & F.col("checksum").isNotNull()).select(F.col("artifact_id").alias("desired"), "checksum")
    return assignments.join(organisations, "org_id").where(~F.col("artifact_id").eqNullSafe(F.col("desired"))).join(servable, "desired").select("org_id", "pod_id", "artifact_id", "desired", "checksum")


def over_rate(events: DataFrame, limit: int, width: str = "1 minute") -> DataFrame:
    """events: user_id, ts. Fixed windows in which a user asked more than the limit."""
    rows = events.groupBy("user_id", F.window("ts", width).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return rows.where(F.col("n") > limit).select("user_id", F.col("w.start").alias("window_start"), "n")


def delta(rows: DataFrame, cursor: Column) -> DataFrame:
    """Rows changed after the cursor; those without a time pass."""
    return rows.where(F.col("updated_at").isNull() | cursor.isNull() | (F.col("updated_at") > cursor))


def next_cursors(rows: DataFrame, previous: DataFrame, key: str) -> DataFrame:
    """Of each key the latest known change, else its previous cursor (key, cursor)."""
    latest = rows.groupBy(key).agg(F.max("updated_at").alias("latest"))
    return latest.join(previous, key, "full_outer").select(key, F.coalesce("latest", "cursor").alias("cursor"))


def late(rows: DataFrame, cursor: Column) -> DataFrame:
    """Rows changed at the cursor or before it, which a scan from the cursor does not see again."""
    return rows.where(F.col("updated_at") <= cursor)


def ingest_order(rows: DataFrame, partition: str) -> DataFrame:
    """``seq`` within each partition: newest first, unknown times last, ties by number and sha, all descending."""
    order = Window.partitionBy(partition).orderBy(F.desc_nulls_last("updated_at"), F.desc("number"), F.desc("sha"))
    return rows.withColumn("seq", F.row_number().over(order))
