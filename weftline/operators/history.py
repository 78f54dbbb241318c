"""Sessions, recorded runs and what a viewer derives from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sessions_of(sessions: DataFrame, user: Column) -> DataFrame:
    """A user's sessions with their place, newest first."""
    own = sessions.where(F.col("user_id") == user)
    return own.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("created_at"), "session_id")))


def recorded(runs: DataFrame) -> DataFrame:
    """runs: run, seq, query, answer. Of each run the first query, the last answer and the number of steps."""
    return runs.groupBy("run").agg(
        F.min_by("query", F.when(F.col("query").isNotNull(), F.col("seq"))).alias("query"), F.max_by("answer", F.when(F.col("answer").isNotNull(), F.col("seq"))).alias("answer"),
        F.count(F.lit(1)).alias("steps"),
    )


def paired_spans(starts: DataFrame, ends: DataFrame) -> DataFrame:
    """Spans of start and end events (run, id, ms): an end without a start has no length, a start without an end stays open."""
    both = starts.select("run", "id", F.col("ms").alias("start_ms")).join(ends.select("run", "id", F.col("ms").alias("end_ms")), ["run", "id"], "full_outer")
    status = F.when(F.col("end_ms").isNull(), "open").when(F.col("start_ms").isNull(), "unmatched").otherwise("ok")
    return both.select("run", "id", F.coalesce("start_ms", "end_ms").alias("start_ms"), "end_ms", status.alias("status"))


def recent(queries: DataFrame, keep: int = 6) -> DataFrame:
    """queries: user_id, query, at. The last distinct queries of each user."""
    last = queries.groupBy("user_id", "query").agg(F.max("at").alias("at"))
    return last.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("at"), "query"))).where(F.col("place") <= keep)


def derived_confidence(hops: DataFrame, key: str) -> DataFrame:
    """hops: key, confidence. The mean of a run's hops, with half their range, within 0.02 and 0.2, as the band.

    Summed as decimals of 9 places, so that the mean does not depend on the order of rows.
    """
    band = F.greatest(F.lit(0.02), F.least(F.lit(0.2), (F.max("confidence") - F.min("confidence")) / 2))
    total = F.sum(F.col("confidence").cast("decimal(18,9)"))
    return hops.groupBy(key).agg((total.cast("double") / F.count("confidence")).alias("confidence"), band.alias("band"))


def connections(edges: DataFrame) -> DataFrame:
    """Drawn edge ends of each node: an edge counts at both."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


def uncovered(hops: DataFrame, edges: DataFrame) -> DataFrame:
    """Hops (src, dst) that no edge joins in either direction."""
    pair = lambda rows: rows.select(F.array_sort(F.array("src", "dst")).alias("pair"))
    return pair(hops).distinct().join(pair(edges).distinct(), "pair", "left_anti").select(F.col("pair")[0].alias("a"), F.col("pair")[1].alias("b"))


def chunk_lists(mentions: DataFrame) -> DataFrame:
    """Of each entity its distinct chunks in order, and how many."""
    lists = F.array_sort(F.collect_set("doc"))
    return mentions.groupBy("entity").agg(lists.alias("chunks")).withColumn("n", F.size("chunks"))


def document_ids(documents: DataFrame) -> DataFrame:
    """id: the given one, else one made from the content."""
    return documents.withColumn("id", F.coalesce("id", F.concat(F.lit("doc_"), F.substring(F.sha1(F.col("content").cast("binary")), 1, 10))))


def changes_to_follow(events: DataFrame) -> DataFrame:
    """Webhook deliveries (kind, payload as JSON) that ask for a rebuild: pushes, and changes that were closed by merging."""
    body = F.from_json("payload", "action string, merged boolean, repository struct<full_name:string>")
    rows = events.withColumn("body", body).where("body.repository.full_name is not null")
    return rows.where("kind = 'push' OR kind = 'pull_request' AND body.action = 'closed' AND body.merged").select("*", F.col("body.repository.full_name").alias("repository")).drop("body")


def migrated(old: DataFrame, schema: DataFrame) -> DataFrame:
    """The old table with the columns it lacks as nulls."""
    return old.unionByName(schema.limit(0), allowMissingColumns=True)
