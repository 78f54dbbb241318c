"""The relational tables seen as an evidence graph: entity(id, label, type, ts), relates_to(src, dst, relation, confidence, ts)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.scoring import edge_price
from weftline.sources.shared import tasks_for


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _id(prefix: str, column: str):
    return F.concat(F.lit(f"{prefix}:"), F.col(column).cast("string"))


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """The lines dealt by order over tasks that follow their number, so that what is made of them in a task does not grow with the table."""
    lines = table(spark, folder, "lineitem")
    return lines.repartition(tasks_for(spark, 3 * lines.count()), "l_orderkey")


def entities(spark: SparkSession, folder: str) -> DataFrame:
    no_time = F.lit(None).cast("timestamp")

    def rows(name, prefix, key, label, kind, ts=no_time):
        return table(spark, folder, name).select(_id(prefix, key).alias("id"), label.alias("label"), F.lit(kind).alias("type"), ts.alias("ts"))

    orders = rows("orders", "ord", "o_orderkey", F.concat(F.lit("order "), F.col("o_orderkey")), "PR", F.col("o_orderdate").cast("timestamp"))
    events = table(spark, folder, "events").where("event_type = 'error'")
    tickets = events.select(_id("ev", "event_id").alias("id"), F.concat(F.lit("error "), F.col("event_id")).alias("label"), F.lit("Ticket").alias("type"), F.col("ts").cast("timestamp").alias("ts"))
    parts = [
        rows("customer", "cust", "c_custkey", F.col("c_name"), "Person"), orders, rows("part", "part", "p_partkey", F.col("p_name"), "File"),
        rows("supplier", "supp", "s_suppkey", F.col("s_name"), "Service"), rows("nation", "nation", "n_nationkey", F.col("n_name"), "Repo"), tickets,
    ]
    return reduce(DataFrame.unionAll, parts)


def relations(spark: SparkSession, folder: str) -> DataFrame:
    """One row per (src, dst, relation). Each relation is derived on its own, so that only its two key columns are read."""
    lines = _lines(spark, folder)

    def rows(frame, src, dst, relation):
        return frame.select(src.alias("src"), dst.alias("dst"), F.lit(relation).alias("relation"))

    parts = [
        rows(table(spark, folder, "orders"), _id("cust", "o_custkey"), _id("ord", "o_orderkey"), "AUTHORED"),
        rows(lines.select("l_orderkey", "l_partkey").distinct(), _id("ord", "l_orderkey"), _id("part", "l_partkey"), "TOUCHES"),
        rows(lines.select("l_suppkey", "l_orderkey").distinct(), _id("supp", "l_suppkey"), _id("ord", "l_orderkey"), "REVIEWED"),
        rows(table(spark, folder, "customer"), _id("cust", "c_custkey"), _id("nation", "c_nationkey"), "PART_OF"),
        rows(table(spark, folder, "supplier"), _id("supp", "s_suppkey"), _id("nation", "s_nationkey"), "PART_OF"),
        rows(table(spark, folder, "events").where("event_type = 'error'"), _id("cust", "user_id"), _id("ev", "event_id"), "REPORTED"),
    ]
    return reduce(DataFrame.unionAll, parts).withColumn("confidence", edge_price(F.col("relation"), F.lit(None).cast("double")))


#: Of each relation the kinds of its ends.
ENDS = (("AUTHORED", "cust", "ord"), ("TOUCHES", "ord", "part"), ("REVIEWED", "supp", "ord"), ("PART_OF", "cust", "nation"), ("PART_OF", "supp", "nation"), ("REPORTED", "cust", "ev"))
#: The same from either end: relation, the origin's kind, the neighbour's.
WAYS = tuple(way for relation, a, b in ENDS for way in ((relation, a, b), (relation, b, a)))


def relation_rows(spark: SparkSession, folder: str) -> int:
    """As many relations as there are at most; files know the lengths of tables."""
    return sum(n * table(spark, folder, name).count() for name, n in (("orders", 1), ("lineitem", 2), ("customer", 1), ("supplier", 1), ("events", 1)))


def numbered_ends(spark: SparkSession, folder: str) -> DataFrame:
    """way, kind, origin_key, key and ts: ``relations`` from either end with the neighbour's time, where the neighbour is an entity.

    Ends are numbers, so that joins and shuffles hold no names; ``numbered_names`` makes those. Lines are dealt by order once:
    that serves the distinct pairs and the order's time.
    """
    lines = _lines(spark, folder)
    events = table(spark, folder, "events").where("event_type = 'error'")
    own = {"cust": ("customer", "c_custkey", None), "ord": ("orders", "o_orderkey", "o_orderdate"), "part": ("part", "p_partkey", None), "supp": ("supplier", "s_suppkey", None), "nation": ("nation", "n_nationkey", None)}

    def known(kind: str) -> DataFrame:
        rows, key, ts = (events, "event_id", "ts") if kind == "ev" else (table(spark, folder, own[kind][0]), *own[kind][1:])
        return rows.select(F.col(key).cast("long").alias("key"), (F.col(ts) if ts else F.lit(None)).cast("timestamp").alias("ts"))

    pairs = [
        (table(spark, folder, "orders"), "o_custkey", "o_orderkey"), (lines.select("l_orderkey", "l_partkey").distinct(), "l_orderkey", "l_partkey"), (lines.select("l_suppkey", "l_orderkey").distinct(), "l_suppkey", "l_orderkey"),
        (table(spark, folder, "customer"), "c_custkey", "c_nationkey"), (table(spark, folder, "supplier"), "s_suppkey", "s_nationkey"), (events, "user_id", "event_id"),
    ]
    kinds = sorted({kind for _, kind, _ in WAYS})
    sides = [(rows, *ends) for rows, a, b in pairs for ends in ((a, b), (b, a))]
    seen = [
        rows.select(F.col(a).cast("long").alias("origin_key"), F.col(b).cast("long").alias("key")).join(known(WAYS[way][2]), "key").select(F.lit(way).alias("way"), F.lit(kinds.index(WAYS[way][1])).alias("kind"), "origin_key", "key", "ts")
        for way, (rows, a, b) in enumerate(sides)
    ]
    return reduce(DataFrame.unionAll, seen)


def numbered_names() -> dict[str, Column]:
    """origin, id, relation and confidence of the rows of ``numbered_ends``."""
    told = lambda k: F.element_at(F.array(*[F.lit(way[k]) for way in WAYS]), F.col("way") + 1)
    name = lambda k, key: F.concat(told(k), F.lit(":"), F.col(key).cast("string"))
    return {"origin": name(1, "origin_key"), "id": name(2, "key"), "relation": told(0), "confidence": edge_price(told(0), F.lit(None).cast("double"))}


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """id and embedding: the embeddings belong to parts of the same number."""
    return table(spark, folder, "embeddings").select(_id("part", "vec_id").alias("id"), "embedding")
