"""Traces of retrieval runs: one nested schema for all versions, scores of what was used, spans, canvas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions.text import overlap, tokens
from weftline.options import DEFAULTS
from weftline.sources.shared import written

ITEM = "struct<id:string,label:string,kind:string,content:string,source:string,score:double,overlap:double>"
EDGE = "struct<source:string,target:string,relation:string,type:string,weight:double,confidence:double>"
SPAN = "struct<id:string,name:string,kind:string,parent_id:string,start_ms:double,end_ms:double,status:string>"
#: All versions: 1 and 2 hold one flat retrieval, 3 and later a list; version 1 names edge fields type and confidence.
TRACE = (
    f"schema_version int, query string, answer string, started_at string, arm string, items array<{ITEM}>, edges array<{EDGE}>, "
    f"retrievals array<struct<query:string,arm:string,items:array<{ITEM}>,edges:array<{EDGE}>>>, spans array<{SPAN}>"
)
NEWEST_VERSION = 4


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Trace files of a folder, newest first: by start, else by the file's own time."""
    rows = spark.read.schema(f"{TRACE}, _bad string").option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(path)
    rows = rows.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_modification_time").alias("changed")).where("_bad is null").drop("_bad")
    return rows.orderBy(F.desc(F.coalesce(F.try_to_timestamp("started_at"), "changed")), F.desc("file"))


def upgraded(traces: DataFrame) -> DataFrame:
    """Every version in the newest form: ``retrievals``, and edges with relation and weight. A newer version is an error."""
    version = F.coalesce("schema_version", F.lit(NEWEST_VERSION))
    one = F.array(F.struct("query", F.coalesce("arm", F.lit("unknown")).alias("arm"), "items", "edges"))
    edge = lambda e: F.struct(e["source"].alias("source"), e["target"].alias("target"), F.coalesce(e["relation"], e["type"]).alias("relation"), F.coalesce(e["weight"], e["confidence"]).alias("weight"))
    known = F.transform(
        F.coalesce("retrievals", F.when(F.col("items").isNotNull(), one), F.array().cast(f"array<struct<query:string,arm:string,items:array<{ITEM}>,edges:array<{EDGE}>>>")),
        lambda r: F.struct(r["query"].alias("query"), r["arm"].alias("arm"), r["items"].alias("items"), F.transform(F.coalesce(r["edges"], F.array().cast(f"array<{EDGE}>")), edge).alias("edges")),
    )
    checked = F.when(version <= NEWEST_VERSION, version).otherwise(F.raise_error(F.concat(F.lit("trace of a newer version: "), version.cast("string"))).cast("int"))
    return traces.withColumns({"retrievals": known, "schema_version": checked}).drop("items", "edges", "arm")


def arm(retrievals: str = "retrievals"):
    """unknown without retrievals, the one arm they all have, else hybrid."""
    kinds = F.array_distinct(F.transform(retrievals, lambda r: r["arm"]))
    return F.when(F.size(kinds) == 0, "unknown").when(F.size(kinds) == 1, F.get(kinds, F.lit(0))).otherwise("hybrid")


def items(traces: DataFrame, key: str) -> DataFrame:
    """key, r, i, and the fields of every item of every retrieval, in order."""
    rows = traces.select(key, "answer", F.posexplode("retrievals").alias("r", "one")).select(key, "answer", "r", F.posexplode("one.items").alias("i", "item"))
    return rows.select(key, "answer", "r", "i", "item.*")


def first_items(flat: DataFrame, key: str) -> DataFrame:
    """The first occurrence of every item id of a trace."""
    first = F.row_number().over(Window.partitionBy(key, "id").orderBy("r", "i"))
    return flat.withColumn("__first", first).where("__first = 1").drop("__first")


def measured(flat: DataFrame, threshold: float = DEFAULTS.used_at) -> DataFrame:
    """Adds overlap (null without an answer) and used to items (content, answer)."""
    score = F.when(F.trim(F.coalesce("answer", F.lit(""))) != "", overlap(tokens(F.col("content")), tokens(F.col("answer"))))
    return flat.withColumn("overlap", score).withColumn("used", F.col("overlap") >= threshold)


def summary(scored: DataFrame, key: str) -> DataFrame:
    """Items, used items and mean overlap of each trace."""
    return scored.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_items"), F.count_if(F.coalesce("used", F.lit(False))).alias("n_used"), F.coalesce(F.round(F.avg("overlap"), 3), F.lit(0.0)).alias("mean_overlap")
    )


def span_depths(spans: DataFrame) -> DataFrame:
    """run, id and depth of spans (run, id, parent_id): steps upward, to a root (a missing parent makes one) or to the first span seen again.

    Pointer jumping: after k joins every span knows its ancestor 2**k steps up, so depth d takes log2(d) joins. Once every
    walk has gone further than its run has spans, those still going lead into a cycle and are finished there.
    """
    ids = spans.select("run", F.col("id").alias("parent_id")).distinct().withColumn("known", F.lit(True))
    base = written(spans.join(ids, ["run", "parent_id"], "left").select("run", "id", F.when(F.col("known"), F.col("parent_id")).alias("up")), "spans")
    longest = base.groupBy("run").count().agg(F.max("count")).first()[0] or 0
    now, steps = base.withColumn("depth", F.col("up").isNotNull().cast("long")), 1
    while steps <= longest and now.where("up is not null").limit(1).count():
        above = now.select("run", F.col("id").alias("up"), F.col("up").alias("further"), F.col("depth").alias("more"))
        now = now.join(above, ["run", "up"], "left").select("run", "id", F.col("further").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        now = written(now, "depths")
        steps *= 2
    endless = now.where("up is not null").select("run", "id")
    done = now.where("up is null").select("run", "id", F.col("depth").cast("int").alias("depth"))
    # Cycles are made by mistake and short: a step for each join, for the spans that lead into one alone.
    walk = written(endless.select("run", "id", F.array("id").alias("path")), "cycles")
    up = base.where("up is not null").select("run", F.col("id").alias("at"), "up")
    while walk.limit(1).count():
        step = written(walk.withColumn("at", F.element_at("path", -1)).join(up, ["run", "at"]), "cycles")
        again = F.expr("array_contains(path, up)")
        done = done.unionByName(step.where(again).select("run", "id", (F.size("path") - 1).alias("depth")))
        walk = step.where(~again).select("run", "id", F.array_append("path", F.col("up")).alias("path"))
    return done


def steps(spans: DataFrame) -> DataFrame:
    """Spans of each run in order of start (unknown: 0), with their index and duration."""
    order = Window.partitionBy("run").orderBy(F.coalesce("start_ms", F.lit(0.0)), "id")
    return spans.withColumn("step", F.row_number().over(order) - 1).withColumn("duration_ms", F.round(F.col("end_ms") - F.col("start_ms"), 1))


def canvas_edges(edges: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """Edges (key, source, target, relation, weight) between drawn nodes (key, id, active): active if both ends are."""
    one = nodes.select(key, F.col("id").alias("source"), F.col("active").alias("a"))
    two = nodes.select(key, F.col("id").alias("target"), F.col("active").alias("b"))
    return edges.join(one, [key, "source"]).join(two, [key, "target"]).select(key, "source", "target", "relation", F.coalesce("weight", F.lit(0.7)).alias("confidence"), (F.col("a") & F.col("b")).alias("active"))


def file_name(query, started_at):
    """Name of a trace's file: the UTC time it began, and its question as a slug."""
    from weftline.functions.text import slug

    return F.concat(F.date_format(started_at, "yyyyMMdd'T'HHmmss"), F.lit("-"), slug(query, 60, "query"), F.lit(".json"))


def to_json(traces: DataFrame) -> DataFrame:
    """Every row as one JSON document in the newest form."""
    return traces.select(F.to_json(F.struct(*traces.columns)).alias("value"))


def lines(scored: DataFrame, key: str, width: int = 60):
    """A trace as text: a header of counts, then a line for each item in order. scored: r, i, id, content, overlap, used."""
    score = F.coalesce(F.format_number("overlap", 2), F.lit("-"))
    fate = F.when(F.col("used").isNull(), "unclassified").when(F.col("used"), "used").otherwise("ignored")
    line = F.concat(F.rpad(fate, 13, " "), F.rpad(score, 6, " "), F.substring(F.regexp_replace("content", r"\s+", " "), 1, width))
    head = F.concat(F.lit("used "), F.count_if(F.coalesce("used", F.lit(False))).cast("string"), F.lit(" of "), F.count(F.lit(1)).cast("string"))
    rows = scored.groupBy(key).agg(head.alias("head"), F.array_sort(F.collect_list(F.struct("r", "i", line.alias("line")))).alias("l"))
    return rows.select(key, F.concat_ws("\n", "head", F.array_join("l.line", "\n")).alias("text"))
