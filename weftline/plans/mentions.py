"""Documents to entities and mentions in one plan: windows, spans of rules and of a model, resolution, graph rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.documents import word_windows
from weftline.operators.entities import extract_entities
from weftline.operators.resolution import resolve
from weftline.options import DEFAULTS, Options
from weftline.sources.shared import written

#: From windows (base, idx, content) to spans (base, idx, text, type, start, end) with places in the window; base is to be passed on as it is.
Model = Callable[[DataFrame], DataFrame]
#: Kinds whose number is their identity; they are not resolved.
NUMBERED = ("Ticket", "PR")


def placed(windows: DataFrame, spans: DataFrame) -> DataFrame:
    """doc, text, type, start and end in the document, of spans in its windows."""
    at = spans.join(windows.select("base", "idx", "begin"), ["base", "idx"])
    return at.select(F.col("base").alias("doc"), "text", "type", (F.col("start") + F.col("begin")).cast("int").alias("start"), (F.col("end") + F.col("begin")).cast("int").alias("end"))


def swept(spans: DataFrame) -> DataFrame:
    """Spans (doc, text, type, start, end) of one document and type that overlap, as windows that share words give them, become one that covers them."""
    order = Window.partitionBy("doc", "type").orderBy("start", F.desc("end"), "text")
    spans = spans.withColumn("before", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    new = F.coalesce(F.col("start") >= F.col("before"), F.lit(True))
    # Each part adds what reaches beyond those before it; the others are left out at once.
    parts = spans.where(new | (F.col("end") > F.col("before"))).withColumn("piece", F.when(new, F.col("text")).otherwise(F.substr("text", F.col("before") - F.col("start") + 1)))
    islands = parts.withColumn("island", F.sum(new.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = islands.groupBy("doc", "type", "island").agg(F.collect_list(F.struct("end", "piece")).alias("parts"), F.min("start").alias("start"), F.max("end").alias("end"))
    pieces = F.when(F.size("parts") == 1, F.col("parts")[0]["piece"]).otherwise(F.array_join(F.transform(F.array_sort("parts"), lambda x: x["piece"]), ""))
    return whole.select("doc", pieces.alias("text"), "type", "start", "end")


def extracted(documents: DataFrame, model: Model | None = None, options: Options = DEFAULTS) -> DataFrame:
    """doc, text, type, start, end and score of all entities of documents (doc, content): rules read whole texts, a model windows of words."""
    if model is None:
        return extract_entities(documents)
    windows = word_windows(documents.select(F.col("doc").alias("base"), "content"), options.window_words, options.window_overlap)
    # A window's base tells where it begins, so that spans need not meet the windows again.
    spans = model(windows.withColumn("base", F.struct(F.col("base").alias("doc"), "begin")))
    place = lambda c: (F.col(c) + F.col("base.begin")).cast("int").alias(c)
    return extract_entities(documents, swept(spans.select("base.doc", "text", "type", place("start"), place("end"))))


def document_mentions(documents: DataFrame, model: Model | None = None, vectors: DataFrame | None = None, known: DataFrame | None = None, options: Options = DEFAULTS) -> dict[str, DataFrame]:
    """entity (id, label, type, new) and mentions (doc, entity) of documents (doc, content).

    Names of one type are the same if they differ in case alone; with ``vectors`` (text, type, embedding), of the
    names in order of first sight (document, place), those that are alike enough are too. Numbered kinds keep their number. ``new`` tells
    an entity that ``known`` (id) does not have.
    """
    found = written(extracted(documents, model, options), "extracted")
    key = F.when(F.col("type").isin(*NUMBERED), F.col("text")).otherwise(F.lower("text"))
    names = found.withColumn("key", key).groupBy("type", "key").agg(F.min(F.struct("doc", "start", "text")).alias("first"))
    names = written(names.select("type", "key", "first.doc", "first.start", F.col("first.text").alias("label")), "names")
    if vectors is not None:
        seen = F.row_number().over(Window.partitionBy("type").orderBy("doc", "start", "label"))  # distinct names of one type
        rows = names.where(~F.col("type").isin(*NUMBERED)).withColumn("seq", seen).join(vectors.select(F.col("text").alias("label"), "type", "embedding"), ["label", "type"])
        same = resolve(rows.select(F.lit(0).alias("block"), "type", "seq", F.col("label").alias("text"), F.col("embedding").alias("vector")), None, options.merge_at, options.ask_at)
        same = same.select("type", F.col("text").alias("label"), "canonical")
        names = names.join(same, ["type", "label"], "left").withColumn("label", F.coalesce("canonical", "label")).drop("canonical")
    # A numbered reference has the id that a built graph gives the item itself.
    names = names.withColumn("id", F.concat_ws(":", F.lower("type"), F.when(F.col("type").isin(*NUMBERED), F.regexp_extract("label", r"(\d+)", 1)).otherwise(F.lower("label"))))
    entity = names.groupBy("id").agg(F.min_by("label", F.struct("doc", "start")).alias("label"), F.first("type").alias("type"))
    entity = entity.withColumn("new", F.lit(True)) if known is None else entity.join(known.select("id", F.lit(False).alias("new")).distinct(), "id", "left").withColumn("new", F.coalesce("new", F.lit(True)))
    mentions = found.withColumn("key", key).join(names.select("type", "key", F.col("id").alias("entity")), ["type", "key"]).select("doc", "entity").distinct()
    return {"entity": entity, "mentions": mentions}
