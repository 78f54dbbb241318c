"""Source documents: character chunks, word windows, context text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import running
from weftline.options import DEFAULTS


def char_chunks(documents: DataFrame, size: int = DEFAULTS.chunk_chars, overlap: int = DEFAULTS.chunk_overlap) -> DataFrame:
    """base, idx, chunk_id and content of documents (base, content). Blank chunks are dropped and leave a gap in the index."""
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length("content") - size) / F.lit(float(step)))).cast("int")
    rows = documents.where("content is not null").withColumn("idx", F.explode(F.sequence(F.lit(0), last)))
    rows = rows.withColumn("content", F.substring(F.col("content"), F.col("idx") * step + 1, F.lit(size)))
    return rows.where(F.length(F.trim(F.regexp_replace("content", r"\s", ""))) > 0).withColumn("chunk_id", F.concat_ws(":", "base", "idx"))


def word_windows(documents: DataFrame, size: int = DEFAULTS.window_words, overlap: int = DEFAULTS.window_overlap, lines: bool = False) -> DataFrame:
    """base, idx, begin, finish (offsets in the text) and content of windows of words; the last reaches the final word. With ``lines`` also line and last_line, where it begins and ends.

    The text is cut before the white space of each step of words; running sums over the steps tell where a window begins.
    """
    step = size - overlap
    whole, rest = divmod(size, step)
    words = lambda n: rf"(?U)(?:\s*+\S++){{1,{n}}}+"
    newlines = lambda text: F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    rows = documents.where("content is not null").select("base", F.regexp_extract_all("content", F.lit(words(step)), F.lit(0)).alias("w"))
    in_last = F.coalesce(F.size(F.regexp_extract_all(F.try_element_at("w", F.lit(-1)), F.lit(r"(?U)\S++"), F.lit(0))), F.lit(0))
    n = F.greatest(F.lit(0), F.ceil(((F.size("w") - 1) * step + in_last - size) / F.lit(float(step)))).cast("int") + 1
    rows = rows.select("base", "w", n.alias("n"), F.transform("w", F.length).alias("long"), *([F.transform("w", newlines).alias("ends")] if lines else []))
    rows = rows.select("base", "w", "n", "long", running("long").alias("upto"), *(["ends", running("ends").alias("over")] if lines else []))
    body = lambda i: F.concat(F.array_join(F.slice("w", i + 1, whole), ""), F.coalesce(F.regexp_extract(F.get("w", i + whole), words(rest), 0), F.lit("")) if rest else F.lit(""))
    before = lambda sums, own, i: (F.get(sums, i) - F.get(own, i))
    part = lambda x, i: F.struct(body(i).alias("content"), before("upto", "long", i).alias("upto"), *([before("over", "ends", i).alias("over")] if lines else []))
    rows = rows.select("base", F.posexplode(F.transform(F.slice("w", F.lit(1), F.col("n")), part)).alias("idx", "x")).select("base", "idx", "x", F.regexp_extract("x.content", r"(?U)^\s*", 0).alias("blank"))
    places = ((F.col("x.upto") + F.length("blank")).alias("begin"), (F.col("x.upto") + F.length("x.content")).alias("finish"))
    at = (F.col("x.over") + newlines(F.col("blank")) + 1, F.col("x.over") + newlines(F.col("x.content")) + 1) if lines else ()
    return rows.select("base", "idx", *places, F.substr(F.col("x.content"), F.length("blank") + 1).alias("content"), *[c.alias(name) for c, name in zip(at, ("line", "last_line"), strict=False)])


def context_lines(hits: DataFrame) -> DataFrame:
    """hits: query, rank, id, label, doc, content. Each text is given in full once per query, later hits refer back to it."""
    again = F.row_number().over(Window.partitionBy("query", "doc").orderBy("rank")) > 1
    line = F.when(again, F.concat(F.lit("["), F.col("label"), F.lit("] see "), F.col("doc"))).otherwise(F.concat(F.lit("["), F.col("label"), F.lit("] "), F.col("content")))
    lines = hits.withColumn("line", line).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("lines"))
    return lines.select("query", F.array_join("lines.line", "\n").alias("context"))
