"""Answers without vectors: lexical ranking with one step of spread, suggestions, resolution by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import overlap, question_tokens, tokens, without_comments
from weftline.operators.graph import at_origins
from weftline.sources.shared import tasks_for, written


def lexical_scores(nodes: DataFrame, question: str) -> DataFrame:
    """nodes: id, text, ts. Adds lexical: the share of the question's tokens that the text holds."""
    asked = question_tokens(F.lit(question))
    share = F.size(F.array_intersect(asked, tokens(F.col("text")))) / F.greatest(F.size(asked), F.lit(1))
    return nodes.withColumn("lexical", F.coalesce(share, F.lit(0.0)))


def lexical_trace(nodes: DataFrame, edges: DataFrame, question: str, top: int = 10, chunks: DataFrame | None = None, repository: str = "") -> DataFrame:
    """id, lexical, spread, score and place (from 1) of the best nodes (id, text, ts and, if known, path): the better half of the places seed one step along edges at 0.7 of its price.

    With chunks (origin, content) a node's words are also those of its documents. Of equal shares the one goes first whose
    file name holds more of the question's words (but the repository's own), then the newest.
    """
    asked = question_tokens(F.lit(question))
    words = nodes.select("id", "ts", tokens(F.coalesce("text", F.lit(""))).alias("own"), *(["path"] if "path" in nodes.columns else [F.lit(None).cast("string").alias("path")]))
    if chunks is not None:
        held = chunks.groupBy(F.col("origin").alias("id")).agg(F.array_distinct(F.flatten(F.collect_list(F.array_intersect(asked, tokens(F.col("content")))))).alias("held"))
        words = words.join(held, "id", "left").withColumn("own", F.concat("own", F.coalesce("held", F.array().cast("array<string>"))))
    stem = F.regexp_replace(F.regexp_extract("path", r"[^/]*$", 0), r"(?<=.)\.[^.]*$", "")
    names = F.array_except(asked, tokens(F.lit(repository.replace("/", " "))))
    share = F.size(F.array_intersect(asked, "own")) / F.greatest(F.size(asked), F.lit(1))
    hits = F.coalesce(F.size(F.array_intersect(names, tokens(F.regexp_replace(stem, "[_-]", " ")))), F.lit(0))
    scored = words.select("id", "ts", share.alias("lexical"), F.when(F.col("path").isNull(), 0).otherwise(hits).alias("hits"))
    seeds = scored.orderBy(F.desc("lexical"), F.desc("hits"), F.desc_nulls_last("ts"), F.desc("id")).limit(max(1, top // 2))
    near = at_origins(edges, F.broadcast(seeds.select(F.col("id").alias("origin"), F.col("lexical").alias("from"))))
    spread = near.groupBy("id").agg(F.max(F.least(F.lit(1.0), F.col("from") * F.col("confidence") * 0.7)).alias("spread"))
    both = scored.join(spread, "id", "left").withColumn("spread", F.coalesce("spread", F.lit(0.0))).withColumn("score", F.greatest("lexical", "spread"))
    order = [F.desc("score"), F.desc("lexical"), F.desc("hits"), F.desc("id")]
    best = both.orderBy(*order).limit(top)
    return best.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))).select("id", "lexical", "spread", "score", "place")


# Lengths of an item's and of an answer's excerpt, cited matches, and the sentences of an answer.
ITEM_CHARS, ANSWER_CHARS, CITED = 500, 120, 3
FOUND = "In the {0} {1} fetched for this run, the closest matches are: %s. Open the trace for their source text and connections."
NOTHING = "No text match for this question appeared in the fetched {0} {1}. Inspect the retrieved graph and sources; this is not a claim about the entire repository."


def answered(found: DataFrame, nodes: DataFrame, chunks: DataFrame, question: str, repository: str, scope: str = "recent history") -> DataFrame:
    """place, id, label, content, uri, score, graph_score, overlap and answer of a trace's items.

    found: what ``lexical_trace`` gave, as a written table (a few rows). nodes: id, text, label, uri. chunks: origin, seq, content.
    An item's content is its text and the chunk that holds most of the question's words (of equals the first). The answer
    cites the first items that hold any; an item's overlap is the share of its tokens that the answer holds.
    """
    asked, one = question_tokens(F.lit(question)), Window.partitionBy(F.lit(0))
    few = F.broadcast(found.select("id"))  # as many rows as a trace has places
    hits = F.size(F.array_intersect(asked, tokens(F.col("content"))))
    best = chunks.join(few.withColumnRenamed("id", "origin"), "origin", "left_semi").groupBy(F.col("origin").alias("id")).agg(F.max_by("content", F.struct(hits, -F.col("seq"))).alias("chunk"))
    items = found.join(nodes.join(few, "id", "left_semi").select("id", "text", "label", "uri"), "id").join(best, "id", "left")
    text = F.trim(F.concat_ws(". ", F.nullif(F.col("text"), F.lit("")), "chunk"))
    label = F.coalesce(F.nullif(F.col("label"), F.lit("")), F.col("id"))
    items = items.select("place", "id", label.alias("label"), F.coalesce(F.nullif(F.substring(text, 1, ITEM_CHARS), F.lit("")), F.col("id")).alias("content"), F.coalesce("uri", F.lit(repository)).alias("uri"), "lexical", "score", "spread")
    own = F.when(F.startswith(F.col("content"), F.col("label")), F.substring(F.col("content"), F.length("label") + 1, F.lit(ITEM_CHARS))).otherwise(F.col("content"))
    body = F.btrim(F.regexp_replace(F.translate(without_comments(own), "\ufeff", " "), r"\s+", " "), F.lit(" .#"))
    said = F.concat("label", F.when(body != "", F.concat(F.lit(": "), F.rtrim(F.substring(body, 1, ANSWER_CHARS)))).otherwise(""), F.lit(" ("), "uri", F.lit(")"))
    items = items.withColumn("turn", F.when(F.col("lexical") > 0, F.sum((F.col("lexical") > 0).cast("int")).over(one.orderBy("place"))))
    cited = F.array_sort(F.collect_list(F.when(F.col("turn") <= CITED, F.struct("turn", said.alias("said")))).over(one))
    details = F.array_join(F.transform(cited, lambda x: x["said"]), "; ")
    head, tail = FOUND.format(repository, scope).split("%s")
    answer = F.when(F.size(cited) > 0, F.concat(F.lit(head), details, F.lit(tail))).otherwise(F.lit(NOTHING.format(repository, scope)))
    items = items.withColumn("answer", answer)
    return items.select(
        "place", "id", "label", "content", "uri", F.round("score", 4).alias("score"), F.round("spread", 4).alias("graph_score"), F.round(overlap(tokens(F.col("content")), tokens(F.col("answer"))), 4).alias("overlap"), "answer"
    )


def share_retriever(corpus: DataFrame, links: DataFrame, question: str, k: int = 10) -> DataFrame:
    """corpus: id, text, seq, degree; links: source, target. Two thirds of the places by share of terms, then what these are linked to, then the rest."""
    ranked = lexical_scores(corpus, question).select("id", "seq", "degree", F.round("lexical", 3).alias("share"))
    order = [F.desc("share"), F.desc("degree"), "seq"]
    seeds = ranked.where("share > 0").orderBy(*order).limit(max(1, k - k // 3))
    ends = links.select(F.col("source").alias("a"), F.col("target").alias("b"))
    near = ends.unionAll(links.select(F.col("target").alias("a"), F.col("source").alias("b"))).join(seeds.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct()
    related = ranked.join(near, "id", "left_semi").orderBy(*order).limit(k)
    rest = ranked.orderBy(*order).limit(k)
    both = seeds.withColumn("turn", F.lit(0)).unionByName(related.withColumn("turn", F.lit(1))).unionByName(rest.withColumn("turn", F.lit(2)))
    first = both.groupBy("id").agg(F.min("turn").alias("turn"), F.first("share").alias("share"), F.first("degree").alias("degree"), F.first("seq").alias("seq"))
    return first.orderBy("turn", *order).limit(k).select("id", "share", "turn")


def suggestions(hubs: DataFrame, limit: int) -> DataFrame:
    """hubs: label, type, degree. Questions about the busiest entity of each type, then about further ones; no question twice."""
    order = [F.desc("degree"), "label", "type"]
    rows = written(hubs.where(F.trim(F.coalesce("label", F.lit(""))) != "").select(F.trim("label").alias("label"), "type", "degree"), "hubs")
    rows = rows.repartition(tasks_for(rows.sparkSession, rows.count()), "label")
    # The first of each type by aggregates: a window would hold all of a type in one task. Equal rows ask one question.
    place = F.struct(F.col("degree").isNull(), -F.col("degree"), "label")
    firsts = rows.groupBy(F.col("type").alias("of")).agg(F.min(place).alias("first"))  # a row for each type
    rows = rows.join(F.broadcast(firsts), F.col("type").eqNullSafe(F.col("of")))
    rows = rows.withColumn("later", (~place.eqNullSafe(F.col("first"))).cast("int")).withColumn("query", F.concat(F.lit("What is related to "), "label", F.lit("?")))
    rows = rows.groupBy("label", "query").agg(F.min(F.struct("later", -F.col("degree"), "type")).alias("s")).select("query", "label", "s.type", F.col("s.later").alias("later"), (-F.col("s.col2")).alias("degree"))
    return rows.orderBy("later", *order).limit(max(limit, 1)).select("query", F.col("label").alias("entity"), "type")
