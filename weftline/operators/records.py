"""Recorded runs and stored rows as callers see them: metadata, projections, lookups, sessions, statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import overlap, tokens
from weftline.operators.documents import char_chunks, word_windows
from weftline.sources.shared import written

# Keys of recorded metadata and inputs in order of preference, steps that are plumbing, words of each kind, fields of a node's text and path.
SCORE_KEYS = ("score", "relevance_score", "similarity", "_score", "vector_score")
QUERY_KEYS = ("query", "question", "input", "text")
NOISE_NAMES = (
    "LangGraph", "RunnableSequence", "RunnableCallable", "RunnableLambda", "ChannelWrite", "ChannelRead", "_write", "_route", "__start__", "__end__",
)
KIND_WORDS = {
    "PR": ("pr", "pullrequest", "mergerequest", "mr"), "Commit": ("commit", "changeset", "revision"), "Ticket": ("ticket", "issue", "bug"),
    "Person": ("person", "user", "author", "contributor", "maintainer", "reviewer"), "Team": ("team", "group"), "Repo": ("repo", "repository", "project"),
    "Service": ("service", "component"), "Library": ("library", "package", "dependency"), "Tool": ("tool",),
}
TEXT_FIELDS = ("title", "message", "full_name", "path", "login")
PATH_FIELDS = ("url", "path", "full_name")
NUMBERED = {"Ticket": "ticket", "PR": "pr"}


def _typed(json: Column, key: str) -> tuple[Column, Column]:
    """A field of a JSON object as text, and its type's name."""
    field = F.variant_get(F.try_parse_json(json), f"$.{key}", "variant")
    return F.get_json_object(json, f"$.{key}"), F.schema_of_variant(field)


def metadata_score(json: Column) -> Column:
    """The first of the score keys whose value is a number (true and false are none)."""
    typed = [_typed(json, key) for key in SCORE_KEYS]
    return F.coalesce(*[F.when(kind.rlike(r"^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), text.cast("double")) for text, kind in typed])


def input_question(json: Column) -> Column:
    """The first of the question keys whose value is a text that is not empty."""
    typed = [_typed(json, key) for key in QUERY_KEYS]
    return F.coalesce(*[F.when((kind == "STRING") & (text != ""), text) for text, kind in typed])


def metadata_edges(json: Column) -> Column:
    """The well-formed edges of recorded metadata: source, target, relation and weight, each under its newer or older name."""
    kind = "array<struct<source:string,target:string,relation:string,type:string,weight:double,confidence:double>>"
    text = lambda c: F.nullif(c, F.lit(""))
    edges = F.transform(F.from_json(F.get_json_object(json, "$.edges"), kind), lambda e: F.struct(
        text(e["source"]).alias("source"), text(e["target"]).alias("target"), F.coalesce(text(e["relation"]), text(e["type"])).alias("relation"), F.coalesce(e["weight"], e["confidence"]).alias("weight"),
    ))
    whole = F.filter(edges, lambda e: e["source"].isNotNull() & e["target"].isNotNull() & e["relation"].isNotNull())
    return F.coalesce(whole, F.array().cast("array<struct<source:string,target:string,relation:string,weight:double>>"))


def is_step(name: Column, node: Column) -> Column:
    """Whether a started chain is a node that someone wrote."""
    return node.isNotNull() & (name == node) & ~name.isin(*NOISE_NAMES)


def kept_ancestors(spans: DataFrame) -> DataFrame:
    """run, id and parent of the kept spans (run, id, parent_id, kept): the nearest ancestor that is kept; none beyond a span that is not there.

    Pointer jumping over the spans that are left out: joins double the distance, until all point at a kept span or end.
    """
    skipped = spans.where(~F.col("kept")).select("run", F.col("id").alias("up"), F.col("parent_id").alias("further"))
    known = spans.select("run", F.col("id").alias("up"), "kept")
    hop, n = written(skipped.join(known.withColumnRenamed("up", "further"), ["run", "further"], "left").select("run", "up", F.when(F.col("kept").isNotNull(), F.col("further")).alias("further"), F.coalesce("kept", F.lit(True)).alias("done")), "hops"), 0
    while n < 64 and hop.where("not done").limit(1).count():
        over = hop.select("run", F.col("up").alias("further"), F.col("further").alias("beyond"), F.col("done").alias("ended"))
        hop = hop.join(over, ["run", "further"], "left").select("run", "up", F.when(F.col("done"), F.col("further")).otherwise(F.col("beyond")).alias("further"), F.when(F.col("done"), True).otherwise(F.coalesce("ended", F.lit(True))).alias("done"))
        hop, n = written(hop, "hops"), n + 1
    kept = spans.where("kept").select("run", "id", F.col("parent_id").alias("up")).join(known, ["run", "up"], "left")
    return kept.join(hop.where("done").select("run", "up", "further"), ["run", "up"], "left").select("run", "id", F.when(F.col("kept"), F.col("up")).otherwise(F.col("further")).alias("parent"))


def judgeable(items: DataFrame, key: str) -> DataFrame:
    """Of each run whether used and unused can be told apart: an answer, and an item that was measured against it."""
    return items.groupBy(key).agg(F.max(F.col("answer").isNotNull() & F.col("overlap").isNotNull()).alias("judged"))


def entity_kind(kind: Column) -> Column:
    """The type that a free word names; what names none is a document."""
    word = F.regexp_replace(F.lower(F.coalesce(kind, F.lit(""))), r"[\s_\-]+", "")
    names = F.create_map(*[F.lit(x) for name, words in KIND_WORDS.items() for w in words for x in (w, name)])
    return F.coalesce(F.try_element_at(names, word), F.lit("Document"))


def node_field(fields: tuple[str, ...], node_id: Column, has: set[str]) -> Column:
    """The first of the fields that a node has and that is not empty, else its id."""
    return F.coalesce(*[F.nullif(F.col(f).cast("string"), F.lit("")) for f in fields if f in has], node_id)


def local_id(kind: Column, text: Column) -> Column:
    """Tickets and changes by their number, all others by their text in lower case."""
    number = F.regexp_extract(text, r"\d+", 0)
    prefix = reduce(lambda c, k: c.when(kind == k, NUMBERED[k]), NUMBERED, F.when(F.lit(False), ""))
    return F.when(kind.isin(*NUMBERED) & (number != ""), F.concat_ws(":", prefix, number)).otherwise(F.concat_ws(":", F.lower(kind), F.lower(text)))


def graph_label(path: Column, default: str | None = None) -> Column:
    """A graph file's name: its stem, with the mark of the default one, else with doubled underscores as slashes."""
    stem = F.regexp_replace(F.regexp_extract(path, r"[^/]*$", 0), r"(?<=.)\.[^.]*$", "")
    return F.when(path == F.lit(default), F.concat(stem, F.lit(" (default)"))).otherwise(F.replace(stem, F.lit("__"), F.lit("/")))


def verdict(reply: Column, yes: str = "YES", no: str = "NO") -> Column:
    """True or false by how a reply begins; anything else is an error."""
    text = F.upper(F.trim(reply))
    return F.when(F.startswith(text, F.lit(yes)), True).when(F.startswith(text, F.lit(no)), False).otherwise(F.raise_error(F.concat(F.lit("unrecognised reply: "), F.substring(text, 1, 80))).cast("boolean"))


def unwrapped(payload: Column) -> tuple[Column, Column]:
    """The results of a stored payload without its wrapping, and the graph that the wrapping names."""
    graph, kind = _typed(payload, "graph_id")
    results = F.get_json_object(payload, "$.results")
    return F.when(kind.isNotNull() & results.isNotNull(), results).otherwise(payload), F.when((kind == "STRING") & (graph != ""), graph)


def page_text(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """id and content of hits (id, label, type): the text of their documents (id, doc, content) in order, else the label, else type and id."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc", F.trim("content").alias("c")))), lambda x: x["c"]), "\n\n")
    texts = documents.where(F.trim("content") != "").groupBy("id").agg(text.alias("text"))
    return hits.join(texts, "id", "left").select("id", F.coalesce("text", F.nullif(F.col("label"), F.lit("")), F.concat_ws(" ", "type", "id")).alias("content"))


def hit_payload(fused: DataFrame) -> DataFrame:
    """All parts of a fused score, 0 where an arm did not find it, and whether both did."""
    parts = {c: F.coalesce(c, F.lit(0.0)) for c in ("vector_score", "graph_score")}
    return fused.withColumns(parts).withColumn("found_by_both", (F.col("vector_score") > 0) & (F.col("graph_score") > 0))


def retitled(sessions: DataFrame, requests: DataFrame) -> DataFrame:
    """sessions (session_id, user_id, title) after requests (seq, session_id, user_id, title): the owner's last title counts, others' requests change nothing, one without a session begins one."""
    named = requests.where("session_id is not null").groupBy("session_id", "user_id").agg(F.max_by("title", F.struct("seq", "title")).alias("new"))
    kept = sessions.join(named, ["session_id", "user_id"], "left").select("session_id", "user_id", F.coalesce("new", "title").alias("title"))
    begun = requests.where("session_id is null").select(F.concat(F.lit("new-"), "seq").alias("session_id"), "user_id", "title")
    return kept.unionByName(begun)


def first_seen(users: DataFrame, requests: DataFrame, domain: str = "users.invalid") -> DataFrame:
    """users (id, email) with those that requests (seq, id, email) name first. An address that another id holds, or claimed earlier, is replaced by a placeholder, and so is none."""
    placeholder = F.concat("id", F.lit(f"@{domain}"))
    fresh = requests.join(users.select("id"), "id", "left_anti").groupBy("id").agg(F.min("seq").alias("seq"), F.min_by("email", "seq").alias("email"))
    claimed = fresh.where("email is not null").groupBy("email").agg(F.min_by("id", "seq").alias("claimant"))
    held = users.select("email", F.lit(True).alias("held")).distinct()
    own = fresh.join(claimed, "email", "left").join(held, "email", "left")
    free = F.col("email").isNotNull() & F.col("held").isNull() & (F.col("claimant") == F.col("id"))
    return users.select("id", "email").unionByName(own.select("id", F.when(free, F.col("email")).otherwise(placeholder).alias("email")))


def owned(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """Rows (session_id, user_id) whose session is the user's: one that is missing is like one of somebody else."""
    return rows.join(sessions.select("session_id", "user_id"), ["session_id", "user_id"], "left_semi")


def found_edges(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of each asked ordered pair (src, dst) its edge, or nulls."""
    return pairs.select("src", "dst").distinct().join(edges, ["src", "dst"], "left")


def with_embeddings(old: DataFrame, new: DataFrame) -> DataFrame:
    """Vectors (id, embedding) with those of known ids replaced."""
    return old.join(new.select("id", F.col("embedding").alias("fresh")), "id", "left").select("id", F.coalesce("fresh", "embedding").alias("embedding"))


def graph_statistics(entity: DataFrame, edges: DataFrame, documents: DataFrame) -> DataFrame:
    """what, name and n: nodes by type, edges by relation, documents."""
    count = lambda rows, what, name: rows.groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "name", "n")
    return count(entity, "nodes", F.col("type")).unionAll(count(edges, "edges", F.col("relation"))).unionAll(documents.agg(F.count(F.lit(1)).alias("n")).select(F.lit("documents"), F.lit("all"), "n"))


def inventory(items: DataFrame, key: str) -> DataFrame:
    """Of each run its kinds and their counts, as one text in order of kind."""
    counts = items.groupBy(key, "kind").agg(F.count(F.lit(1)).alias("n"))
    lines = F.array_sort(F.collect_list(F.struct("kind", "n")))
    return counts.groupBy(key).agg(F.array_join(F.transform(lines, lambda x: F.concat(x["kind"], F.lit(": "), x["n"])), ", ").alias("inventory"))


def work_of(edges: DataFrame) -> DataFrame:
    """Of each author the works in order, and how many."""
    return edges.where("relation = 'AUTHORED'").groupBy(F.col("src").alias("author")).agg(F.array_sort(F.collect_set("dst")).alias("works")).withColumn("n", F.size("works"))


def walk_summary(hops: DataFrame, key: str) -> DataFrame:
    """hops (relation, src, dst) of each run: relations by how often they were followed, and all ids that were touched."""
    counts = hops.groupBy(key, "relation").agg(F.count(F.lit(1)).alias("n"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "relation", "n")))
    lines = counts.groupBy(key).agg(F.array_join(F.transform(order, lambda x: F.concat(x["n"], F.lit("x "), x["relation"])), ", ").alias("followed"))
    ids = hops.select(key, F.explode(F.array("src", "dst")).alias("id")).groupBy(key).agg(F.count_distinct("id").alias("touched"))
    return lines.join(ids, key)


def examples_for(nodes: DataFrame, edges: DataFrame, question: str, limit: int = 7) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, text) by the share of their words that the question holds, the best few, and the edges among them."""
    score = overlap(tokens(F.col("text")), tokens(F.lit(question)))
    top = nodes.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), "id").limit(limit)
    ends = top.select("id")
    among = edges.join(ends.withColumnRenamed("id", "src"), "src", "left_semi").join(ends.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return top, among


def best_chunks(chunks: DataFrame, question: str) -> DataFrame:
    """Of each origin (origin, seq, content) the chunk that holds most of the question's words, the first of equals, and how many the origin holds in all."""
    asked = tokens(F.lit(question), ("who", "what", "when", "where", "which", "how", "why", "repo", "repository"))
    hits = F.array_intersect(asked, tokens(F.col("content")))
    rows = chunks.select("origin", "seq", "content", hits.alias("hits"))
    return rows.groupBy("origin").agg(
        F.max_by(F.struct("seq", "content"), F.struct(F.size("hits"), -F.col("seq"))).alias("best"), F.size(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("held"),
    ).select("origin", F.col("best.seq").alias("seq"), F.col("best.content").alias("content"), "held")


def named_seeds(asked: DataFrame, entity: DataFrame, near: DataFrame, at_least: float = 0.80) -> DataFrame:
    """asked (name): the entities of this label (any case); for a name that is nobody's, the nearest entity of near (name, id, similarity) that is near enough."""
    named = asked.join(entity.select(F.lower("label").alias("key"), "id"), F.lower("name") == F.col("key")).select("name", "id", F.lit("named").alias("how"))
    best = near.where(F.col("similarity") >= at_least).groupBy("name").agg(F.min_by("id", F.struct(-F.col("similarity"), "id")).alias("id"))
    return named.unionByName(best.join(named.select("name"), "name", "left_anti").select("name", "id", F.lit("near").alias("how")))


def source_bodies(pull_requests: DataFrame, issues: DataFrame, commits: DataFrame, reviews: DataFrame) -> DataFrame:
    """Chunks of all four kinds of bodies (id, content each): kind, chunk_id, content."""
    kinds = {"pr": pull_requests, "ticket": issues, "commit": commits, "review": reviews}
    rows = [x.select(F.lit(kind).alias("kind"), F.concat_ws(":", F.lit(kind), "id").alias("base"), "content") for kind, x in kinds.items()]
    return char_chunks(reduce(DataFrame.unionAll, rows)).select("kind", "chunk_id", "content")


def source_windows(files: DataFrame, words: int = 90, overlap_words: int = 15) -> DataFrame:
    """files (path, content) in windows of words with the lines they span in their path: path#L1-L9."""
    windows = word_windows(files.select(F.col("path").alias("base"), "content"), words, overlap_words, lines=True)
    return windows.select(F.concat(F.col("base"), F.lit("#L"), "line", F.lit("-L"), "last_line").alias("path"), "idx", "content")
