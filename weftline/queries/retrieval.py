"""Walks, vector search, fusion, and retrieval by words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import scoring, vectors
from weftline.operators import graph, resolution
from weftline.plans import lexical, persist, retrieval
from weftline.plans.index import VectorIndex
from weftline.queries import query, sql
from weftline.sources.edges import stored
from weftline.sources.graph import entities, relation_rows, relations, table
from weftline.sources.graph import vectors as embeddings
from weftline.sources.shared import new_folder, written

NOW = "TIMESTAMP '1998-12-31 00:00:00'"
_SEEDS = "(SELECT 'supp:' || s_suppkey AS id FROM supplier WHERE s_suppkey <= 3)"
_COSINE = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
_NEAR = f"SELECT 'part:' || e.vec_id AS id, {_COSINE} AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q"


def _query_vector(spark: SparkSession, folder: str) -> list[float]:
    """The vector that stands for a question."""
    return list(table(spark, folder, "embeddings").where("vec_id = 0").select("embedding").first()[0])


def _seeds(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "supplier").where("s_suppkey <= 3").select(F.concat(F.lit("supp:"), "s_suppkey").alias("id"))


_HYBRID = f"""
    WITH {sql.GRAPH}, seeds AS {_SEEDS}, {sql.walk("seeds")},
    near AS ({_NEAR} ORDER BY similarity DESC, id LIMIT 10),
    budget AS (SELECT id, similarity FROM near QUALIFY row_number() OVER (ORDER BY similarity DESC, id) <= greatest(2, 10 - (SELECT count(*) FROM hits))),
    fused AS (SELECT coalesce(v.id, g.id) AS id, coalesce(v.similarity, 0) AS vector, coalesce(g.score, 0) AS graph FROM budget v FULL JOIN hits g ON v.id = g.id)
    SELECT f.id, e.label, e.type, round(vector, 6) AS vector_score, round(graph, 6) AS graph_score, round({sql.decay("e.ts", "e.type", NOW)}, 6) AS recency,
        round((0.15 * vector + 0.85 * graph) * {sql.decay("e.ts", "e.type", NOW)}, 6) AS score
    FROM fused f LEFT JOIN entity e USING (id) ORDER BY score DESC, id LIMIT 10
"""


@query(_HYBRID)
def hybrid_retrieval(spark: SparkSession, folder: str) -> DataFrame:
    entity = entities(spark, folder)
    hits = retrieval.best_path_walk(stored(spark, folder), entity, _seeds(spark, folder))
    near = retrieval.vector_search(embeddings(spark, folder), _query_vector(spark, folder), 10)
    fused = retrieval.fuse(near, hits, entity, "relational", F.expr(NOW))
    return fused.select("id", "label", "type", *[F.round(c, 6).alias(c) for c in ("vector_score", "graph_score", "recency", "score")])


_DOCS = "SELECT 'doc:' || doc_id AS doc, source AS path, 'part:' || (doc_id % 500) AS entity FROM documents"


def _documents(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Mentions (doc, entity) and documents (id, path): each document belongs to a part."""
    docs = table(spark, folder, "documents").select(F.concat(F.lit("doc:"), "doc_id").alias("id"), F.col("source").alias("path"), F.concat(F.lit("part:"), F.col("doc_id") % 500).alias("entity"))
    return docs.select(F.col("id").alias("doc"), "entity"), docs.select("id", "path")


@query(f"""
    SELECT h.id, h.label, h.score, h.vector_score > 0 AND h.graph_score > 0 AS found_by_both, coalesce(string_agg(d.doc || '@' || d.path, ',' ORDER BY d.doc), '') AS documents
    FROM ({_HYBRID}) h LEFT JOIN ({_DOCS}) d ON d.entity = h.id GROUP BY ALL
""")
def routed_response(spark: SparkSession, folder: str) -> DataFrame:
    found = retrieval.routed_response(hybrid_retrieval(spark, folder), *_documents(spark, folder))
    return found.select("id", "label", "score", "found_by_both", F.array_join(F.transform("documents", lambda d: F.concat(d["doc"], F.lit("@"), d["path"])), ",").alias("documents"))


@query(f"""
    WITH {sql.GRAPH}, seed AS (SELECT min(e.id) AS id FROM entity e JOIN supplier ON lower(e.label) = lower(s_name) AND s_suppkey = 2), {sql.impact('seed')},
    d AS (SELECT entity, doc || '@' || path AS line, row_number() OVER (PARTITION BY entity ORDER BY doc) AS n FROM ({_DOCS}))
    SELECT i.id, i.hops, i.confidence, coalesce(string_agg(d.line, ',' ORDER BY d.n), '') AS citations FROM impacted i LEFT JOIN d ON d.entity = i.id AND d.n <= 2 GROUP BY ALL
""")
def impact_report(spark: SparkSession, folder: str) -> DataFrame:
    entity = entities(spark, folder)
    asked = table(spark, folder, "supplier").where("s_suppkey = 2").select(F.lower("s_name").alias("asked"))
    seed = entity.withColumn("asked", F.lower("label")).join(asked, "asked", "left_semi").agg(F.min("id").alias("id"))
    report = retrieval.impact_report(retrieval.impact(stored(spark, folder), entity, written(seed, "seed")), *_documents(spark, folder))
    return report.select("id", "hops", "confidence", F.array_join(F.transform("citations", lambda d: F.concat(d["doc"], F.lit("@"), d["path"])), ",").alias("citations"))


@query(f"WITH {sql.GRAPH}, seeds AS {_SEEDS}, {sql.walk('seeds')} SELECT id, round(score, 6) AS score, hops FROM hits")
def best_path_walk(spark: SparkSession, folder: str) -> DataFrame:
    hits = retrieval.best_path_walk(stored(spark, folder), entities(spark, folder), _seeds(spark, folder))
    return hits.select("id", F.round("score", 6).alias("score"), "hops")


@query(f"WITH {sql.GRAPH}, seeds AS {_SEEDS}, {sql.router('seeds')} SELECT id, round(score, 6) AS score FROM routed")
def router_walk(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.router_walk(stored(spark, folder), entities(spark, folder), _seeds(spark, folder)).select("id", F.round("score", 6).alias("score"))


@query(f"WITH {sql.GRAPH}, seed AS (SELECT min(id) AS id FROM {_SEEDS}), {sql.impact('seed')} SELECT id, hops, confidence FROM impacted")
def impact_walk(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.impact(stored(spark, folder), entities(spark, folder), _seeds(spark, folder).agg(F.min("id").alias("id")))


_ALL_NEAR = f"""
    SELECT 'part:' || q.vec_id AS query, 'part:' || e.vec_id AS id, round({_COSINE}, 9) AS similarity FROM embeddings q JOIN embeddings e ON q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id
"""


def _questions(spark: SparkSession, folder: str) -> DataFrame:
    """Every twentieth vector."""
    return embeddings(spark, folder).where(F.substring_index("id", ":", -1).cast("long") % 20 == 0)


@query(f"""
    SELECT query, id, round(similarity, 6) AS similarity, rank FROM (SELECT *, (row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id))::INTEGER AS rank FROM ({_ALL_NEAR})) WHERE rank <= 10
""")
def vector_topk(spark: SparkSession, folder: str) -> DataFrame:
    near = retrieval.vector_search_all(embeddings(spark, folder), _questions(spark, folder), 10)
    return near.select("query", "id", F.round("similarity", 6).alias("similarity"), "rank")


@query(f"""
    SELECT query, id, round(similarity, 6) AS similarity, rank FROM (SELECT *, (row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id))::INTEGER AS rank FROM ({_ALL_NEAR})) WHERE rank <= 7
""")
def vector_index_search(spark: SparkSession, folder: str) -> DataFrame:
    """Seven nearest, from a stored index that is opened again after it was built."""
    place = new_folder(spark, "index")
    VectorIndex.build(embeddings(spark, folder), place)
    near = VectorIndex.open(spark, place).search(_questions(spark, folder), 7)
    return near.select("query", "id", F.round("similarity", 6).alias("similarity"), "rank")


@query(f"""
    SELECT query, id, round(similarity, 6) AS similarity, rank
    FROM (SELECT *, (row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id))::INTEGER AS rank FROM ({_ALL_NEAR}) WHERE similarity >= 0.2) WHERE rank <= 10
""")
def vector_floor(spark: SparkSession, folder: str) -> DataFrame:
    near = retrieval.vector_search_all(embeddings(spark, folder), _questions(spark, folder), 10, 0.2)
    return near.select("query", "id", F.round("similarity", 6).alias("similarity"), "rank")


@query(f"""
    WITH n AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id) AS rank FROM ({_ALL_NEAR})),
    v AS (SELECT query, e.label, count(*) AS votes, min(rank) AS first FROM n JOIN embeddings e ON n.id = 'part:' || e.vec_id WHERE rank <= 5 GROUP BY ALL)
    SELECT query, arg_max(label, (votes, -first)) AS label, max(votes) AS votes FROM v GROUP BY query
""")
def label_knn(spark: SparkSession, folder: str) -> DataFrame:
    """The label that most of a vector's five nearest have, of equals the nearer."""
    near = retrieval.vector_search_all(embeddings(spark, folder), _questions(spark, folder), 5)
    labels = table(spark, folder, "embeddings").select(F.concat(F.lit("part:"), "vec_id").alias("id"), "label")
    votes = near.join(labels, "id").groupBy("query", "label").agg(F.count(F.lit(1)).alias("votes"), F.min("rank").alias("first"))
    return votes.groupBy("query").agg(F.max_by("label", F.struct("votes", -F.col("first"))).alias("label"), F.max("votes").alias("votes"))


@query("""
    SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 5) AS squared,
        round((embedding[1]::DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS first
    FROM embeddings
""")
def l2_normalize(spark: SparkSession, folder: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, folder, "embeddings").select("vec_id", F.round(vectors.dot(e, e), 5).alias("squared"), F.round(F.get(vectors.normalised(e), F.lit(0)), 6).alias("first"))


@query(f"""
    WITH tiers AS (SELECT id, similarity, CASE WHEN similarity >= 0.35 THEN 1 ELSE 2 END AS tier FROM ({_NEAR} ORDER BY similarity DESC, id LIMIT 10)),
    top AS (SELECT * FROM tiers QUALIFY row_number() OVER (PARTITION BY tier ORDER BY similarity DESC, id) <= 3)
    SELECT id FROM top WHERE tier = (SELECT min(tier) FROM top)
""")
def seed_selection(spark: SparkSession, folder: str) -> DataFrame:
    near = retrieval.vector_search(embeddings(spark, folder), _query_vector(spark, folder), 10)
    exact = entities(spark, folder).where(F.lower("label") == "no such label")
    return retrieval.select_seeds(exact, near)


@query(f"SELECT o_orderkey, round({sql.decay('o_orderdate', chr(39) + 'PR' + chr(39), NOW)}, 6) AS decay FROM orders")
def recency_decay(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select("o_orderkey", F.round(scoring.decay(F.col("o_orderdate"), F.lit("PR"), F.expr(NOW)), 6).alias("decay"))


@query(f"WITH {sql.EDGES} SELECT relation, count(*) AS n, round(sum(confidence), 6) AS total FROM edges GROUP BY relation")
def edge_price(spark: SparkSession, folder: str) -> DataFrame:
    return relations(spark, folder).groupBy("relation").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("confidence"), 6).alias("total"))


_QUESTION = "which haouen thereou the erand"
_LEXICAL = f"""
    {sql.GRAPH}, q AS (SELECT {sql.tokens(chr(39) + _QUESTION + chr(39), "['who','what','when','where','which','how','why','repo','repository']")} AS asked),
    scored AS (SELECT id, ts, len(list_intersect(asked, {sql.tokens("label")}))::DOUBLE / greatest(len(asked), 1) AS lexical FROM entity, q)
"""


@query(f"""
    WITH {_LEXICAL}, seeds AS (SELECT id AS origin, lexical FROM scored ORDER BY lexical DESC, ts DESC NULLS LAST, id DESC LIMIT 5),
    spread AS (SELECT b.id, max(least(1.0, s.lexical * b.confidence * 0.7)) AS spread FROM both_ways b JOIN seeds s USING (origin) GROUP BY b.id)
    SELECT id, round(lexical, 6) AS lexical, round(coalesce(spread, 0), 6) AS spread, round(greatest(lexical, coalesce(spread, 0)), 6) AS score
    FROM scored LEFT JOIN spread USING (id) ORDER BY greatest(lexical, coalesce(spread, 0)) DESC, lexical DESC, id DESC LIMIT 10
""")
def local_lexical_trace(spark: SparkSession, folder: str) -> DataFrame:
    nodes = entities(spark, folder).withColumnRenamed("label", "text")
    found = lexical.lexical_trace(nodes, relations(spark, folder), _QUESTION)
    return found.select("id", *[F.round(c, 6).alias(c) for c in ("lexical", "spread", "score")])


_ASKED_WORDS = f"{sql.tokens(chr(39) + _QUESTION + chr(39), '[' + chr(39) + (chr(39) + ',' + chr(39)).join(['who', 'what', 'when', 'where', 'which', 'how', 'why', 'repo', 'repository']) + chr(39) + ']')}"


@query(f"""
    WITH {sql.GRAPH}, q AS (SELECT {_ASKED_WORDS} AS asked), c AS (SELECT 'part:' || (doc_id % 500) AS id, flatten(list(list_intersect(asked, {sql.tokens("text")}))) AS held FROM documents, q GROUP BY ALL),
    scored AS (SELECT e.id, e.ts, len(list_intersect(asked, list_concat({sql.tokens("e.label")}, coalesce(c.held, []))))::DOUBLE / greatest(len(asked), 1) AS lexical,
        CASE WHEN e.type = 'File' THEN len(list_intersect(list_filter(asked, lambda w: w <> 'erand'), {sql.tokens("regexp_replace(e.label, '[_-]', ' ', 'g')")})) ELSE 0 END AS hits FROM entity e LEFT JOIN c USING (id), q),
    seeds AS (SELECT id AS origin, lexical FROM scored ORDER BY lexical DESC, hits DESC, ts DESC NULLS LAST, id DESC LIMIT 5),
    spread AS (SELECT b.id, max(least(1.0, s.lexical * b.confidence * 0.7)) AS spread FROM both_ways b JOIN seeds s USING (origin) GROUP BY b.id)
    SELECT id, round(lexical, 6) AS lexical, round(coalesce(spread, 0), 6) AS spread, round(greatest(lexical, coalesce(spread, 0)), 6) AS score
    FROM scored LEFT JOIN spread USING (id) ORDER BY greatest(lexical, coalesce(spread, 0)) DESC, lexical DESC, hits DESC, id DESC LIMIT 10
""")
def lexical_documents(spark: SparkSession, folder: str) -> DataFrame:
    path = F.when(F.col("type") == "File", F.concat(F.lit("src/"), "label", F.lit(".py")))
    nodes = entities(spark, folder).select("id", F.col("label").alias("text"), "ts", path.alias("path"))
    chunks = table(spark, folder, "documents").select(F.concat(F.lit("part:"), F.col("doc_id") % 500).alias("origin"), F.col("text").alias("content"))
    found = lexical.lexical_trace(nodes, relations(spark, folder), _QUESTION, 10, chunks, "acme/erand")
    return found.select("id", *[F.round(c, 6).alias(c) for c in ("lexical", "spread", "score")])


_TRACED = f"""
    {sql.GRAPH}, q AS MATERIALIZED (SELECT {_ASKED_WORDS} AS asked), c AS (SELECT 'part:' || (doc_id % 500) AS id, flatten(list(list_intersect(asked, {sql.tokens("text")}))) AS held FROM documents, q GROUP BY ALL),
    scored AS (SELECT e.id, e.ts, len(list_intersect(asked, list_concat({sql.tokens("e.label")}, coalesce(c.held, []))))::DOUBLE / greatest(len(asked), 1) AS lexical,
        CASE WHEN e.type = 'File' THEN len(list_intersect(list_filter(asked, lambda w: w <> 'erand'), {sql.tokens("regexp_replace(e.label, '[_-]', ' ', 'g')")})) ELSE 0 END AS hits FROM entity e LEFT JOIN c USING (id), q),
    seeds AS (SELECT id AS origin, lexical FROM scored ORDER BY lexical DESC, hits DESC, ts DESC NULLS LAST, id DESC LIMIT 5),
    spread AS (SELECT b.id, max(least(1.0, s.lexical * b.confidence * 0.7)) AS spread FROM both_ways b JOIN seeds s USING (origin) GROUP BY b.id),
    found AS MATERIALIZED (
        SELECT id, lexical, coalesce(spread, 0) AS spread, greatest(lexical, coalesce(spread, 0)) AS score, row_number() OVER (ORDER BY greatest(lexical, coalesce(spread, 0)) DESC, lexical DESC, hits DESC, id DESC) AS place
        FROM scored LEFT JOIN spread USING (id) QUALIFY place <= 10)"""


@query(f"""
    WITH {_TRACED},
    best AS (SELECT id, arg_max(text, {{'h': h, 's': -doc_id}}) AS chunk FROM (SELECT 'part:' || (doc_id % 500) AS id, doc_id, text, len(list_intersect(asked, {sql.tokens("text")})) AS h FROM documents, q) WHERE id IN (SELECT id FROM found) GROUP BY id),
    item AS (SELECT f.place, f.id, e.label, substr(trim(e.label || coalesce('. ' || b.chunk, '')), 1, 500) AS content, 'https://x.y/' || f.id AS uri, f.lexical, f.score, f.spread FROM found f JOIN entity e USING (id) LEFT JOIN best b USING (id)),
    said AS (SELECT *, trim(regexp_replace(CASE WHEN starts_with(content, label) THEN substr(content, length(label) + 1) ELSE content END, '\\s+', ' ', 'g'), ' .#') AS body FROM item),
    cited AS (SELECT label || CASE WHEN body <> '' THEN ': ' || rtrim(substr(body, 1, 120)) ELSE '' END || ' (' || uri || ')' AS line, place FROM said WHERE lexical > 0 ORDER BY place LIMIT 3),
    a AS (SELECT CASE WHEN count(*) > 0 THEN 'In the acme/erand recent history fetched for this run, the closest matches are: ' || string_agg(line, '; ' ORDER BY place) || '. Open the trace for their source text and connections.'
        ELSE 'No text match for this question appeared in the fetched acme/erand recent history. Inspect the retrieved graph and sources; this is not a claim about the entire repository.' END AS answer FROM cited)
    SELECT place::INTEGER AS place, id, label, content, uri, round(score, 4) AS score, round(spread, 4) AS graph_score, round({sql.overlap("it", "at_")}, 4) AS overlap, answer
    FROM (SELECT s.*, a.answer, {sql.tokens("s.content")} AS it, {sql.tokens("a.answer")} AS at_ FROM said s, a)
""")
def lexical_answer(spark: SparkSession, folder: str) -> DataFrame:
    """The same trace's items with their text, the answer that cites the first of them, and how much of each it used."""
    path = F.when(F.col("type") == "File", F.concat(F.lit("src/"), "label", F.lit(".py")))
    nodes = entities(spark, folder).select("id", F.col("label").alias("text"), "ts", path.alias("path"), "label", F.concat(F.lit("https://x.y/"), "id").alias("uri"))
    chunks = table(spark, folder, "documents").select(F.concat(F.lit("part:"), F.col("doc_id") % 500).alias("origin"), F.col("doc_id").alias("seq"), F.col("text").alias("content"))
    found = lexical.lexical_trace(nodes.select("id", "text", "ts", "path"), relations(spark, folder), _QUESTION, 10, chunks, "acme/erand")
    return lexical.answered(written(found, "trace"), nodes, chunks, _QUESTION, "acme/erand")


@query(f"""
    WITH {_LEXICAL}, degree AS (SELECT origin AS id, count(DISTINCT id) AS degree FROM both_ways WHERE origin <> id GROUP BY origin),
    r AS MATERIALIZED (SELECT id, degree, round(lexical, 3) AS share FROM scored JOIN degree USING (id)),
    seeds AS (SELECT * FROM r WHERE share > 0 ORDER BY share DESC, degree DESC, id LIMIT 7),
    related AS (SELECT * FROM r WHERE id IN (SELECT b.id FROM both_ways b WHERE b.origin IN (SELECT id FROM seeds)) ORDER BY share DESC, degree DESC, id LIMIT 10),
    rest AS (SELECT * FROM r ORDER BY share DESC, degree DESC, id LIMIT 10)
    SELECT id, share, min(turn) AS turn FROM (SELECT *, 0 AS turn FROM seeds UNION ALL SELECT *, 1 FROM related UNION ALL SELECT *, 2 FROM rest) GROUP BY id, share, degree
    ORDER BY turn, share DESC, degree DESC, id LIMIT 10
""")
def demo_retriever(spark: SparkSession, folder: str) -> DataFrame:
    edges = relations(spark, folder)
    corpus = entities(spark, folder).join(graph.degrees(edges, relation_rows(spark, folder)), "id").select("id", F.col("label").alias("text"), "degree", F.col("id").alias("seq"))
    return lexical.share_retriever(corpus, edges.select(F.col("src").alias("source"), F.col("dst").alias("target")), _QUESTION)


@query(f"""
    WITH {sql.GRAPH}, d AS (SELECT origin AS id, count(DISTINCT id) AS degree FROM both_ways WHERE origin <> id GROUP BY origin),
    h AS (SELECT label, type, degree, row_number() OVER (PARTITION BY type ORDER BY degree DESC, label) > 1 AS later FROM d JOIN entity USING (id) WHERE trim(label) <> ''),
    u AS (SELECT label, arg_min(type, (later::INTEGER, -degree, type)) AS type, min((later::INTEGER, -degree, type)) AS k FROM h GROUP BY label)
    SELECT 'What is related to ' || label || '?' AS query, label AS entity, type FROM u ORDER BY k[1], k[2], label LIMIT 8
""")
def suggestions(spark: SparkSession, folder: str) -> DataFrame:
    edges = relations(spark, folder)
    hubs = graph.degrees(edges, relation_rows(spark, folder)).join(entities(spark, folder), "id").select("label", "type", "degree")
    return lexical.suggestions(hubs, 8)


_RESOLVED = """
    WITH RECURSIVE m AS MATERIALIZED (
        SELECT label % 3 AS block, 'kind ' || (label % 2) AS type, vec_id AS seq, 'name ' || (vec_id % 97) AS text, row_number() OVER (PARTITION BY label % 3, label % 2 ORDER BY vec_id) AS n,
            list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v
        FROM embeddings
    ), f AS (
        SELECT block, type, n, seq, text, text AS canonical, 'created' AS path, NULL::DOUBLE AS similarity, [text] AS labels, [v] AS known FROM m WHERE n = 1
        UNION ALL
        SELECT block, type, n, seq, text, CASE WHEN near THEN labels[pos] ELSE text END, CASE WHEN NOT near THEN 'created' WHEN labels[pos] = text THEN 'repeat' ELSE 'merged' END, best,
            CASE WHEN near THEN labels ELSE list_append(labels, text) END, CASE WHEN near THEN known ELSE list_append(known, v) END
        FROM (
            SELECT *, best >= 0.35 AS near, list_position(scores, best) AS pos FROM (
                SELECT *, list_max(scores) AS best FROM (
                    SELECT m.*, f.labels, f.known, list_transform(f.known, lambda c: round(list_inner_product(c, m.v), 9)) AS scores FROM f JOIN m ON m.block = f.block AND m.type = f.type AND m.n = f.n + 1
                )
            )
        )
    )
    SELECT block::INTEGER AS block, type, seq, text, canonical, path, round(similarity, 6) AS similarity, path = 'created' AND coalesce(similarity >= 0.3, false) AS asked FROM f
"""


@query(_RESOLVED)
def resolve_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector as the mention of a name, resolved in order within six kinds."""
    rows = table(spark, folder, "embeddings").select(
        (F.col("label") % 3).alias("block"), F.concat(F.lit("kind "), F.col("label") % 2).alias("type"), F.col("vec_id").alias("seq"), F.concat(F.lit("name "), F.col("vec_id") % 97).alias("text"),
        F.col("embedding").alias("vector"),
    )
    return resolution.resolve(rows, merge_at=0.35, ask_at=0.3).withColumn("similarity", F.round("similarity", 6))


@query(f"""
    WITH r AS ({_RESOLVED}), n AS (SELECT count(*) AS seen, count(*) FILTER (path = 'created') AS created, count(*) FILTER (path = 'merged') AS fast_merges, count(*) FILTER (path = 'repeat') AS repeats,
        count(*) FILTER (path <> 'created') AS merges, count(*) FILTER (path = 'created' AND similarity >= 0.3) AS asked FROM r)
    SELECT name, value::DOUBLE AS value FROM (UNPIVOT (SELECT seen::DOUBLE AS seen, created::DOUBLE AS created, fast_merges::DOUBLE AS fast_merges, 0::DOUBLE AS model_merges, repeats::DOUBLE AS repeats, fast_merges::DOUBLE AS variant_merges,
        merges::DOUBLE AS merges, asked::DOUBLE AS asked, round(asked / seen, 4)::DOUBLE AS band_fraction FROM n) ON COLUMNS(*))
""")
def resolution_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """What was counted while the resolution's own result was written."""
    counted = persist.write_resolved(resolve_entities(spark, folder), new_folder(spark, "resolved"))
    return spark.createDataFrame([(k, float(v)) for k, v in counted.items()], "name string, value double")


@query(f"""
    WITH s AS ({_NEAR.replace('SELECT ', 'SELECT e.label AS label, ', 1)}) SELECT label, max(similarity) >= 0.8 AS found, round(max(similarity), 6) AS best FROM s GROUP BY label
""")
def resolver_find(spark: SparkSession, folder: str) -> DataFrame:
    similarity = vectors.cosine(F.col("embedding"), retrieval.literal_vector(_query_vector(spark, folder)))
    rows = table(spark, folder, "embeddings").select("label", similarity.alias("s")).groupBy("label").agg(F.max("s").alias("s"))
    return rows.select("label", (F.col("s") >= 0.8).alias("found"), F.round("s", 6).alias("best"))
