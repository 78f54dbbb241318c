"""Recorded runs, sessions, lookups and statistics over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import control, records, runs, traces
from weftline.queries import query, sql
from weftline.queries.retrieval import _ALL_NEAR, _questions
from weftline.queries.text import _MEASURED, _SPAN_SQL, _flat, _spans
from weftline.plans import retrieval
from weftline.sources.graph import entities, relations, table
from weftline.sources.graph import vectors as embeddings
from weftline.streaming import debounce
from weftline.queries.writes import _BURSTS, _HOUR

_METADATA = """
    CASE event_id % 5 WHEN 0 THEN '{"score": ' || (event_id % 100) || '.5, "similarity": 0.25}' WHEN 1 THEN '{"score": true, "similarity": 0.5, "question": "", "input": "' || event_type || '"}'
    WHEN 2 THEN '{"relevance_score": "0.9", "_score": 2, "query": "q' || event_id || '"}' WHEN 3 THEN '{}' ELSE '{"text": 7, "question": "why ' || user_id || '"}' END
"""
_SCORE = ", ".join(f"CASE WHEN json_type(m, '$.{k}') IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN (m->>'$.{k}')::DOUBLE END" for k in records.SCORE_KEYS)
_ASKED = ", ".join(f"CASE WHEN json_type(m, '$.{k}') = 'VARCHAR' THEN nullif(m->>'$.{k}', '') END" for k in records.QUERY_KEYS)


@query(f"WITH e AS (SELECT event_id, ({_METADATA})::JSON AS m FROM events) SELECT event_id, coalesce({_SCORE}) AS score, coalesce({_ASKED}) AS question FROM e")
def metadata_fields(spark: SparkSession, folder: str) -> DataFrame:
    m = F.expr(_METADATA)
    return table(spark, folder, "events").select("event_id", records.metadata_score(m).alias("score"), records.input_question(m).alias("question"))


_EDGES = """
    CASE WHEN event_id % 4 = 0 THEN '{"edges": 5}' WHEN event_id % 4 = 1 THEN '{}' ELSE '{"edges": [{"source": "a' || user_id || '", "target": "b", "type": "LINKS", "confidence": 0.5},
    {"source": "", "target": "x", "relation": "R"}, {"source": "c", "target": "d", "relation": "R' || (event_id % 3) || '", "weight": 2}]}' END
"""


@query(f"""
    WITH e AS (SELECT event_id, unnest(CASE WHEN json_type(({_EDGES})::JSON, '$.edges') = 'ARRAY' THEN (({_EDGES})::JSON->'$.edges')::JSON[] ELSE [] END) AS e FROM events)
    SELECT event_id, e->>'$.source' AS source, e->>'$.target' AS target, coalesce(nullif(e->>'$.relation', ''), e->>'$.type') AS relation, coalesce(e->>'$.weight', e->>'$.confidence')::DOUBLE AS weight
    FROM e WHERE e->>'$.source' <> '' AND e->>'$.target' <> '' AND coalesce(nullif(e->>'$.relation', ''), e->>'$.type') <> ''
""")
def metadata_edges(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", F.explode(records.metadata_edges(F.expr(_EDGES))).alias("e")).select("event_id", "e.*")


@query(f"""
    WITH RECURSIVE {_SPAN_SQL}, k AS (SELECT run, id, parent_id, id::BIGINT % 3 <> 1 AS kept FROM s),
    w AS (SELECT run, id, parent_id AS up FROM k WHERE kept UNION ALL SELECT w.run, w.id, k.parent_id FROM w JOIN k ON k.run = w.run AND k.id = w.up AND NOT k.kept)
    SELECT w.run, w.id, CASE WHEN p.kept THEN w.up END AS parent FROM w LEFT JOIN k p ON p.run = w.run AND p.id = w.up WHERE p.kept IS NULL OR p.kept
""")
def nearest_kept_ancestor(spark: SparkSession, folder: str) -> DataFrame:
    spans = _spans(spark, folder).select("run", "id", "parent_id", (F.col("id").cast("long") % 3 != 1).alias("kept"))
    return records.kept_ancestors(spans)


_RUN_SPANS = """
    e AS (SELECT 'r' || conv_id AS run, 's' || turn AS id, CASE WHEN turn > 0 THEN 's' || (turn - 1 - turn % 2) END AS up, role = 'user' OR turn = 0 AS kept, role AS name, turn * 10 AS start,
        CASE WHEN turn % 5 <> 4 THEN 1000 - turn * 3 END AS "end", CASE WHEN turn % 7 = 3 THEN 'error' ELSE 'ok' END AS status, substr(md5(text), 1, 2) AS item FROM conversations)"""


@query(f"""
    WITH RECURSIVE {_RUN_SPANS}, climb AS (
        SELECT run, id, up AS at_ FROM e WHERE kept UNION ALL SELECT c.run, c.id, p.up FROM climb c JOIN e p ON p.run = c.run AND p.id = c.at_ WHERE NOT p.kept
    ), parents AS (SELECT c.run, c.id, max(p.id) AS parent FROM climb c LEFT JOIN e p ON p.run = c.run AND p.id = c.at_ AND p.kept GROUP BY c.run, c.id),
    deep AS (SELECT run, id, parent AS at_, 0 AS depth FROM parents UNION ALL SELECT d.run, d.id, p.parent, d.depth + 1 FROM deep d JOIN parents p ON p.run = d.run AND p.id = d.at_),
    own AS (SELECT run, id, item FROM e WHERE kept AND "end" IS NOT NULL QUALIFY row_number() OVER (PARTITION BY run, item ORDER BY "end", id) = 1)
    SELECT e.run, e.id, p.parent, d.depth::INTEGER AS depth, e.name, e.start::BIGINT AS start, e."end"::BIGINT AS "end", CASE WHEN e."end" IS NULL THEN 'open' ELSE e.status END AS status, coalesce(o.item, '') AS items
    FROM e JOIN parents p USING (run, id) JOIN (SELECT run, id, max(depth) AS depth FROM deep GROUP BY ALL) d USING (run, id) LEFT JOIN own o USING (run, id) WHERE e.kept
""")
def nested_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation as a run whose turns are spans: starts and closes in one table of events."""
    turns = table(spark, folder, "conversations")
    parent = F.when(F.col("turn") > 0, F.concat(F.lit("s"), F.col("turn") - 1 - F.col("turn") % 2))
    base = [F.concat(F.lit("r"), "conv_id").alias("run"), F.concat(F.lit("s"), "turn").alias("id"), parent.alias("parent_id")]
    none = F.lit(None).cast("array<string>")
    starts = turns.select(*base, F.lit("start").alias("kind"), ((F.col("role") == "user") | (F.col("turn") == 0)).alias("kept"), F.col("role").alias("name"), (F.col("turn") * 10).cast("long").alias("at"), none.alias("items"))
    closes = turns.where("turn % 5 <> 4").select(
        *base, F.when(F.col("turn") % 7 == 3, "error").otherwise("end").alias("kind"), F.lit(None).cast("boolean").alias("kept"), F.lit(None).cast("string").alias("name"), (1000 - F.col("turn") * 3).cast("long").alias("at"),
        F.array(F.substring(F.md5(F.col("text").cast("binary")), 1, 2)).alias("items"),
    )
    return runs.nested(starts.unionByName(closes)).withColumn("items", F.array_join("items", ","))


_STARTED = "CASE WHEN turn % 7 = 0 THEN '__start__' ELSE role END AS name, CASE turn % 3 WHEN 0 THEN CASE WHEN turn % 7 = 0 THEN '__start__' ELSE role END WHEN 1 THEN role ELSE NULL END AS node"


@query(f"SELECT conv_id, turn, name FROM (SELECT conv_id, turn, {_STARTED} FROM conversations) WHERE node IS NOT NULL AND name = node AND name <> '__start__'")
def recorded_steps(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").selectExpr("conv_id", "turn", *[x.strip() + " AS " + n for x, n in ((_STARTED.split(" AS name, ")[0], "name"), (_STARTED.split(" AS name, ")[1].removesuffix(" AS node"), "node"))])
    return rows.where(records.is_step(F.col("name"), F.col("node"))).select("conv_id", "turn", "name")


@query(f"SELECT m.conv_id, bool_or(m.overlap IS NOT NULL) AS judged FROM ({_MEASURED}) m GROUP BY m.conv_id")
def judgeable_runs(spark: SparkSession, folder: str) -> DataFrame:
    return records.judgeable(traces.measured(_flat(spark, folder)), "conv_id")


_KIND = "CASE event_id % 7 WHEN 0 THEN 'Pull-Request' WHEN 1 THEN 'merge request' WHEN 2 THEN 'BUG' WHEN 3 THEN 'contributor' WHEN 4 THEN 'a thing' WHEN 5 THEN 'de_pen dency' END"


@query(f"""
    SELECT event_id, CASE kind WHEN 'Pull-Request' THEN 'PR' WHEN 'merge request' THEN 'PR' WHEN 'BUG' THEN 'Ticket' WHEN 'contributor' THEN 'Person' WHEN 'de_pen dency' THEN 'Library' ELSE 'Document' END AS type
    FROM (SELECT event_id, {_KIND} AS kind FROM events)
""")
def entity_kinds(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", records.entity_kind(F.expr(_KIND)).alias("type"))


@query("""
    SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'ticket:' || p_partkey WHEN 1 THEN 'pr:' || p_partkey ELSE 'service:' || lower(p_name) END AS local_id, 'doc:part:' || p_partkey AS local_doc, 'part:' || p_partkey || ':doc' AS compiled_doc,
        CASE WHEN p_partkey = 7 THEN 'org__repo7 (default)' ELSE 'org/repo' || p_partkey END AS label, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'part:' || p_partkey END AS text
    FROM part
""")
def node_names(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "part").withColumns({
        "node": F.concat(F.lit("part:"), "p_partkey"), "kind": F.expr("CASE p_partkey % 3 WHEN 0 THEN 'Ticket' WHEN 1 THEN 'PR' ELSE 'Service' END"), "title": F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(""),
        "said": F.expr("CASE p_partkey % 3 WHEN 0 THEN 'issue #' || p_partkey WHEN 1 THEN 'PR ' || p_partkey ELSE p_name END"),
    })
    path = F.concat(F.lit("graphs/org__repo"), "p_partkey", F.lit(".db"))
    return rows.select("p_partkey", records.local_id(F.col("kind"), F.col("said")).alias("local_id"), F.concat(F.lit("doc:"), "node").alias("local_doc"), F.concat("node", F.lit(":doc")).alias("compiled_doc"), records.graph_label(path, "graphs/org__repo7.db").alias("label"), records.node_field(records.TEXT_FIELDS, F.col("node"), set(rows.columns)).alias("text"))


@query("SELECT o_orderkey, epoch(o_orderdate)::BIGINT AS seconds, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS iso, to_timestamp(epoch(o_orderdate)::BIGINT)::TIMESTAMP AS back FROM orders")
def instant_forms(spark: SparkSession, folder: str) -> DataFrame:
    at = F.col("o_orderdate").cast("timestamp")
    return table(spark, folder, "orders").select("o_orderkey", F.unix_seconds(at).alias("seconds"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ssxxx").alias("iso"), F.timestamp_seconds(F.unix_seconds(at)).alias("back"))


@query("SELECT o_orderkey, o_orderkey % 3 = 0 AS same FROM orders")
def merge_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    reply = F.expr("CASE o_orderkey % 3 WHEN 0 THEN ' yes, they are ' || o_orderkey WHEN 1 THEN 'NO' ELSE 'Not the same' END")
    return table(spark, folder, "orders").select("o_orderkey", records.verdict(reply).alias("same"))


_PAYLOAD = """CASE event_id % 3 WHEN 0 THEN '{"graph_id":"g' || user_id || '","results":{"n":' || event_id || '}}' WHEN 1 THEN '{"results":1}' ELSE '{"graph_id":"","results":[2]}' END"""


@query(f"""
    SELECT event_id, CASE WHEN event_id % 3 = 1 THEN p ELSE (p::JSON->'$.results')::VARCHAR END AS results, CASE WHEN event_id % 3 = 0 THEN p::JSON->>'$.graph_id' END AS graph_id FROM (SELECT event_id, {_PAYLOAD} AS p FROM events)
""")
def unwrapped_payloads(spark: SparkSession, folder: str) -> DataFrame:
    results, graph = records.unwrapped(F.expr(_PAYLOAD))
    return table(spark, folder, "events").select("event_id", results.alias("results"), graph.alias("graph_id"))


@query(f"""
    WITH {sql.ENTITY}, d AS (SELECT 'part:' || (doc_id % 500) AS id, string_agg(trim(text), chr(10) || chr(10) ORDER BY 'doc:' || doc_id) AS text FROM documents WHERE trim(text) <> '' GROUP BY ALL)
    SELECT e.id, md5(coalesce(d.text, nullif(e.label, ''), e.type || ' ' || e.id)) AS digest FROM entity e LEFT JOIN d USING (id) WHERE e.type = 'File'
""")
def page_contents(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(F.concat(F.lit("part:"), F.col("doc_id") % 500).alias("id"), F.concat(F.lit("doc:"), "doc_id").alias("doc"), F.col("text").alias("content"))
    return records.page_text(entities(spark, folder).where("type = 'File'"), docs).select("id", F.md5(F.col("content").cast("binary")).alias("digest"))


_REQUESTS = """
    SELECT l_orderkey * 10 + l_linenumber AS seq, CASE WHEN l_linenumber < 7 THEN 's' || l_orderkey END AS session_id, CASE WHEN l_partkey % 2 = 0 THEN 'u' || o_custkey ELSE 'u' || l_suppkey END AS user_id,
        l_returnflag || l_linenumber AS title FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""
_SESSIONS = "SELECT 's' || o_orderkey AS session_id, 'u' || o_custkey AS user_id, o_orderpriority AS title FROM orders"


def _requests(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").join(table(spark, folder, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.selectExpr("l_orderkey * 10 + l_linenumber AS seq", "CASE WHEN l_linenumber < 7 THEN 's' || l_orderkey END AS session_id", "CASE WHEN l_partkey % 2 = 0 THEN 'u' || o_custkey ELSE 'u' || l_suppkey END AS user_id", "l_returnflag || l_linenumber AS title")


def _sessions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").selectExpr("'s' || o_orderkey AS session_id", "'u' || o_custkey AS user_id", "o_orderpriority AS title")


@query(f"""
    WITH q AS ({_REQUESTS}), s AS ({_SESSIONS}), n AS (SELECT session_id, user_id, arg_max(title, (seq, title)) AS new FROM q WHERE session_id IS NOT NULL GROUP BY ALL)
    SELECT s.session_id, s.user_id, coalesce(n.new, s.title) AS title FROM s LEFT JOIN n USING (session_id, user_id) UNION ALL SELECT 'new-' || seq, user_id, title FROM q WHERE session_id IS NULL
""")
def session_titles(spark: SparkSession, folder: str) -> DataFrame:
    return records.retitled(_sessions(spark, folder), _requests(spark, folder))


@query(f"SELECT q.seq, q.session_id FROM ({_REQUESTS}) q SEMI JOIN ({_SESSIONS}) s ON q.session_id = s.session_id AND q.user_id = s.user_id")
def owned_requests(spark: SparkSession, folder: str) -> DataFrame:
    return records.owned(_requests(spark, folder), _sessions(spark, folder)).select("seq", "session_id")


@query("""
    WITH u AS (SELECT 'u' || c_custkey AS id, 'm' || (c_custkey % 400) || '@x' AS email FROM customer WHERE c_custkey % 2 = 0),
    f AS (SELECT 'u' || o_custkey AS id, min(o_orderkey) AS seq, arg_min(CASE WHEN o_orderkey % 5 <> 0 THEN 'm' || (o_custkey % 700) || '@x' ELSE '' END, o_orderkey) AS email FROM orders WHERE 'u' || o_custkey NOT IN (SELECT id FROM u) GROUP BY 1),
    c AS (SELECT email, arg_min(id, seq) AS claimant FROM f WHERE email <> '' GROUP BY email)
    SELECT id, email FROM u UNION ALL SELECT f.id, CASE WHEN f.email <> '' AND c.claimant = f.id AND f.email NOT IN (SELECT email FROM u) THEN f.email ELSE f.id || '@users.invalid' END FROM f LEFT JOIN c USING (email)
""")
def first_seen_users(spark: SparkSession, folder: str) -> DataFrame:
    users = table(spark, folder, "customer").where("c_custkey % 2 = 0").selectExpr("'u' || c_custkey AS id", "'m' || (c_custkey % 400) || '@x' AS email")
    asked = table(spark, folder, "orders").selectExpr("o_orderkey AS seq", "'u' || o_custkey AS id", "CASE WHEN o_orderkey % 5 <> 0 THEN 'm' || (o_custkey % 700) || '@x' END AS email")
    return records.first_seen(users, asked)


_PAIRS = "SELECT DISTINCT 'ord:' || l_orderkey AS src, 'part:' || (l_partkey + l_linenumber // 4) AS dst FROM lineitem"


@query(f"WITH {sql.EDGES} SELECT p.src, p.dst, e.relation, e.confidence FROM ({_PAIRS}) p LEFT JOIN edges e ON e.src = p.src AND e.dst = p.dst")
def edge_lookup(spark: SparkSession, folder: str) -> DataFrame:
    pairs = table(spark, folder, "lineitem").selectExpr("'ord:' || l_orderkey AS src", "'part:' || (l_partkey + l_linenumber DIV 4) AS dst")
    return records.found_edges(relations(spark, folder), pairs).select("src", "dst", "relation", "confidence")


@query("SELECT 'part:' || vec_id AS id, round(embedding[1]::DOUBLE * CASE WHEN vec_id % 3 = 0 THEN 2 ELSE 1 END, 6) AS first FROM embeddings")
def vector_update(spark: SparkSession, folder: str) -> DataFrame:
    old = embeddings(spark, folder).select("id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    new = table(spark, folder, "embeddings").where("vec_id % 3 = 0").select(F.concat(F.lit("part:"), "vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double") * 2).alias("embedding"))
    return records.with_embeddings(old, new).select("id", F.round(F.col("embedding")[0], 6).alias("first"))


@query(f"""
    WITH {sql.GRAPH} SELECT 'nodes' AS what, type AS name, count(*) AS n FROM entity GROUP BY type UNION ALL SELECT 'edges', relation, count(*) FROM edges GROUP BY relation UNION ALL SELECT 'documents', 'all', count(*) FROM documents
""")
def graph_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return records.graph_statistics(entities(spark, folder), relations(spark, folder), table(spark, folder, "documents"))


@query("SELECT conv_id, string_agg(role || ': ' || n, ', ' ORDER BY role) AS inventory FROM (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY ALL) GROUP BY conv_id")
def kind_inventory(spark: SparkSession, folder: str) -> DataFrame:
    return records.inventory(table(spark, folder, "conversations").select("conv_id", F.col("role").alias("kind")), "conv_id")


@query(f"WITH {sql.EDGES} SELECT src AS author, string_agg(dst, ',' ORDER BY dst) AS works, count(*)::INTEGER AS n FROM edges WHERE relation = 'AUTHORED' GROUP BY src")
def authored_work(spark: SparkSession, folder: str) -> DataFrame:
    return records.work_of(relations(spark, folder)).select("author", F.array_join("works", ",").alias("works"), "n")


@query("""
    WITH h AS (SELECT l_suppkey AS run, l_returnflag AS relation, 'ord:' || l_orderkey AS src, 'part:' || l_partkey AS dst FROM lineitem),
    c AS (SELECT run, string_agg(n || 'x ' || relation, ', ' ORDER BY n DESC, relation) AS followed FROM (SELECT run, relation, count(*) AS n FROM h GROUP BY ALL) GROUP BY run),
    t AS (SELECT run, count(DISTINCT id) AS touched FROM (SELECT run, src AS id FROM h UNION ALL SELECT run, dst FROM h) GROUP BY run)
    SELECT run, followed, touched FROM c JOIN t USING (run)
""")
def walk_summary(spark: SparkSession, folder: str) -> DataFrame:
    hops = table(spark, folder, "lineitem").selectExpr("l_suppkey AS run", "l_returnflag AS relation", "'ord:' || l_orderkey AS src", "'part:' || l_partkey AS dst")
    return records.walk_summary(hops, "run")


_WORDS = "the haouen of thereou and erand onanhe"


@query(f"""
    WITH s AS (SELECT doc_id, {sql.overlap('i', 'q')} AS score FROM (SELECT doc_id, {sql.tokens('text')} AS i, {sql.tokens(chr(39) + _WORDS + chr(39))} AS q FROM documents))
    SELECT doc_id AS id, round(score, 6) AS score FROM s WHERE score > 0 ORDER BY s.score DESC, doc_id LIMIT 7
""")
def example_retrieval(spark: SparkSession, folder: str) -> DataFrame:
    nodes = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")
    links = nodes.select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    return records.examples_for(nodes, links, _WORDS)[0].select("id", F.round("score", 6).alias("score"))


_MORE_STOPS = "['who','what','when','where','which','how','why','repo','repository']"


@query(f"""
    WITH h AS (SELECT source AS origin, doc_id AS seq, list_intersect({sql.tokens(chr(39) + _WORDS + chr(39), _MORE_STOPS)}, {sql.tokens('text')}) AS hits FROM documents)
    SELECT origin, arg_max(seq, (len(hits), -seq)) AS seq, len(list_distinct(flatten(list(hits))))::INTEGER AS held FROM h GROUP BY origin
""")
def best_chunks(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select(F.col("source").alias("origin"), F.col("doc_id").alias("seq"), F.col("text").alias("content"))
    return records.best_chunks(rows, _WORDS).select("origin", "seq", "held")


@query(f"""
    WITH {sql.ENTITY}, near AS MATERIALIZED ({_ALL_NEAR}), asked AS (SELECT s_name AS name FROM supplier UNION ALL SELECT DISTINCT query FROM near),
    named AS (SELECT a.name, e.id FROM asked a JOIN entity e ON lower(a.name) = lower(e.label)),
    best AS (SELECT query AS name, arg_min(id, (-similarity, id)) AS id FROM near WHERE similarity >= 0.3 GROUP BY query)
    SELECT name, id, 'named' AS how FROM named UNION ALL SELECT name, id, 'near' FROM best WHERE name NOT IN (SELECT name FROM named)
""")
def named_seeds(spark: SparkSession, folder: str) -> DataFrame:
    near = retrieval.vector_search_all(embeddings(spark, folder), _questions(spark, folder), 10).select(F.col("query").alias("name"), "id", "similarity")
    asked = table(spark, folder, "supplier").select(F.col("s_name").alias("name")).unionAll(_questions(spark, folder).select(F.col("id").alias("name")))
    return records.named_seeds(asked, entities(spark, folder), near, 0.3)


@query(r"""
    WITH b AS (SELECT ['pr', 'ticket', 'commit', 'review'][doc_id % 4 + 1] AS kind, doc_id, text FROM documents),
    c AS (SELECT kind, kind || ':' || doc_id || ':' || idx AS chunk_id, substr(text, idx * 1050 + 1, 1200) AS content FROM (SELECT *, unnest(range(0, greatest(0, ceil((length(text) - 1200) / 1050.0))::BIGINT + 1)) AS idx FROM b))
    SELECT kind, chunk_id, md5(content) AS digest FROM c WHERE regexp_matches(content, '\S')
""")
def source_bodies(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    parts = [docs.where(F.col("id") % 4 == k) for k in range(4)]
    return records.source_bodies(*parts).select("kind", "chunk_id", F.md5(F.col("content").cast("binary")).alias("digest"))


@query(r"""
    WITH w AS (SELECT doc_id, text, regexp_extract_all(text, '\s*\S+') AS w FROM documents),
    i AS (SELECT doc_id, text, w, unnest(range(0, greatest(0, ceil((len(w) - 90) / 75.0))::BIGINT + 1)) AS idx FROM w WHERE len(w) > 0),
    c AS (SELECT doc_id, text, idx, length(array_to_string(w[1:idx * 75], '')) AS upto, array_to_string(w[idx * 75 + 1:idx * 75 + 90], '') AS content FROM i),
    b AS (SELECT doc_id, text, idx, upto + length(content) - length(regexp_replace(content, '^\s+', '')) AS begin, regexp_replace(content, '^\s+', '') AS content FROM c)
    SELECT 'src/' || doc_id || '.md#L' || (length(regexp_replace(substr(text, 1, begin), '[^\n]', '', 'g')) + 1) || '-L' || (length(regexp_replace(substr(text, 1, begin + length(content)), '[^\n]', '', 'g')) + 1) AS path,
        idx::INTEGER AS idx, md5(content) AS digest FROM b
""")
def source_windows(spark: SparkSession, folder: str) -> DataFrame:
    files = table(spark, folder, "documents").select(F.concat(F.lit("src/"), "doc_id", F.lit(".md")).alias("path"), F.col("text").alias("content"))
    return records.source_windows(files).select("path", "idx", F.md5(F.col("content").cast("binary")).alias("digest"))


@query("""
    WITH p AS (SELECT c_custkey AS user_id, TIMESTAMP '2024-01-10' AS cursor FROM customer), l AS (SELECT user_id, max(CASE WHEN event_type <> 'error' THEN ts END)::TIMESTAMP AS latest FROM events GROUP BY user_id)
    SELECT coalesce(l.user_id, p.user_id) AS user_id, coalesce(latest, cursor) AS cursor FROM l FULL JOIN p ON l.user_id = p.user_id
""")
def cursor_advance(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select("user_id", F.when(F.col("event_type") != "error", F.col("ts").cast("timestamp")).alias("updated_at"))
    before = table(spark, folder, "customer").select(F.col("c_custkey").alias("user_id"), F.lit("2024-01-10").cast("timestamp").alias("cursor"))
    return control.next_cursors(rows, before, "user_id")


@query("SELECT event_type, count(*) AS n FROM events WHERE ts <= TIMESTAMP '2024-01-10' GROUP BY event_type")
def late_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select("event_type", F.col("ts").cast("timestamp").alias("updated_at"))
    return control.late(rows, F.lit("2024-01-10").cast("timestamp")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT count(*) AS n FROM ({_BURSTS}) WHERE deadline > (SELECT max(epoch_us(ts)) FROM events) - {6 * _HOUR}")
def pending_bursts(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select(F.col("user_id").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    now = rows.agg(F.max("t")).first()[0] or 0
    return debounce.pending(debounce.bursts(rows, 6 * _HOUR, 24 * _HOUR), F.lit(now - 6 * _HOUR))
