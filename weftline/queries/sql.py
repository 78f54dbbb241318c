"""SQL of the graph view, shared by the queries' counterparts."""

ENTITY = """
    entity AS (
        SELECT 'cust:' || c_custkey AS id, c_name AS label, 'Person' AS type, NULL::TIMESTAMP AS ts FROM customer
        UNION ALL SELECT 'ord:' || o_orderkey, 'order ' || o_orderkey, 'PR', o_orderdate::TIMESTAMP FROM orders
        UNION ALL SELECT 'part:' || p_partkey, p_name, 'File', NULL FROM part
        UNION ALL SELECT 'supp:' || s_suppkey, s_name, 'Service', NULL FROM supplier
        UNION ALL SELECT 'nation:' || n_nationkey, n_name, 'Repo', NULL FROM nation
        UNION ALL SELECT 'ev:' || event_id, 'error ' || event_id, 'Ticket', ts::TIMESTAMP FROM events WHERE event_type = 'error'
    )"""

EDGES = """
    edges AS MATERIALIZED (
        SELECT 'cust:' || o_custkey AS src, 'ord:' || o_orderkey AS dst, 'AUTHORED' AS relation, 0.95::DOUBLE AS confidence FROM orders
        UNION ALL SELECT DISTINCT 'ord:' || l_orderkey, 'part:' || l_partkey, 'TOUCHES', 0.80::DOUBLE FROM lineitem
        UNION ALL SELECT DISTINCT 'supp:' || l_suppkey, 'ord:' || l_orderkey, 'REVIEWED', 0.85::DOUBLE FROM lineitem
        UNION ALL SELECT 'cust:' || c_custkey, 'nation:' || c_nationkey, 'PART_OF', 0.80::DOUBLE FROM customer
        UNION ALL SELECT 'supp:' || s_suppkey, 'nation:' || s_nationkey, 'PART_OF', 0.80::DOUBLE FROM supplier
        UNION ALL SELECT 'cust:' || user_id, 'ev:' || event_id, 'REPORTED', 0.75::DOUBLE FROM events WHERE event_type = 'error'
    ), both_ways AS MATERIALIZED (
        SELECT src AS origin, dst AS id, relation, confidence FROM edges
        UNION ALL SELECT dst, src, relation, confidence FROM edges WHERE src <> dst
    )"""

GRAPH = f"{ENTITY}, {EDGES}"


def frontier(name: str, front: str, k: int, degree: int) -> str:
    """CTEs that expand ``front`` (origin, carried)."""
    order = "confidence DESC, ts DESC NULLS LAST, id"
    return f"""
    {name}_near AS (SELECT f.origin, f.carried, b.id, b.relation, b.confidence, e.ts FROM {front} f JOIN both_ways b USING (origin) JOIN entity e ON e.id = b.id),
    {name}_cap AS (SELECT * FROM {name}_near QUALIFY dense_rank() OVER (PARTITION BY origin, relation ORDER BY {order}) <= {degree}),
    {name} AS (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY {order}, relation) AS rank FROM {name}_cap QUALIFY rank <= {k})"""


def walk(seeds: str) -> str:
    """CTEs of the two-hop best-path walk: ``hits`` (id, score, hops)."""
    return f"""
    f0 AS (SELECT id AS origin, 1.0::DOUBLE AS carried FROM {seeds}),
    {frontier("h1", "f0", 10, 10)},
    r1 AS (SELECT id, max(carried * confidence) AS found FROM h1 GROUP BY id),
    b1 AS (SELECT coalesce(s.id, r.id) AS id, CASE WHEN r.found > coalesce(s.score, 0) THEN r.found ELSE s.score END AS score,
        CASE WHEN r.found > coalesce(s.score, 0) THEN 1 ELSE 0 END AS hops, coalesce(r.found > coalesce(s.score, 0), false) AS better
        FROM (SELECT id, 1.0::DOUBLE AS score FROM {seeds}) s FULL JOIN r1 r ON s.id = r.id),
    f1 AS (SELECT id AS origin, score AS carried FROM b1 WHERE better),
    {frontier("h2", "f1", 10, 10)},
    r2 AS (SELECT id, max(carried * confidence) AS found FROM h2 GROUP BY id),
    b2 AS (SELECT coalesce(b.id, r.id) AS id, CASE WHEN r.found > coalesce(b.score, 0) THEN r.found ELSE b.score END AS score,
        CASE WHEN r.found > coalesce(b.score, 0) THEN 2 ELSE b.hops END AS hops FROM b1 b FULL JOIN r2 r ON b.id = r.id),
    hits AS (SELECT * FROM b2 WHERE id NOT IN (SELECT id FROM {seeds}) ORDER BY score DESC, id LIMIT 10)"""


def router(seeds: str) -> str:
    """CTEs of the two-hop router walk: ``routed`` (id, score)."""
    per = lambda n: f"""seen{n} AS (SELECT h.id, h.carried * h.confidence AS s, f.place * 1000 + h.rank AS turn FROM g{n} h JOIN front{n} f USING (origin)),
    per{n} AS (SELECT id, max(s) AS s, arg_min(s, turn) AS carried, min(turn) AS place FROM seen{n} GROUP BY id)"""  # noqa: E731
    return f"""
    front1 AS (SELECT id AS origin, 1.0::DOUBLE AS carried, row_number() OVER (ORDER BY id) AS place FROM {seeds}),
    {frontier("g1", "front1", 5, 10)}, {per(1)},
    score1 AS (SELECT id, greatest(a.score, b.s) AS score FROM (SELECT id, 1.0::DOUBLE AS score FROM {seeds}) a FULL JOIN per1 b USING (id)),
    front2 AS (SELECT id AS origin, carried, place FROM per1 WHERE id NOT IN (SELECT id FROM {seeds})),
    {frontier("g2", "front2", 5, 10)}, {per(2)},
    routed AS (SELECT id, greatest(a.score, b.s) AS score FROM score1 a FULL JOIN per2 b USING (id))"""


def impact(seed: str) -> str:
    """CTEs of the three-ring impact walk: ``impacted`` (id, hops, confidence)."""
    ring = lambda n, k, degree: f"""{frontier(f"i{n}", f"ring{n}", k, degree)},
    sight{n} AS (SELECT id, carried * confidence AS confidence, {n} AS hops FROM i{n})"""  # noqa: E731
    return f"""
    ring1 AS (SELECT id AS origin, 1.0::DOUBLE AS carried FROM {seed}), {ring(1, 200, 200)},
    new1 AS (SELECT id, max(confidence) AS carried FROM sight1 WHERE id NOT IN (SELECT id FROM {seed}) GROUP BY id HAVING max(confidence) > 0),
    ring2 AS (SELECT id AS origin, carried FROM new1), {ring(2, 25, 10)},
    new2 AS (SELECT id, max(confidence) AS carried FROM sight2 WHERE id NOT IN (SELECT id FROM {seed}) AND id NOT IN (SELECT id FROM new1) GROUP BY id HAVING max(confidence) > 0),
    ring3 AS (SELECT id AS origin, carried FROM new2), {ring(3, 25, 10)},
    impacted AS (SELECT id, arg_max(hops, (confidence, -hops)) AS hops, round(max(confidence), 4) AS confidence FROM (SELECT * FROM sight1 UNION ALL SELECT * FROM sight2 UNION ALL SELECT * FROM sight3)
        GROUP BY id ORDER BY confidence DESC, hops, id LIMIT 50)"""


def decay(ts: str, kind: str, now: str) -> str:
    half = f"""CASE {kind} WHEN 'Ticket' THEN 21.0 WHEN 'PR' THEN 60.0 WHEN 'File' THEN 120.0 WHEN 'Person' THEN 180.0 WHEN 'Service' THEN 365.0 WHEN 'Repo' THEN 365.0
        ELSE 90.0 END::DOUBLE"""
    age = f"greatest(0.0::DOUBLE, (epoch_us({now}) - epoch_us({ts}))::DOUBLE / 1e6 / 86400.0)"
    return f"CASE WHEN {ts} IS NULL OR epoch_us({ts}) = 0 THEN 1.0::DOUBLE ELSE greatest(0.35::DOUBLE, power(0.5::DOUBLE, {age} / {half})) END"


STOP = "['the','and','for','that','this','with','from','was','were','are','has','have','not','but','its','also','into','over','after']"


def tokens(text: str, more: str = "[]") -> str:
    return f"list_filter(list_distinct(regexp_extract_all(lower({text}), '[a-z0-9#][a-z0-9_#-]{{2,}}')), lambda w: NOT list_contains(list_concat({STOP}, {more}::VARCHAR[]), w))"


def overlap(item: str, answer: str) -> str:
    return f"CASE WHEN len({item}) = 0 OR len({answer}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({item}, {answer}))::DOUBLE / len({item}) END"
