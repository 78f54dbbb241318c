"""Text rules, chunks, overlaps and traces over the document and conversation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as rules
from weftline.operators import documents, traces
from weftline.operators import entities as named
from weftline.plans import mentions
from weftline.queries import query, sql
from weftline.sources.graph import table


@query(f"SELECT doc_id, len({sql.tokens('text')}) AS n_tokens FROM documents")
def tokenize_counts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.size(rules.tokens(F.col("text"))).cast("long").alias("n_tokens"))


_PAIRS = "SELECT a.conv_id, a.turn, a.text AS question, b.text AS answer FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Each turn with the next one of its conversation."""
    turns = table(spark, folder, "conversations")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return turns.select("conv_id", "turn", F.col("text").alias("question")).join(after, ["conv_id", "turn"])


_SCORED = f"""
    SELECT conv_id, turn, {sql.overlap('q', 'a')} AS overlap FROM (SELECT conv_id, turn, {sql.tokens('question')} AS q, {sql.tokens('answer')} AS a FROM ({_PAIRS}))
"""


@query(f"SELECT conv_id, turn, round(overlap, 6) AS overlap FROM ({_SCORED})")
def overlap_score(spark: SparkSession, folder: str) -> DataFrame:
    score = rules.overlap(rules.tokens(F.col("question")), rules.tokens(F.col("answer")))
    return _pairs(spark, folder).select("conv_id", "turn", F.round(score, 6).alias("overlap"))


def _flat(spark: SparkSession, folder: str) -> DataFrame:
    """Every turn as an item whose answer is the next turn; the last turns have none."""
    turns = table(spark, folder, "conversations")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return turns.join(after, ["conv_id", "turn"], "left").select("conv_id", "turn", F.col("text").alias("content"), "answer")


_MEASURED = f"""
    SELECT conv_id, turn, CASE WHEN trim(coalesce(answer, '')) <> '' THEN {sql.overlap('q', 'a')} END AS overlap FROM (
        SELECT t.conv_id, t.turn, n.text AS answer, {sql.tokens('t.text')} AS q, {sql.tokens('n.text')} AS a
        FROM conversations t LEFT JOIN conversations n ON n.conv_id = t.conv_id AND n.turn = t.turn + 1)
"""


@query(f"""
    SELECT conv_id, turn, round(overlap, 6) AS overlap, overlap >= 0.2 AS used,
        CASE WHEN overlap IS NULL THEN 'unclassified' WHEN overlap >= 0.2 THEN 'used' ELSE 'ignored' END AS fate FROM ({_MEASURED})
""")
def used_ignored(spark: SparkSession, folder: str) -> DataFrame:
    scored = traces.measured(_flat(spark, folder))
    return scored.select("conv_id", "turn", F.round("overlap", 6).alias("overlap"), "used", rules.fate(F.col("overlap"), 0.2).alias("fate"))


@query(f"SELECT conv_id, count(*) AS n_items, count(*) FILTER (overlap >= 0.2) AS n_used, coalesce(round(avg(overlap), 3), 0) AS mean_overlap FROM ({_MEASURED}) GROUP BY conv_id")
def used_summary(spark: SparkSession, folder: str) -> DataFrame:
    return traces.summary(traces.measured(_flat(spark, folder)), "conv_id")


_SLUG = "coalesce(nullif(trim(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'x')"


@query(f"SELECT p_partkey, {_SLUG.format('p_name')} AS slug, 'entity:' || {_SLUG.format('p_type')} || ':' || {_SLUG.format('p_name')} AS node_id FROM part")
def slugify(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select("p_partkey", rules.slug(F.col("p_name")).alias("slug"), rules.entity_node_id(F.col("p_type"), F.col("p_name")).alias("node_id"))


def _put(snippet: str) -> str:
    """A snippet inside the text of a turn, at a place that differs from turn to turn."""
    return f"substr(text, 1, cast(conv_id % 40 AS int)) || ' ' || ({snippet}) || ' ' || substr(text, cast(conv_id % 40 AS int) + 1)"


_SAID = _put("""
    CASE turn % 6 WHEN 0 THEN 'Fixes #' || conv_id || ', closes: #' || turn WHEN 1 THEN 'prefix #' || conv_id || ' RESOLVED  #' || conv_id WHEN 2 THEN 'closed #' || turn || ' see #3'
    WHEN 3 THEN 'fix: #' || turn || ' fix #' || turn || ' Fixed #' || conv_id WHEN 4 THEN 'affix#9 resolves#' || conv_id ELSE 'nothing of the kind' END
""")
_MENTIONED = _put("""
    CASE turn % 7 WHEN 0 THEN 'PR #' || conv_id || ', pull request ' || turn WHEN 1 THEN 'issue #' || (conv_id + 40) || ' and #' || (turn + 100) || ' or #7'
    WHEN 2 THEN 'payment_service (self-service), order-svc' WHEN 3 THEN 'pr' || conv_id || '-service and page#42, ##12' WHEN 4 THEN 'PR#' || turn || ' PR#' || turn || ' then issues  #' || conv_id
    WHEN 5 THEN 'Pull-Requests 55 on a_b_svc; micro_SVC' ELSE 'plain' END
""")
_LINKED = _put("""
    CASE turn % 6 WHEN 0 THEN '<a href="https://github.com/acme/tools/pull/' || turn || '">#' || conv_id || '</a> and #' || (turn + 50) WHEN 1 THEN '<a href="https://x.y/1">#6</a> #' || conv_id
    WHEN 2 THEN 'github.com/Acme/Tools/pull/' || conv_id || ' other/repo#3 acme/tools#' || turn WHEN 3 THEN 'a#1 x/#2 acme/tools#' || conv_id || ' #' || conv_id || ' #' || turn
    WHEN 4 THEN 'https://github.com/acme/other/issues/' || turn || ' #' || (turn + 1) ELSE 'plain' END
""")


def _turns(spark: SparkSession, folder: str, content: str) -> DataFrame:
    return table(spark, folder, "conversations").select("conv_id", "turn", F.concat_ws(":", F.lit("conv"), "conv_id", "turn").alias("doc"), F.expr(content).alias("content"))


@query(rf"""
    SELECT conv_id, turn, array_to_string(list_sort(list_distinct(regexp_extract_all({_SAID}, '(?i)\b(?:close[sd]?|fix(?:e[sd])?|resolve[sd]?)\s*:?\s*#(\d+)', 1))), ',') AS numbers FROM conversations
""")
def closing_refs_strict(spark: SparkSession, folder: str) -> DataFrame:
    numbers = F.array_sort(rules.closing_numbers(F.col("content")).cast("array<string>"))
    return _turns(spark, folder, _SAID).select("conv_id", "turn", F.array_join(numbers, ",").alias("numbers"))


@query(rf"""
    SELECT conv_id, turn, array_to_string(list_sort(list_distinct(regexp_extract_all({_SAID}, '(?i)(?:fix(?:e[sd])?|close[sd]?|resolve[sd]?)\s+#(\d+)', 1))), ',') AS numbers FROM conversations
""")
def closing_refs_loose(spark: SparkSession, folder: str) -> DataFrame:
    numbers = F.array_sort(rules.closing_numbers(F.col("content"), rules.CLOSING_LOOSE).cast("array<string>"))
    return _turns(spark, folder, _SAID).select("conv_id", "turn", F.array_join(numbers, ",").alias("numbers"))


@query(r"""
    WITH f AS (SELECT doc_id, trim(regexp_extract(trim(coalesce(nullif(text, ''), 'doc:' || doc_id)), '^[^\r\n]*')) AS line FROM documents)
    SELECT doc_id, CASE WHEN line = '' THEN 'doc:' || doc_id WHEN length(line) > 200 THEN rtrim(substr(line, 1, 199)) || '…' ELSE line END AS label FROM f
""")
def node_label(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", rules.node_label(F.concat(F.lit("doc:"), "doc_id"), F.col("text")).alias("label"))


_RELATIONAL = "['who','whom','whose','which','what caused','caused by','because of','related to','connected to','depends on','owns','owned by','between','path from','linked to','responsible for','which pr','which ticket']"
_SEMANTIC = "['explain','architecture','overview','summary','summarise','summarize','describe','what is','how does','concept','definition','purpose of']"


@query(f"""
    WITH m AS (SELECT conv_id, turn, text, list_filter({_RELATIONAL}, lambda m: contains(lower(text), m))[1] AS r, list_filter({_SEMANTIC}, lambda m: contains(lower(text), m))[1] AS s FROM conversations)
    SELECT conv_id, turn, CASE WHEN trim(text) <> '' AND r IS NOT NULL THEN 'relational' ELSE 'semantic' END AS intent,
        CASE WHEN trim(text) <> '' AND (r IS NOT NULL OR s IS NOT NULL) THEN 'marker' ELSE 'fallback' END AS stage, CASE WHEN trim(text) <> '' THEN coalesce(r, s) END AS marker FROM m
""")
def intent_markers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations").select("conv_id", "turn", rules.intent(F.col("text")).alias("i")).select("conv_id", "turn", "i.intent", "i.stage", "i.marker")


@query(r"""
    WITH c AS (SELECT doc_id, idx, substr(text, idx * 1050 + 1, 1200) AS content
        FROM (SELECT doc_id, text, unnest(range(0, greatest(0, ceil((length(text) - 1200) / 1050.0))::BIGINT + 1)) AS idx FROM documents))
    SELECT 'doc:' || doc_id || ':' || idx AS chunk_id, length(content) AS size, md5(content) AS digest FROM c WHERE regexp_matches(content, '\S')
""")
def char_chunks(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select(F.concat(F.lit("doc:"), "doc_id").alias("base"), F.col("text").alias("content"))
    return documents.char_chunks(rows).select("chunk_id", F.length("content").cast("long").alias("size"), F.md5(F.col("content").cast("binary")).alias("digest"))


@query(r"""
    WITH w AS (SELECT doc_id, regexp_extract_all(text, '\s*\S+') AS w FROM documents),
    i AS (SELECT doc_id, w, unnest(range(0, greatest(0, ceil((len(w) - 300) / 250.0))::BIGINT + 1)) AS idx FROM w WHERE len(w) > 0),
    c AS (SELECT doc_id, idx, length(array_to_string(w[1:idx * 250], '')) AS upto, array_to_string(w[idx * 250 + 1:idx * 250 + 300], '') AS content FROM i),
    b AS (SELECT doc_id, idx, upto + length(content) - length(regexp_replace(content, '^\s+', '')) AS begin, regexp_replace(content, '^\s+', '') AS content FROM c)
    SELECT 'doc:' || doc_id AS base, idx::INTEGER AS idx, begin::INTEGER AS begin, (begin + length(content))::INTEGER AS finish, md5(content) AS digest FROM b
""")
def word_windows(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select(F.concat(F.lit("doc:"), "doc_id").alias("base"), F.col("text").alias("content"))
    return documents.word_windows(rows).select("base", "idx", "begin", "finish", F.md5(F.col("content").cast("binary")).alias("digest"))


def _found_sql(name: str, pattern: str, kind: str, turn: int, more: str = "true") -> str:
    """CTE of a pattern's matches with their places. What DuckDB's patterns can't look back at is asked of the character before."""
    return rf"""
    {name}_all AS (SELECT doc, content, unnest(regexp_extract_all(content, '{pattern}')) AS text, unnest(range(len(regexp_extract_all(content, '{pattern}')))) AS place,
        unnest((string_split_regex(content, '{pattern}'))[:-2]) AS before FROM t),
    {name}_at AS (SELECT doc, content, text, sum(length(before) + length(text)) OVER (PARTITION BY doc ORDER BY place) AS "end" FROM {name}_all),
    {name} AS (SELECT doc, text, '{kind}' AS type, {turn} AS turn, "end" - length(text) AS start, "end" FROM {name}_at WHERE length(text) >= 3 AND {more})"""


_PAIR = r"[A-Z][a-z]+ [a-z]+"


def _capitalised(windows: DataFrame) -> DataFrame:
    """Stands for a model: a word that begins with a capital letter, and the word after it."""
    return named.matches(windows.select("base", "idx", "content"), "content", _PAIR).select("base", "idx", F.col("found").alias("text"), F.lit("Name").alias("type"), "start", "end")


_RULED = rf"""
    {_found_sql("a", r"(?i)\b(?:PR|pull[ -]?requests?)\s*#?\d+\b", "PR", 0)},
    {_found_sql("b", r"(?i)(?:\bissues?\s+)?#\d+\b", "Ticket", 1, r"(text[1] <> '#' OR NOT regexp_matches(substr(content, ('end' || '')::VARCHAR::INTEGER, 1), '[\w#]'))")},
    {_found_sql("c", r"(?i)\b[a-z][a-z0-9]*(?:[_-][a-z0-9]+)*[_-](?:service|svc)\b", "Service", 2, "NOT regexp_matches(text, '(?i)^(self|customer|micro|full|in|out)[_-](service|svc)$')")},
    b2 AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.doc = b.doc AND a.start < b."end" AND b.start < a."end")),
    ab AS (SELECT * FROM a UNION ALL SELECT * FROM b2),
    c2 AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM ab WHERE ab.doc = c.doc AND ab.start < c."end" AND c.start < ab."end")),
    ruled AS (SELECT * FROM ab UNION ALL SELECT * FROM c2)
""".replace("('end' || '')::VARCHAR::INTEGER", '("end" - length(text))::INTEGER')


@query(rf"""
    WITH t AS (SELECT 'doc:' || doc_id AS doc, text AS content FROM documents), {_RULED}, {_found_sql("m", _PAIR, "Name", 3)},
    found AS (SELECT doc, text, type, start FROM ruled UNION ALL SELECT doc, text, type, start FROM m WHERE NOT EXISTS (SELECT 1 FROM ruled r WHERE r.doc = m.doc AND r.start < m."end" AND m.start < r."end")),
    keyed AS (SELECT *, CASE WHEN type IN ('PR', 'Ticket') THEN text ELSE lower(text) END AS k FROM found),
    names AS (SELECT type, k, min(struct_pack(doc := doc, start := start, text := text)) AS f FROM keyed GROUP BY type, k),
    ids AS (SELECT type, k, f.text AS label, f, lower(type) || ':' || CASE WHEN type IN ('PR', 'Ticket') THEN regexp_extract(f.text, '(\d+)', 1) ELSE k END AS id FROM names),
    counts AS (SELECT id, count(DISTINCT doc) AS documents FROM keyed JOIN ids USING (type, k) GROUP BY id)
    SELECT id, arg_min(label, f) AS label, any_value(type) AS type, any_value(documents) AS documents FROM ids JOIN counts USING (id) GROUP BY id
""")
def document_mentions(spark: SparkSession, folder: str) -> DataFrame:
    """Entities of all documents, found by rules in whole texts and by a model in windows, and in how many documents each is mentioned."""
    rows = table(spark, folder, "documents").select(F.concat(F.lit("doc:"), "doc_id").alias("doc"), F.col("text").alias("content"))
    made = mentions.document_mentions(rows, _capitalised)
    counts = made["mentions"].groupBy(F.col("entity").alias("id")).agg(F.count(F.lit(1)).alias("documents"))
    return made["entity"].join(counts, "id").select("id", "label", "type", "documents")


@query(rf"""
    WITH t AS (SELECT 'conv:' || conv_id || ':' || turn AS doc, {_MENTIONED} AS content FROM conversations),
    {_found_sql("a", r"(?i)\b(?:PR|pull[ -]?requests?)\s*#?\d+\b", "PR", 0)},
    {_found_sql("b", r"(?i)(?:\bissues?\s+)?#\d+\b", "Ticket", 1, r"(text[1] <> '#' OR NOT regexp_matches(substr(content, ('end' || '')::VARCHAR::INTEGER, 1), '[\w#]'))")},
    {_found_sql("c", r"(?i)\b[a-z][a-z0-9]*(?:[_-][a-z0-9]+)*[_-](?:service|svc)\b", "Service", 2, "NOT regexp_matches(text, '(?i)^(self|customer|micro|full|in|out)[_-](service|svc)$')")},
    b2 AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.doc = b.doc AND a.start < b."end" AND b.start < a."end")),
    ab AS (SELECT * FROM a UNION ALL SELECT * FROM b2),
    c2 AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM ab WHERE ab.doc = c.doc AND ab.start < c."end" AND c.start < ab."end"))
    SELECT doc, text, type, min(start)::INTEGER AS start, arg_min("end", start)::INTEGER AS "end", 1.0::DOUBLE AS score FROM (SELECT * FROM ab UNION ALL SELECT * FROM c2) GROUP BY doc, text, type
""".replace("('end' || '')::VARCHAR::INTEGER", '("end" - length(text))::INTEGER'))
def rule_entities(spark: SparkSession, folder: str) -> DataFrame:
    return named.extract_entities(_turns(spark, folder, _MENTIONED))


_URL = r"(?i)(?:github\.com|github-redirect\.dependabot\.com)/([\w.-]+)/([\w.-]+)/(?:issues|pull)/(\d+)"
_ANCHOR = r"""(?i)<a\b[^>]*\bhref=["'']([^"'']*)["''][^>]*>\s*#(\d+)\s*</a>"""


def _own_sql(text: str, pattern: str, shift: int = 0) -> str:
    """Numbers that a pattern of owner, name and number gives acme/tools."""
    part = [f"regexp_extract_all({text}, '{pattern}', {k + shift})" for k in (1, 2, 3)]
    return f"list_transform(list_filter(list_zip({', '.join(part)}), lambda x: lower(x[1] || '/' || x[2]) = 'acme/tools'), lambda x: x[3])"


@query(rf"""
    WITH t AS (SELECT 'conv:' || conv_id || ':' || turn AS doc, {_LINKED} AS content FROM conversations),
    l AS (SELECT doc, content, list_transform(list_filter(list_zip(regexp_extract_all(content, '{_ANCHOR}', 1), regexp_extract_all(content, '{_ANCHOR}', 2)),
        lambda x: lower(regexp_extract(x[1], '{_URL}', 1) || '/' || regexp_extract(x[1], '{_URL}', 2)) = 'acme/tools'), lambda x: x[2]) AS n1, regexp_replace(content, '{_ANCHOR}', ' ', 'g') AS left1 FROM t),
    u AS (SELECT *, {_own_sql("left1", _URL)} AS n2, regexp_replace(left1, '{_URL}', ' ', 'g') AS left2 FROM l),
    q AS (SELECT *, {_own_sql("left2", r"(^|[^\w./-])([\w.-]+)/([\w.-]+)#(\d+)\b", 1)} AS n3, regexp_replace(left2, '(^|[^\w./-])([\w.-]+)/([\w.-]+)#(\d+)\b', ' ', 'g') AS left3 FROM u),
    f AS (SELECT doc, list_concat(list_concat(n1, n2), list_concat(n3, regexp_extract_all(left3, '(^|[^\w/#&])#(\d+)\b', 2))) AS n FROM q)
    SELECT doc, array_to_string(list_filter(n, lambda x, i: list_position(n, x) = i), ',') AS numbers FROM f
""")
def repo_references(spark: SparkSession, folder: str) -> DataFrame:
    return named.references(_turns(spark, folder, _LINKED), "Acme/Tools").select("doc", F.array_join("numbers", ",").alias("numbers"))


@query("SELECT item_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))[1:120]) AS digest, length(trim(regexp_replace(text, '\\s+', ' ', 'g'))[1:120]) AS size FROM benchmark")
def excerpts(spark: SparkSession, folder: str) -> DataFrame:
    line = rules.one_line(F.col("text"), 120)
    return table(spark, folder, "benchmark").select("item_id", F.md5(line.cast("binary")).alias("digest"), F.length(line).cast("long").alias("size"))


@query(r"SELECT page_id, len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS n_links, len(list_filter(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1), lambda u: regexp_matches(u, '^https?://'))) AS n_safe FROM pages")
def html_links(spark: SparkSession, folder: str) -> DataFrame:
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return table(spark, folder, "pages").select("page_id", F.size(links).cast("long").alias("n_links"), F.size(F.filter(links, rules.safe_url)).cast("long").alias("n_safe"))


@query(r"SELECT page_id, length(regexp_replace(html, '(?s)<!--.*?(?:-->|\z)', ' ', 'g')) AS size, md5(regexp_replace(html, '(?s)<!--.*?(?:-->|\z)', ' ', 'g')) AS digest FROM pages")
def strip_comments(spark: SparkSession, folder: str) -> DataFrame:
    plain = rules.without_comments(F.col("html"))
    return table(spark, folder, "pages").select("page_id", F.length(plain).cast("long").alias("size"), F.md5(plain.cast("binary")).alias("digest"))


@query(r"SELECT page_id, regexp_matches(url, '(?i)^https?://') AS safe FROM pages")
def safe_urls(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", rules.safe_url(F.col("url")).alias("safe"))


def _spans(spark: SparkSession, folder: str) -> DataFrame:
    """Turns as spans of their conversation: each is a child of turn / 2; every third conversation lacks its first span."""
    rows = table(spark, folder, "conversations").where("NOT (conv_id % 3 = 0 AND turn = 0)")
    return rows.select(F.col("conv_id").alias("run"), F.col("turn").cast("string").alias("id"), F.when(F.col("turn") > 0, F.floor(F.col("turn") / 2).cast("string")).alias("parent_id"), F.when(F.col("turn") % 4 != 3, F.col("turn") * 10.0).alias("start_ms"), (F.col("turn") * 10.0 + F.length("text")).alias("end_ms"))


_SPAN_SQL = """
    s AS (SELECT conv_id AS run, turn::VARCHAR AS id, CASE WHEN turn > 0 THEN (turn // 2)::VARCHAR END AS parent_id, CASE WHEN turn % 4 <> 3 THEN turn * 10.0::DOUBLE END AS start_ms,
        turn * 10.0::DOUBLE + length(text) AS end_ms FROM conversations WHERE NOT (conv_id % 3 = 0 AND turn = 0))
"""


@query(f"""
    WITH RECURSIVE {_SPAN_SQL}, d AS (
        SELECT s.run, s.id, 0 AS depth FROM s WHERE NOT EXISTS (SELECT 1 FROM s p WHERE p.run = s.run AND p.id = s.parent_id)
        UNION ALL SELECT s.run, s.id, d.depth + 1 FROM s JOIN d ON d.run = s.run AND d.id = s.parent_id
    ) SELECT run, id, depth FROM d
""")
def span_depth(spark: SparkSession, folder: str) -> DataFrame:
    return traces.span_depths(_spans(spark, folder).select("run", "id", "parent_id"))


@query(f"WITH {_SPAN_SQL} SELECT run, id, (row_number() OVER (PARTITION BY run ORDER BY coalesce(start_ms, 0), id) - 1)::INTEGER AS step, round(end_ms - start_ms, 1) AS duration_ms FROM s")
def trace_steps(spark: SparkSession, folder: str) -> DataFrame:
    return traces.steps(_spans(spark, folder)).select("run", "id", "step", "duration_ms")


def _traces(spark: SparkSession, folder: str) -> DataFrame:
    """A trace for each conversation, in the forms of version 1 (flat, old edge names) and version 4 by turns."""
    turns = table(spark, folder, "conversations")
    item = F.struct(F.concat(F.lit("i"), F.col("turn") % 3).alias("id"), F.lit(None).cast("string").alias("label"), F.col("role").alias("kind"), F.col("text").alias("content"), F.lit("x").alias("source"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("double").alias("overlap"))
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", item.alias("item")))).alias("t"), F.max_by("text", "turn").alias("answer"))
    rows = rows.withColumn("its", F.col("t.item"))
    edge = F.array(F.struct(F.lit("i0").alias("source"), F.lit("i1").alias("target"), F.lit(None).cast("string").alias("relation"), F.lit("LINKS").alias("type"), F.lit(None).cast("double").alias("weight"), F.lit(0.5).alias("confidence")))
    flat = F.col("conv_id") % 2 == 0
    nested = F.array(F.struct(F.lit("q").alias("query"), F.lit("graph").alias("arm"), F.col("its").alias("items"), edge.alias("edges")))
    return traces.upgraded(rows.select("conv_id", F.when(flat, 1).otherwise(4).alias("schema_version"), F.lit("q").alias("query"), "answer", F.lit("vector").alias("arm"), F.when(flat, F.col("its")).alias("items"), F.when(flat, edge).alias("edges"), F.when(~flat, nested).alias("retrievals")))


@query("SELECT conv_id, 0 AS r, turn - min(turn) OVER (PARTITION BY conv_id) AS i, 'i' || (turn % 3) AS id, md5(text) AS digest FROM conversations")
def trace_flatten(spark: SparkSession, folder: str) -> DataFrame:
    flat = traces.items(_traces(spark, folder), "conv_id")
    return flat.select("conv_id", "r", F.col("i").cast("long").alias("i"), "id", F.md5(F.col("content").cast("binary")).alias("digest"))


@query("SELECT DISTINCT conv_id, CASE WHEN conv_id % 2 = 0 THEN 1 ELSE 4 END AS schema_version, CASE WHEN conv_id % 2 = 0 THEN 'vector' ELSE 'graph' END AS arm, 'LINKS' AS relation, 0.5::DOUBLE AS weight FROM conversations")
def trace_upgrade(spark: SparkSession, folder: str) -> DataFrame:
    edge = F.get("retrievals", F.lit(0))["edges"]
    return _traces(spark, folder).select("conv_id", "schema_version", traces.arm().alias("arm"), F.get(edge, F.lit(0))["relation"].alias("relation"), F.get(edge, F.lit(0))["weight"].alias("weight"))


@query(f"""
    WITH t AS (SELECT conv_id, turn, 'i' || (turn % 3) AS id, text, first_value(text) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS answer FROM conversations),
    n AS (SELECT conv_id, id, {sql.overlap('q', 'a')} >= 0.2 AS active FROM (SELECT conv_id, id, turn, {sql.tokens('text')} AS q, {sql.tokens('answer')} AS a FROM t QUALIFY row_number() OVER (PARTITION BY conv_id, id ORDER BY turn) = 1))
    SELECT a.conv_id, 'i0' AS source, 'i1' AS target, 'LINKS' AS relation, 0.5::DOUBLE AS confidence, a.active AND b.active AS active FROM n a JOIN n b USING (conv_id) WHERE a.id = 'i0' AND b.id = 'i1'
""")
def trace_canvas(spark: SparkSession, folder: str) -> DataFrame:
    all_traces = _traces(spark, folder)
    nodes = traces.measured(traces.first_items(traces.items(all_traces, "conv_id"), "conv_id")).select("conv_id", "id", F.coalesce("used", F.lit(True)).alias("active"))
    edges = all_traces.select("conv_id", F.explode("retrievals").alias("r")).select("conv_id", F.explode("r.edges").alias("e")).select("conv_id", "e.*").distinct()
    return traces.canvas_edges(edges, nodes, "conv_id")
