"""Bounded scans, snapshot digests and trace files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import scan, traces
from weftline.queries import query, sql
from weftline.queries.text import _MEASURED, _flat
from weftline.sources.graph import table

_ASKED = "where is src7 handled in lang de"
_ASKED_TOKENS = sql.tokens("'" + _ASKED + "'", "['who','what','when','where','which','how','why','repo','repository']")


@query(f"""
    WITH f AS (SELECT doc_id, source || '/lang ' || lang || '/' || doc_id || '.md' AS path, length(text) AS size FROM documents),
    s AS (SELECT *, len(list_intersect({_ASKED_TOKENS}, {sql.tokens("regexp_replace(path, '[/._]', ' ', 'g')")})) AS share FROM f ORDER BY share DESC, path LIMIT 20)
    SELECT path, share::INTEGER AS share, upto::BIGINT AS upto FROM (SELECT *, sum(size) OVER (ORDER BY share DESC, path) AS upto FROM s) WHERE upto <= 40000
""")
def bounded_sources(spark: SparkSession, folder: str) -> DataFrame:
    path = F.concat("source", F.lit("/lang "), "lang", F.lit("/"), "doc_id", F.lit(".md"))
    files = table(spark, folder, "documents").select(path.alias("path"), F.length("text").alias("size"))
    return scan.best_files(files, F.lit(_ASKED), 20, 40_000).select("path", "share", F.col("upto").cast("long").alias("upto"))


@query("""
    WITH t AS (SELECT '{"o_orderkey":' || o_orderkey || ',"o_custkey":' || o_custkey || ',"o_orderstatus":"' || o_orderstatus || '"}' AS text FROM orders)
    SELECT count(*) AS n, sum(('0x' || substr(sha256(text), 1, 12))::BIGINT)::VARCHAR AS digest FROM t
""")
def snapshot_checksum(spark: SparkSession, folder: str) -> DataFrame:
    return scan.checksum(table(spark, folder, "orders"), "o_orderkey", "o_custkey", "o_orderstatus").withColumn("digest", F.col("digest").cast("string"))


_FILE_SLUG = "regexp_replace(substr(trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-'), 1, 60), '-+$', '')"


@query(f"SELECT conv_id, turn, strftime(TIMESTAMP '2024-01-01' + INTERVAL 1 SECOND * (conv_id * 7 + turn), '%Y%m%dT%H%M%S') || '-' || coalesce(nullif({_FILE_SLUG}, ''), 'query') || '.json' AS name FROM conversations")
def trace_filename(spark: SparkSession, folder: str) -> DataFrame:
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("conv_id") * 7 + F.col("turn"))
    return table(spark, folder, "conversations").select("conv_id", "turn", traces.file_name(F.col("text"), at).alias("name"))


@query(f"""
    WITH s AS (SELECT m.conv_id, m.turn, m.overlap, c.text FROM ({_MEASURED}) m JOIN conversations c ON c.conv_id = m.conv_id AND c.turn = m.turn)
    SELECT conv_id, md5('used ' || count(*) FILTER (overlap >= 0.2) || ' of ' || count(*) || chr(10) || string_agg(
        rpad(CASE WHEN overlap IS NULL THEN 'unclassified' WHEN overlap >= 0.2 THEN 'used' ELSE 'ignored' END, 13, ' ')
        || rpad(coalesce(printf('%.2f', overlap), '-'), 6, ' ') || substr(regexp_replace(text, '\\s+', ' ', 'g'), 1, 60), chr(10) ORDER BY turn)) AS digest
    FROM s GROUP BY conv_id
""")
def trace_render(spark: SparkSession, folder: str) -> DataFrame:
    scored = traces.measured(_flat(spark, folder)).withColumns({"r": F.lit(0), "i": F.col("turn")})
    return traces.lines(scored, "conv_id").select("conv_id", F.md5(F.col("text").cast("binary")).alias("digest"))
