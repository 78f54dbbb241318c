"""The document table seen as repository activity, with the columns of landing payloads: one repository, a third each of changes, issues and commits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_USER = "named_struct('login', 'u' || (doc_id % 50), 'id', doc_id % 50) AS user"
_TIMES = "timestamp_seconds(1704067200 + doc_id) AS created_at, timestamp_seconds(1704067200 + 2 * doc_id) AS updated_at"


def payloads(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """repository, pull_requests, issues, commits, reviews and files, as the graph build reads them."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "source")
    third = lambda k: docs.where(f"doc_id % 3 = {k}")
    said = "'Fixes #' || (doc_id + 1) || ' and closes: #' || (doc_id + 300000000) || '. ' || coalesce(text, '')"
    return {
        "repository": spark.range(1).selectExpr("'acme/tools' AS full_name", "timestamp_seconds(1704067200) AS created_at"),
        "pull_requests": third(0).selectExpr("cast(doc_id AS int) AS number", "substr(text, 1, 40) AS title", f"{said} AS body", _USER, "'https://x.y/pull/' || doc_id AS html_url", *_TIMES.split(", ")),
        "issues": third(1).selectExpr("cast(doc_id AS int) AS number", "substr(text, 1, 40) AS title", "text AS body", _USER, "'https://x.y/issues/' || doc_id AS html_url", *_TIMES.split(", ")),
        "commits": third(2).selectExpr(
            "'c' || doc_id AS sha", "'https://x.y/commit/' || doc_id AS html_url", "named_struct('message', 'resolve #' || (doc_id - 1) || ' fixes #' || (doc_id - 2), 'author', named_struct('date', timestamp_seconds(1704067200 + doc_id))) AS commit",
            "CASE WHEN doc_id % 2 = 0 THEN named_struct('login', 'u' || (doc_id % 50), 'id', doc_id % 50) END AS author",
        ),
        "reviews": docs.where("doc_id % 3 < 2").selectExpr("cast(doc_id - doc_id % 3 AS int) AS pr_number", _USER),
        "files": docs.where("doc_id % 3 <> 1").selectExpr("cast(doc_id - doc_id % 3 + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS int) AS pr_number", "source || '/f' || (doc_id % 20) || '.py' AS filename"),
    }
