"""Landing files of repository activity, and traces and snapshots on disk.

Payloads are JSON lines with fixed schemas; unknown fields are ignored, malformed rows fail the read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

USER = "struct<login:string,id:bigint>"
SCHEMAS = {
    "repository": f"id bigint, name string, full_name string, private boolean, owner {USER}, html_url string, description string, created_at timestamp, updated_at timestamp",
    "pull_request": f"id bigint, number int, state string, title string, body string, user {USER}, html_url string, merge_commit_sha string, labels array<struct<name:string>>, created_at timestamp, updated_at timestamp, closed_at timestamp, merged_at timestamp",
    "issue": f"id bigint, number int, state string, title string, body string, user {USER}, html_url string, labels array<struct<name:string>>, created_at timestamp, updated_at timestamp, closed_at timestamp, pull_request struct<url:string>",
    "commit": f"sha string, html_url string, commit struct<message:string,author:struct<name:string,email:string,date:timestamp>>, author {USER}, parents array<struct<sha:string>>",
    "review": f"pr_number int, id bigint, state string, body string, user {USER}, html_url string, submitted_at timestamp",
    "changed_file": "pr_number int, sha string, filename string, status string, additions int, deletions int, changes int, patch string, previous_filename string",
}


def payload(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """One kind of payload of a landing folder: ``<folder>/<kind>/*.json``."""
    return spark.read.schema(SCHEMAS[kind]).option("mode", "FAILFAST").json(f"{folder}/{kind}")


def issues(spark: SparkSession, folder: str) -> DataFrame:
    """Issues without the rows that are pull requests, before any limit."""
    return payload(spark, folder, "issue").where("pull_request is null").drop("pull_request")


def newest(rows: DataFrame, limit: int) -> DataFrame:
    return rows.orderBy(F.desc_nulls_last("updated_at"), F.desc("number")).limit(limit)


def delta_items(pull_requests: DataFrame, only_issues: DataFrame) -> DataFrame:
    """Both kinds of items in one form: kind, number, title, body, author, merged, updated_at."""
    def form(rows: DataFrame, kind: str, merged) -> DataFrame:
        return rows.select(F.lit(kind).alias("kind"), "number", "title", "body", F.col("user.login").alias("author"), merged.alias("merged"), "created_at", "updated_at", "html_url")

    merged = F.col("merged_at").isNotNull() | (F.coalesce("merge_commit_sha", F.lit("")) != "")
    return form(pull_requests, "PullRequest", merged).unionByName(form(only_issues, "Issue", F.lit(False)))


def save_traces(traces: DataFrame, path: str) -> None:
    """Traces as JSON lines, in as many files as the frame has partitions."""
    traces.write.mode("errorifexists").json(path)


def write_snapshot(tables: dict[str, DataFrame], folder: str, version: int) -> None:
    """A version of all tables, then the manifest that names it: readers see the old one until it is complete."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{folder}/version={version}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(version, sorted(tables))], "version int, tables array<string>").coalesce(1).write.mode("append").json(f"{folder}/manifest")


def read_snapshot(spark: SparkSession, folder: str, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of a version, the newest one if none is named."""
    manifest = spark.read.schema("version int, tables array<string>").json(f"{folder}/manifest")
    row = (manifest if version is None else manifest.where(F.col("version") == version)).orderBy(F.desc("version")).first()
    if row is None:
        raise ValueError(f"no such version in {folder}")
    return {name: spark.read.parquet(f"{folder}/version={row['version']}/{name}") for name in row["tables"]}
