"""A graph from repository activity: nodes, edges and document chunks of payload tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.scoring import edge_price
from weftline.functions.text import closing_numbers, document_text, node_label
from weftline.operators.documents import char_chunks
from weftline.operators.watch import unwatched


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _number_id(prefix: str, number: str = "number"):
    return F.concat(F.lit(f"{prefix}:"), F.col(number).cast("string"))


def build(repository: DataFrame, pull_requests: DataFrame, issues: DataFrame, commits: DataFrame, reviews: DataFrame, files: DataFrame, watch: Callable[..., DataFrame] = unwatched) -> dict[str, DataFrame]:
    """entity, relates_to, document, mentions and unresolved (closing references to nothing known).

    ``watch`` sees the stages (see ``operators.watch``): what each kind of payload gave, and what made no node or edge.

    Issues come first where a number names both. A review by the change's own author, and rows of a change that is not there, make no edge.
    """
    no_time = F.lit(None).cast("timestamp")

    def nodes(rows, node_id, kind, ts, *fields):
        return rows.select(node_id.alias("id"), node_label(node_id, *fields).alias("label"), F.lit(kind).alias("type"), ts.alias("ts"))

    users = _union([x.select("user.login") for x in (pull_requests, issues, reviews)] + [commits.select("author.login")]).where("login is not null").distinct()
    sha = F.concat(F.lit("commit:"), "sha")
    entity = _union([
        nodes(repository, F.concat(F.lit("repo:"), "full_name"), "Repo", F.col("created_at"), F.col("full_name")), nodes(watch(pull_requests, "pull_requests"), _number_id("pr"), "PR", F.col("created_at"), F.col("title")),
        nodes(watch(issues, "issues"), _number_id("ticket"), "Ticket", F.col("created_at"), F.col("title")), nodes(watch(commits, "commits", without_author=F.count_if(F.col("author.login").isNull())), sha, "Commit", F.col("commit.author.date"), F.col("commit.message")),
        nodes(users, F.concat(F.lit("person:"), "login"), "Person", no_time, F.col("login")), nodes(files.select("filename").distinct(), F.concat(F.lit("file:"), "filename"), "File", no_time, F.col("filename")),
    ])
    entity = watch(watch(entity, "node_rows").dropDuplicates(["id"]), "nodes")

    def edges(rows, src, relation, dst):
        return rows.select(src.alias("src"), dst.alias("dst"), F.lit(relation).alias("relation")).where("src is not null and dst is not null")

    person = F.when(F.col("user.login").isNotNull(), F.concat(F.lit("person:"), "user.login"))
    repo = repository.select(F.concat(F.lit("repo:"), "full_name").alias("repo"), F.lit(1).alias("one"))
    members = _union([pull_requests.select(_number_id("pr").alias("id")), issues.select(_number_id("ticket").alias("id")), commits.select(sha.alias("id"))]).withColumn("one", F.lit(1))
    changes = pull_requests.select(F.col("number").alias("pr_number"), F.col("user.login").alias("owner"), F.lit(True).alias("known"))
    lost = F.count_if(F.col("known").isNull())
    own = F.col("user.login").eqNullSafe(F.col("owner"))
    reviewed = watch(reviews.join(changes, "pr_number", "left"), "reviews", orphans=lost, self_reviews=F.count_if(F.col("known") & own)).where("known")
    touched = watch(files.join(changes, "pr_number", "left"), "changed_files", orphans=lost).where("known")
    said = _union([pull_requests.select(_number_id("pr").alias("src"), document_text(F.col("title"), F.col("body")).alias("text")), commits.select(sha.alias("src"), F.col("commit.message").alias("text"))])
    closing = said.select("src", F.explode(closing_numbers(F.col("text"))).alias("n"))
    named = _union([issues.select(F.col("number").cast("long").alias("n"), _number_id("ticket").alias("dst"), F.lit(0).alias("turn")), pull_requests.select(F.col("number").cast("long").alias("n"), _number_id("pr").alias("dst"), F.lit(1).alias("turn"))])
    named = named.groupBy("n").agg(F.min_by("dst", "turn").alias("dst"))
    closes = closing.join(named, "n", "left")
    relates = _union([
        edges(pull_requests, person, "AUTHORED", _number_id("pr")), edges(issues, person, "REPORTED", _number_id("ticket")),
        edges(commits, F.when(F.col("author.login").isNotNull(), F.concat(F.lit("person:"), "author.login")), "AUTHORED", sha),
        members.join(F.broadcast(repo), "one").select(F.col("id").alias("src"), F.col("repo").alias("dst"), F.lit("PART_OF").alias("relation")),
        edges(reviewed.where(~own), person, "REVIEWED", _number_id("pr", "pr_number")),
        edges(touched, _number_id("pr", "pr_number"), "TOUCHES", F.concat(F.lit("file:"), "filename")),
        closes.where("dst is not null and src <> dst").select("src", "dst", F.lit("RESOLVES").alias("relation")),
    ])
    relates = watch(watch(relates, "edge_rows").distinct(), "edges").withColumn("confidence", edge_price(F.col("relation"), F.lit(None).cast("double")))

    bodies = _union([
        pull_requests.select(_number_id("pr").alias("origin"), document_text(F.col("title"), F.col("body")).alias("content"), F.coalesce("html_url", _number_id("pr")).alias("path")),
        issues.select(_number_id("ticket").alias("origin"), document_text(F.col("title"), F.col("body")).alias("content"), F.coalesce("html_url", _number_id("ticket")).alias("path")),
        commits.select(sha.alias("origin"), F.col("commit.message").alias("content"), F.coalesce("html_url", sha).alias("path")),
    ]).withColumn("base", F.concat(F.lit("doc:"), "origin"))
    chunks = char_chunks(bodies).select(F.col("chunk_id").alias("id"), "path", "content", "origin")
    return {
        "entity": entity, "relates_to": relates, "document": chunks.drop("origin"), "mentions": chunks.select(F.col("id").alias("doc"), F.col("origin").alias("entity")).distinct(),
        "unresolved": closes.where("dst is null").select("src", "n"),
    }
