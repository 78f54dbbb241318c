"""URL rules by host suffix and path prefix, matched through hash prefixes.

A rule is a host and a path. It fits its host and every subdomain, where the url's path starts with the rule's path;
of several the longest wins (then the one with the longer host). Each distinct url head (host, and as much of the path
as the longest rule reads) is expanded into the host suffixes and path prefixes that some rule could have: suffixes of
as many labels, prefixes of as many characters. Expressions meet rules by an equi-join on the first 8 hex digits of
their SHA-256, and a meeting counts only if the whole digest agrees.

Null urls, and those without ``://``, have an empty host and path, which no rule fits. Repeated rows are kept, an empty
table gives an empty result, other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules as (verdict, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Hex digits of the digest that the join is on.
PREFIX = 8
#: Up to so many rules (about 10 MB) go to every executor; more are joined by shuffle.
BROADCAST_RULES = 100_000
#: Tasks that the pages of one host and path head are dealt over.
SALTS = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url, both empty where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (null if none fits) and verdict of every page."""
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    pages = pages.select(F.col("page_id"), host.alias("host"), path.alias("path"))
    if not rules:
        return pages.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    labels = sorted({h.count(".") + 1 for _, h, _ in rules})
    lengths = sorted({len(p) for _, _, p in rules})
    reach = F.substring("path", 1, lengths[-1])
    heads = pages.select("host", reach.alias("head")).distinct()

    parts = F.split("host", r"\.", -1)
    suffixes = F.array_compact(F.array(*[F.when(F.size(parts) >= n, F.array_join(F.slice(parts, -n, n), ".")) for n in labels]))
    prefixes = F.array_compact(F.array(*[F.when(F.length("head") >= n, F.substring("head", 1, n)) for n in lengths]))
    expressions = (
        heads.withColumn("suffix", F.explode(suffixes)).withColumn("prefix", F.explode(prefixes))
        .withColumn("digest", F.sha2(F.concat_ws("\n", "suffix", "prefix"), 256)).withColumn("short", F.substring("digest", 1, PREFIX))
    )
    table = spark.createDataFrame([(v, h, p) for v, h, p in rules], "verdict string, rule_host string, rule_path string").select(
        "verdict", "rule_host", F.concat("rule_host", "rule_path").alias("rule"), F.sha2(F.concat_ws("\n", "rule_host", "rule_path"), 256).alias("full")
    )
    table = table.withColumn("short", F.substring("full", 1, PREFIX))
    if len(rules) <= BROADCAST_RULES:
        table = F.broadcast(table)
    met = expressions.join(table, "short").where(F.col("digest") == F.col("full"))
    rank = F.struct(F.length("rule"), F.length("rule_host"), F.col("rule"), F.col("verdict"))
    best = met.groupBy("host", "head").agg(F.max(rank).alias("best")).select("host", "head", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
    # A host may hold a third of all pages: its few heads are repeated for every salt, and its pages dealt over them.
    best = best.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return (
        pages.withColumn("head", reach).withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int")).join(best, ["host", "head", "salt"], "left")
        .select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
    )
