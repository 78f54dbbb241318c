"""The built graph and resolved mentions written, with what was counted on the way."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.watch import Watch
from weftline.plans.build import build

TABLES = ("entity", "relates_to", "document", "mentions", "unresolved")


def build_and_write(payloads: dict[str, DataFrame], folder: str) -> dict[str, dict[str, int]]:
    """Build a graph from payload tables, write its tables under a folder, and give all counters by stage.

    Each table is one action; every counter comes from the plan that writes it.
    """
    watch = Watch()
    built = build(*[payloads[k] for k in ("repository", "pull_requests", "issues", "commits", "reviews", "files")], watch=watch)
    for name in TABLES:
        watch(built[name], f"written_{name}").write.mode("errorifexists").parquet(f"{folder}/{name}")
    return watch.counters()


def write_resolved(resolved: DataFrame, path: str) -> dict[str, float]:
    """Write resolved mentions (path and others) and give their statistics: seen, created, merges of each kind, and the share of mentions that were in the band where a judge is asked."""
    watch = Watch()
    kind = lambda name: F.count_if(F.col("path") == name)
    watch(resolved, "resolved", **{k: kind(k) for k in ("created", "merged", "judged", "repeat")}, asked=F.count_if("asked")).write.mode("errorifexists").parquet(path)
    n = watch.counters()["resolved"]
    seen, merges = n["rows"], n["merged"] + n["judged"] + n["repeat"]
    return {
        "seen": seen, "created": n["created"], "fast_merges": n["merged"], "model_merges": n["judged"], "repeats": n["repeat"], "variant_merges": n["merged"] + n["judged"], "merges": merges,
        "asked": n["asked"], "band_fraction": round(n["asked"] / seen, 4) if seen else 0.0,
    }
