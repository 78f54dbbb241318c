"""Headline queries on ``$BENCH_SF_DIR`` with ``$BENCH_CPUS`` cores: one JSON line of seconds."""

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from weftline.queries import load
from weftline.sources.edges import stored

#: The heaviest of each kind: walks and fusion, joins and folds, text, traces, streams.
HEADLINE = [
    "hybrid_retrieval", "routed_response", "best_path_walk", "router_walk", "impact_walk", "vector_topk", "frontier_hub_cap", "neighbors_topk", "node_degree", "top_hubs", "subgraph_edges",
    "docs_for_entities", "impact_report", "upsert_entities", "upsert_edges", "compile_snapshot", "tokenize_counts", "char_chunks", "rule_entities", "overlap_score", "used_summary",
    "local_lexical_trace", "lexical_documents", "word_windows", "graph_build", "span_depth", "trace_canvas", "reconcile_diff", "debounce_batch", "incremental_ingest_stream",
    "vector_index_search", "resolve_entities", "claimed_bursts", "document_mentions", "lexical_answer", "build_statistics",
]


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", f"file://{tempfile.mkdtemp(prefix='weftline-bench-')}").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    queries = load()[0]
    seconds = {}
    queries["vector_topk"](spark, folder).collect()  # warm up
    began = time.perf_counter()
    stored(spark, folder)  # what the walks read; written once by an application
    seconds["edge_store"] = round(time.perf_counter() - began, 3)
    for name in HEADLINE:
        spark.catalog.clearCache()  # no query is served from another's work
        began = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(folder)}))


if __name__ == "__main__":
    main()
