"""Exact top-k against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import topk


def brute(rows, is_query, k):
    out = {}
    for q, v in rows:
        if v is None or not is_query(q):
            continue
        scored = sorted(((-int(v @ w), i) for i, w in rows if i != q and w is not None))[:k]
        out[q] = [(i, -s) for s, i in scored]
    return out


def run(spark, rows, is_query, k=5):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string, shard int")
    got = topk.top_k(frame, is_query, k).toPandas().sort_values(["query_id", "rank"])
    return {q: list(zip(part.vec_id, part.score, strict=True)) for q, part in got.groupby("query_id")}


def test_brute_force_with_ties_and_several_shards(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 150)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(3)
    values = rng.integers(-3, 4, (600, 8)) / 4
    values[100:200] = values[0]
    rows = [(i, [float(x) for x in v], "x", 1) for i, v in enumerate(values)]
    got = run(spark, rows, F.col("vec_id") % 20 == 0)
    want = brute([(i, np.floor(256 * v).astype(int)) for i, v in enumerate(values)], lambda q: q % 20 == 0, 5)
    assert got == want


def test_nulls_infinities_widths_and_few_rows(spark):
    rows = [(0, [1.0, 0.0], None, None), (1, None, None, None), (2, [float("nan"), 1.0], None, None), (3, [float("inf"), 1.0], None, None), (4, [0.5, None], None, None), (5, [0.5, 0.5], None, None), (6, [1.0], None, None), (None, [1.0, 1.0], None, None), (7, [], None, None)]
    assert run(spark, rows, F.col("vec_id") >= 0) == {0: [(5, 128 * 256)], 5: [(0, 128 * 256)]}
    assert run(spark, [], F.col("vec_id") >= 0) == {}


def exact(rows, is_query, k):
    """By Python's integers."""
    whole = {i: [int(np.floor(256.0 * x)) for x in v] for i, v in rows}
    score = lambda a, b: sum(x * y for x, y in zip(whole[a], whole[b], strict=True))
    return {q: [(-n, s) for s, n in sorted(((score(q, i), -i) for i in whole if i != q), reverse=True)[:k]] for q in whole if is_query(q)}


@pytest.mark.parametrize("size", [1.0, 1e3, 2e5, 1e6])
def test_products_of_any_size(spark, monkeypatch, size):
    monkeypatch.setattr(topk, "SHARD_ROWS", 40)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 5)
    monkeypatch.setattr(topk, "LEAF", 8)
    rng = np.random.default_rng(8)
    values = rng.normal(size=(300, 6)) * size
    values[20:40] = values[3] + rng.integers(-1, 2, (20, 6)) / 256  # scores that differ by little
    values = np.round(values * 256) / 256
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(values)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(frame, F.col("vec_id") % 20 == 0).toPandas().sort_values(["query_id", "rank"])
    found = {q: list(zip(part.vec_id, part.score, strict=True)) for q, part in got.groupby("query_id")}
    assert found == exact(rows, lambda q: q % 20 == 0, 5)


def test_values_beyond_32_bits_are_not_cut(spark):
    rows = [(0, [1e6, 1.0]), (1, [1e6, 1.0]), (2, [2e6, 1.0]), (3, [-1e6, 0.5])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(frame, F.col("vec_id") == 0).collect()}
    assert got == {(0, 1): (2, 256000000 * 512000000 + 256 * 256), (0, 2): (1, 256000000**2 + 256 * 256), (0, 3): (3, -(256000000**2) + 256 * 128)}


@pytest.mark.parametrize("rows", [[(0, [1e12, 1.0]), (1, [1e12, 1.0])], [(0, [1e12, 1.0]), (1, [-1e12, 1.0])], [(0, [1e308]), (1, [1.0])]])
def test_scores_that_no_long_holds_are_errors(spark, rows):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond"):
        topk.top_k(frame, F.col("vec_id") == 0).collect()


def test_wide_products_that_fit(spark):
    rows = [(0, [1e12, 1e12]), (1, [1e12, -1e12]), (2, [1.0, 2.0]), (3, [-3e12, 3e12])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in topk.top_k(frame, F.col("vec_id") == 0).orderBy("rank").collect()] == [(2, 256 * 10**12 * 768), (1, 0), (3, 0)]
