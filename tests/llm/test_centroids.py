"""Centroid clustering against distances worked out anew in each round with Python's integers."""

import hashlib
import math
import random

import pytest

from weftline.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, cluster int, x string"


def plain(rows, k, rounds, width, scale):
    kept = [(i, [math.floor(x * scale) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    now = [v for _, v in sorted(kept, key=key)[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [min((far(v, c), j) for j, c in enumerate(now)) for _, v in kept]
    for _ in range(rounds):
        own = assign()
        for j in range(len(now)):
            group = [v for (_, v), (_, c) in zip(kept, own, strict=True) if c == j]
            if group:
                now[j] = [sum(column) // len(group) for column in zip(*group, strict=True)]
    own = assign()
    total = sum(d for d, _ in own)
    return sorted(((i, j, d, sum(e for e, c in own if c == j), total, hashlib.sha256(",".join(map(str, now[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, own, strict=True)), key=repr)


def clustered(spark, rows, **more):
    frame = spark.createDataFrame([(i, v, 7, "clash") for i, v in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in centroids.cluster_vectors(frame, **more).collect()), key=repr)


def vectors(rng, n, width, size):
    return [(i, [rng.gauss(0, size) + (i % 5) * 3 * size for _ in range(width)]) for i in range(n)]


@pytest.mark.parametrize("size", [1.0, 1e5])
def test_against_plain_rounds(spark, size):
    rng = random.Random(3)
    rows = vectors(rng, 150, 8, size) + [(3, [0.0] * 8), (3, [0.0] * 8), (None, [1.5] * 8), (None, [1.5] * 8)]
    rows += [(900, None), (901, [1.0] * 7), (902, [1.0] * 7 + [None]), (903, [1.0] * 7 + [math.inf]), (904, [1.0] * 7 + [math.nan]), (905, [])]
    got = clustered(spark, rows, centroids=6, width=8)
    assert got == plain(rows, 6, 3, 8, 64.0) and len(got) == 154


def test_ties_repeats_and_few_vectors(spark):
    rows = [(i, [float(i % 2), 0.0]) for i in range(5)]
    assert clustered(spark, rows, centroids=16, width=2) == plain(rows, 16, 3, 2, 64.0)
    same = [(1, [0.25, -0.25])] * 40
    got = clustered(spark, same, centroids=4, width=2)
    assert got == plain(same, 4, 3, 2, 64.0) and {r[1] for r in got} == {0} and {r[2] for r in got} == {0}


def test_wide_components_are_exact_or_an_error(spark):
    rows = [(i, [1e15 + i, -1e15 + 2 * i]) for i in range(30)]
    assert clustered(spark, rows, centroids=3, width=2) == plain(rows, 3, 3, 2, 64.0)
    with pytest.raises(Exception, match="beyond double precision"):
        clustered(spark, [(1, [1.7e308, 0.0])], width=2)
    with pytest.raises(Exception, match="overflow|OVERFLOW|beyond"):
        clustered(spark, [(1, [1e12, 0.0]), (2, [-1e12, 0.0])], centroids=1, width=2)


def test_empty(spark):
    assert clustered(spark, []) == [] and clustered(spark, [(1, None)]) == []
