"""Centroid clustering over an incrementally kept matrix of exact dot products.

Every vector of ``width`` finite components becomes whole numbers floor(scale * x). Its integer dot product with each
centroid is kept with it in a written table. When a round has moved the centroids, only their changes travel: for each
centroid the components whose change is not zero. A task adds change x component over these components alone, which
leaves exact dot products with the new centroids, and takes the least |c|^2 - 2 x.c (ties: smaller number). A round's
sums are made by tasks, a row for each cluster they have seen, and added by Spark; what the driver gets is a number for
each centroid and component, bounded by the parameters.

Vectors that are null, of another width, or hold null or non-finite components take no part. Repeated rows count as
vectors of their own. Starting centroids are the ``centroids`` vectors of least SHA-256 of ``<seed>:<vec_id>``; vectors
of equal hash come in order of their components, those with a null id last. With fewer vectors there are as many
centroids as vectors; an empty table gives an empty result. Components may be of any size: beyond 2^27 sums and products
are Python's integers. It is an error if a component is beyond double precision, a sum of components beyond 38 digits, or
a distance or an inertia beyond a long. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm._spark import materialize, small_batches

CENTROIDS = 16
ROUNDS = 3
WIDTH = 64
SCALE = 64.0
SEED = 1
#: Components below it: 4 x width x 2^54 stays below 2^63 for widths up to 128.
NARROW = 2**27
_STATE = "vec_id long, x array<double>, dots array<string>, cluster int, distance string"
_NARROW_STATE = "vec_id long, x array<double>, dots array<long>, cluster int, distance long"


def usable(table: DataFrame, width: int) -> DataFrame:
    """vec_id and x (array of double) of the vectors that take part."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return table.where((F.size("embedding") == width) & fine).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def _rows(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False)).reshape(-1, width)


def _lists(matrix: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = matrix.shape
    flat = matrix.ravel()
    values = pa.array([str(v) for v in flat.tolist()], kind) if kind == pa.string() else pa.array(flat, kind)
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), values)


def whole_numbers(table: DataFrame, width: int, scale: float) -> DataFrame:
    """vec_id and x, its components floor(scale * x) as doubles, which hold whole numbers of any size."""

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            with np.errstate(over="ignore"):
                x = np.floor(_rows(batch.column(1), width) * scale) + 0.0
            if not np.isfinite(x).all():
                raise ArithmeticError("a component is beyond double precision")
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(x, pa.float64())], ["vec_id", "x"])

    return usable(table, width).mapInArrow(floors, "vec_id long, x array<double>")


def _integers(x: np.ndarray, narrow: bool) -> np.ndarray:
    return x.astype(np.int64) if narrow else np.array([[int(v) for v in row] for row in x.tolist()], object).reshape(x.shape)


def _assigned(state: DataFrame, before: list[list[int]], centroids: list[list[int]], narrow: bool) -> DataFrame:
    """The state with dot products moved from the centroids ``before`` to ``centroids``, and each vector's nearest."""
    k, width = len(centroids), len(centroids[0])
    kind = np.int64 if narrow else object
    changes = []
    for old, new in zip(before, centroids, strict=True):
        at = [j for j in range(width) if old[j] != new[j]]
        changes.append((np.array(at, np.int64), np.array([new[j] - old[j] for j in at], kind)))
    squares = np.array([sum(v * v for v in c) for c in centroids], kind)
    number = pa.int64() if narrow else pa.string()

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _integers(_rows(batch.column(1), width), narrow)
            if batch.num_columns > 2:
                dots = _rows(batch.column(2), k)
                dots = dots.astype(np.int64) if narrow else np.array([[int(v) for v in row] for row in dots.tolist()], object)
            else:
                dots = np.zeros((len(x), k), np.int64).astype(kind)
            for c, (at, change) in enumerate(changes):
                if len(at):
                    dots[:, c] += x[:, at] @ change
            far = squares[None, :] - 2 * dots
            cluster = np.argmin(far, axis=1)
            distance = (x * x).sum(axis=1) + far[np.arange(len(x)), cluster]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), _lists(dots, number), pa.array(cluster.astype(np.int32)), pa.array(distance, number) if narrow else pa.array([str(v) for v in distance.tolist()])],
                ["vec_id", "x", "dots", "cluster", "distance"],
            )

    return state.mapInArrow(move, _NARROW_STATE if narrow else _STATE)


def _sums(state: DataFrame, narrow: bool, width: int) -> dict[int, tuple[int, list[int]]]:
    """Each cluster's number of vectors and its sums by component: a row for each cluster and component reaches the driver."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            x, cluster = _integers(_rows(batch.column(1), width), narrow), batch.column(0).to_numpy()
            for c in np.unique(cluster).tolist():
                own = x[cluster == c]
                n, total = held.get(c, (0, np.zeros(width, np.int64).astype(object)))
                held[c] = [n + len(own), total + own.astype(object).sum(axis=0)]
        if held:
            names = list(held)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array([held[c][0] for c in names], pa.int64()), _lists(np.array([held[c][1] for c in names], object), pa.string())], ["cluster", "n", "sums"])

    parts = state.select("cluster", "x").mapInArrow(partial, "cluster int, n long, sums array<string>")
    whole = F.col("sum").cast("decimal(38,0)")
    rows = parts.select("cluster", "n", F.posexplode("sums").alias("at", "sum")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(whole).alias("sum")).collect()
    out: dict[int, tuple[int, list[int]]] = {}
    for r in rows:
        if r["sum"] is None:
            raise ArithmeticError("a sum of components is beyond 38 digits")
        out.setdefault(r["cluster"], (r["n"], [0] * width))[1][r["at"]] = int(r["sum"])
    return out


def cluster_vectors(table: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, width: int = WIDTH, scale: float = SCALE, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 of every vector that takes part."""
    spark = table.sparkSession
    small_batches(spark)
    vectors = materialize(whole_numbers(table, width, scale), "centroid-vectors")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    start = vectors.orderBy(order.asc_nulls_last(), "x").limit(centroids).collect()
    kinds = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not start:
        return spark.createDataFrame([], kinds)
    largest = vectors.agg(F.max(F.aggregate("x", F.lit(0.0), lambda a, e: F.greatest(a, F.abs(e))))).first()[0]
    narrow = largest < NARROW and width <= 128
    now = [[int(v) for v in r["x"]] for r in start]
    before = [[0] * width for _ in now]
    state = materialize(_assigned(vectors, before, now, narrow), "centroid-round-0")
    for k in range(1, rounds + 1):
        held, before = _sums(state, narrow, width), now
        now = [[s // held[c][0] for s in held[c][1]] if c in held else old for c, old in enumerate(before)]
        state = materialize(_assigned(state.select("vec_id", "x", "dots"), before, now, narrow), f"centroid-round-{k}")
    distance = F.col("distance").cast("decimal(38,0)")
    inertia = {r["cluster"]: int(r["s"]) for r in state.groupBy("cluster").agg(F.sum(distance).alias("s")).collect()}  # a row for each centroid
    total = sum(inertia.values())
    if total >= 2**63:
        raise ArithmeticError("an inertia is beyond a long")
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    sums = spark.createDataFrame([(c, s, total, digest[c]) for c, s in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.select("vec_id", "cluster", F.col("distance").cast("long").alias("distance")).join(F.broadcast(sums), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
