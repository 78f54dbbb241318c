"""Exact top-k by inner product: a ball tree per shard, searched by branch and bound for blocks of queries.

Vectors are cut into shards by hash of their id, each shard builds one ball tree, and queries are cut into blocks. A
node can be left out for a query if q.centre + |q| * radius is below the query's current k-th score. Nodes are visited
in order of that bound. A block first searches one tree; then, in waves, it meets the trees that its k-th scores
so far do not rule out by their roots alone, those of greatest bound first: one, four, sixteen and so on. After each wave the k-th
scores are shared by all trees of the next, and only the pairs of block and tree that are left are joined with whole trees.

Vectors that are null or hold null or non-finite components, and rows with a null id, take no part. Only vectors as
wide as the query's are compared with it. A row is no candidate for queries with its own id. Repeated rows count as
candidates of their own; of several rows with a query's id the least vector is the query. A query without candidates
has no result row; an empty table gives an empty result. Components are floor(scale * x), whole numbers of any size, and scores are
exact: sums that double precision or a long can't hold are worked out with Python's integers. It is an error if a
component is beyond double precision's range, or a score above a long's or in the result below it. Other columns are not read.

A home tree may be missing for a width with few rows (its shard is then empty): the block is searched with no bound.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm._spark import materialize, small_batches

K = 5
SHARD_ROWS = 16_384
QUERY_BLOCK = 512
LEAF = 256


@dataclass
class BallTree:
    """Rows in leaf order; node k's children are left[k] and left[k] + 1, a leaf has left -1."""

    ids: np.ndarray
    rows: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    left: np.ndarray
    begin: np.ndarray
    end: np.ndarray


def build_tree(ids: np.ndarray, rows: np.ndarray) -> BallTree:
    """Split at the median of the widest component until leaves hold LEAF rows at most; equal rows split by place."""
    order = np.argsort(ids, kind="stable")
    begin, end, left, centre, radius = [0], [len(ids)], [-1], [], []
    at = 0
    while at < len(begin):
        part = rows[order[begin[at] : end[at]]].astype(np.float64)
        middle = part.mean(axis=0) if len(part) else np.zeros(rows.shape[1])
        centre.append(middle)
        radius.append(np.sqrt(((part - middle) ** 2).sum(axis=1).max()) if len(part) else 0.0)
        if len(part) > LEAF:
            axis = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
            half = len(part) // 2
            order[begin[at] : end[at]] = order[begin[at] : end[at]][np.argsort(part[:, axis], kind="stable")]
            left[at] = len(begin)
            begin += [begin[at], begin[at] + half]
            end += [begin[at] + half, end[at]]
            left += [-1, -1]
        at += 1
    return BallTree(ids[order], rows[order], np.array(centre), np.array(radius), np.array(left), np.array(begin), np.array(end))


LOWEST = np.iinfo(np.int64).min
#: Stand for every score below and above a long's range.
BELOW, ABOVE = LOWEST + 1, np.iinfo(np.int64).max


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """All inner products as longs. Both hold whole numbers."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * rows.shape[1]
    if most < 2**53:
        return (queries.astype(np.float64) @ rows.T.astype(np.float64)).astype(np.int64)
    if most < 2**62 and max(np.abs(queries).max(initial=0), np.abs(rows).max(initial=0)) < 2**62:
        return queries.astype(np.int64) @ rows.T.astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m.tolist()], object)
    exact = whole(queries) @ whole(rows).T
    return np.where(exact < BELOW, BELOW, np.where(exact > ABOVE, ABOVE, exact)).astype(np.int64)


def _reach(norm: np.ndarray, queries: np.ndarray, centre: np.ndarray, radius: float) -> np.ndarray:
    """A bound, safe against rounding, of each query's products with a node's rows."""
    size = float(np.sqrt((centre * centre).sum())) + radius
    return queries @ centre + norm * radius + 1e-9 * norm * size + 1e-6


def search(tree: BallTree, query_ids: np.ndarray, queries: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k best rows of the tree that reach its bound: query places, ids, scores."""
    n = len(queries)
    queries = queries.astype(np.float64)
    norm = np.sqrt((queries**2).sum(axis=1))
    score = np.full((n, k), LOWEST)
    which = np.full((n, k), np.iinfo(np.int64).max)
    limit = bound.astype(np.int64).copy()
    stack = [(0, np.arange(n))]
    while stack:
        node, active = stack.pop()
        top = _reach(norm[active], queries[active], tree.centre[node], tree.radius[node])
        active = active[~(top < limit[active])]
        if not len(active):
            continue
        if tree.left[node] >= 0:
            a, b = int(tree.left[node]), int(tree.left[node]) + 1
            first, second = (_reach(norm[active], queries[active], tree.centre[x], tree.radius[x]).sum() for x in (a, b))
            pair = [(b, active), (a, active)] if first >= second else [(a, active), (b, active)]
            stack += pair  # the one with the higher bound is visited first
            continue
        rows = slice(int(tree.begin[node]), int(tree.end[node]))
        ids = tree.ids[rows]
        others = query_ids[active][:, None] != ids[None, :]
        got = np.where(others, products(queries[active], tree.rows[rows]), LOWEST)
        if (got == ABOVE).any():
            raise ArithmeticError("an inner product is beyond a long")
        both = np.concatenate([score[active], got], axis=1)
        names = np.concatenate([which[active], np.broadcast_to(ids, got.shape)], axis=1)
        order = np.lexsort((names, ~both), axis=1)[:, :k]
        score[active] = np.take_along_axis(both, order, 1)
        which[active] = np.take_along_axis(names, order, 1)
        limit[active] = np.maximum(limit[active], score[active][:, -1])
    place, column = np.nonzero((score > LOWEST) & (score >= bound[:, None]))
    return place, which[place, column], score[place, column]


def usable_vectors(table: DataFrame) -> DataFrame:
    """vec_id, x (array of double) and width of the vectors that take part."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = table.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & fine)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"), F.size("embedding").alias("width"))


def _matrix(rows: pd.Series, scale: float) -> np.ndarray:
    """Whole numbers, as doubles: floor(scale * x)."""
    with np.errstate(over="ignore"):
        whole = np.floor(np.stack(rows.to_numpy()).astype(np.float64) * scale)
    if not np.isfinite(whole).all():
        raise ArithmeticError("a component is beyond double precision")
    return whole


def _limits(ids: np.ndarray, kth: list | None) -> np.ndarray:
    """The k-th score of each id so far, the lowest where there is none."""
    known = {} if kth is None else {r["query_id"]: r["score"] for r in kth}
    return np.array([known.get(i, LOWEST) for i in ids.tolist()], np.int64)


def top_k(table: DataFrame, is_query: Column, k: int = K, scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best candidates. ``is_query`` reads vec_id."""
    small_batches(table.sparkSession)
    vectors = materialize(usable_vectors(table), "topk-vectors")
    sizes = vectors.groupBy().agg(F.count(F.lit(1)), F.count(F.when(is_query, 1))).first()
    shards, blocks = max(1, -(-sizes[0] // SHARD_ROWS)), max(1, -(-sizes[1] // QUERY_BLOCK))

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        tree = build_tree(frame["vec_id"].to_numpy(np.int64), _matrix(frame["x"], scale))
        centre, radius = tree.centre[0], float(tree.radius[0])
        if np.abs(tree.rows).max(initial=0) < 2**15:
            tree.rows = tree.rows.astype(np.int16)
        return pd.DataFrame({"width": [frame["width"].iloc[0]], "shard": [frame["shard"].iloc[0]], "tree": [pickle.dumps(tree, protocol=5)], "centre": [centre], "radius": [radius]})

    def block(frame: pd.DataFrame) -> pd.DataFrame:
        packed = pickle.dumps((frame["vec_id"].to_numpy(np.int64), _matrix(frame["x"], scale)), protocol=5)
        return pd.DataFrame({"width": [frame["width"].iloc[0]], "block": [frame["block"].iloc[0]], "queries": [packed]})

    hashed = F.xxhash64("vec_id")
    trees = vectors.withColumn("shard", F.pmod(hashed, F.lit(shards)).cast("int")).groupBy("width", "shard").applyInPandas(build, "width int, shard int, tree binary, centre array<double>, radius double")
    trees = materialize(trees, "topk-trees")
    queries = vectors.where(is_query).groupBy("vec_id").agg(F.min(F.struct("width", "x")).alias("q")).select("vec_id", "q.x", "q.width")
    queries = queries.withColumn("block", F.pmod(F.xxhash64(hashed), F.lit(blocks)).cast("int"))
    queries = materialize(queries.groupBy("width", "block").applyInPandas(block, "width int, block int, queries binary"), "topk-queries")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        found = []
        for width, number, tree, packed, kth in zip(frame["width"], frame["block"], frame["tree"], frame["queries"], frame["kth"], strict=True):
            ids, rows = pickle.loads(packed)
            place, names, score = search(pickle.loads(tree), ids, rows, _limits(ids, kth), k)
            found.append(pd.DataFrame({"width": width, "block": number, "query_id": ids[place], "vec_id": names, "score": score}))
        return pd.concat(found)

    def reaching(key: tuple, own: pd.DataFrame, roots: pd.DataFrame) -> pd.DataFrame:
        """The shards that a block's k-th scores do not rule out, and by how much the nearest query reaches them."""
        ids, rows = pickle.loads(own["queries"].iloc[0])
        limit, norm = _limits(ids, own["kth"].iloc[0]).astype(np.float64), np.sqrt((rows**2).sum(axis=1))
        over = [float(np.nanmax(np.nan_to_num(_reach(norm, rows, np.asarray(c, np.float64), r) - limit, nan=np.inf))) for c, r in zip(roots["centre"], roots["radius"], strict=True)]
        left = pd.DataFrame({"width": key[0], "block": key[1], "shard": roots["shard"], "over": over})
        return left[left["over"] >= 0]

    def searched(pairs: DataFrame, label: str) -> DataFrame:
        """The pairs' trees searched, a group for each pair: width, block, query_id, vec_id, score."""
        kinds = "width int, block int, query_id long, vec_id long, score long"
        whole = pairs.join(trees.select("width", "shard", "tree"), ["width", "shard"])
        return materialize(whole.groupBy("width", "block", "shard").applyInPandas(run, kinds), label)

    def best_of(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def bounded(best: DataFrame) -> DataFrame:
        kth = best.groupBy("width", "block", "query_id").agg(F.min("score").alias("score"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
        return queries.join(kth.groupBy("width", "block").agg(F.collect_list(F.struct("query_id", "score")).alias("kth")), ["width", "block"], "left")

    # A stated set of pairs of blocks and shards, made from keys.
    home = F.pmod("block", F.lit(shards))
    nothing = F.lit(None).cast("array<struct<query_id:long,score:long>>")
    found = searched(queries.withColumns({"shard": home, "kth": nothing}), "topk-home")
    left = materialize(queries.select("width", "block").join(trees.select("width", "shard"), "width").where(F.col("shard") != home), "topk-left-0")
    wave, taken = 0, 1
    while left.limit(1).count():
        wave += 1
        known = materialize(bounded(best_of(found)), f"topk-bounds-{wave}")
        roots = left.join(trees.select("width", "shard", "centre", "radius"), ["width", "shard"])
        reached = known.groupBy("width", "block").cogroup(roots.groupBy("width", "block")).applyInPandas(reaching, "width int, block int, shard int, over double")
        turn = Window.partitionBy("width", "block").orderBy(F.desc("over"), "shard")
        reached = materialize(reached.withColumn("turn", F.row_number().over(turn)), f"topk-reached-{wave}")
        found = materialize(best_of(found).drop("rank").unionByName(searched(known.join(reached.where(F.col("turn") <= taken).select("width", "block", "shard"), ["width", "block"]), f"topk-wave-{wave}")), f"topk-found-{wave}")
        left = materialize(reached.where(F.col("turn") > taken).select("width", "block", "shard"), f"topk-left-{wave}")
        taken *= 4
    ranked = best_of(found).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    return ranked.withColumn("score", F.when(F.col("score") > BELOW, F.col("score")).otherwise(F.raise_error(F.lit("an inner product is beyond a long")).cast("long")))
