"""A stored vector index: an inverted file of cells with radii, probed by bounds, so that results are exact.

Vectors are scaled to length one. At most ``MAX_CELLS`` of them, those of least hash, are centroids (their number grows
with the square root of the rows); a row lies in the cell of the centroid most like it. ``<folder>/<version>/rows`` holds
the rows in packed chunks, a partition for each cell, ``<folder>/<version>/cells`` each cell's centroid c, radius r (greatest
distance of a row) and rows. For a question q of length one no row of a cell is more like it than q.c + r.

Questions are packed in blocks by home cell. A block first searches its home; then it meets the cells that the k-th
similarities so far don't rule out. A cell's chunks move once for some ``SHARE`` blocks; questions are what is copied. Similarities are rounded
to 9 places, so that equal vectors tie; ties go to the smaller id. A row never answers a question of its own id, repeated
rows answer each for itself. Null ids and vectors take no part; the zero vector is like nothing (0).

An index does not follow its table: ``build`` writes a new version beside the old one and then points to it, ``drop`` takes
the pointer away, and a reader keeps the version it has opened.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.sources.shared import written

MAX_CELLS = 4096
CHUNK_ROWS, BLOCK_ROWS, SHARE = 4096, 512, 64
#: Room for the rounding of similarities and bounds.
SLACK = 1e-8


def units(vectors: pd.Series) -> np.ndarray:
    """Rows of length one; zero rows stay."""
    matrix = np.stack(vectors.to_numpy()).astype(np.float64)
    return matrix / np.maximum(np.sqrt((matrix * matrix).sum(axis=1, keepdims=True)), 1e-300)


def best(query_ids: np.ndarray, questions: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each question's k most like rows that reach ``least``: places of questions, ids, similarities."""
    near = np.round(questions @ rows.T, 9)
    near[query_ids[:, None] == ids[None, :]] = -np.inf
    cut = least if near.shape[1] <= k else np.maximum(least, np.partition(near, -k, axis=1)[:, -k])
    q, r = np.nonzero((near >= cut[:, None]) & np.isfinite(near))
    score = near[q, r]
    order = np.lexsort((ids[r], -score, q))
    q, r, score = q[order], r[order], score[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    return q[rank < k], ids[r[rank < k]], score[rank < k]


@dataclass(frozen=True)
class VectorIndex:
    """One version of an index."""

    spark: SparkSession
    path: str
    id_type: str

    @staticmethod
    def build(table: DataFrame, folder: str, cells: int | None = None) -> VectorIndex:
        """Index the rows (id, embedding) of a table under a folder, as its newest version."""
        spark, path = table.sparkSession, f"{folder}/v-{uuid.uuid4().hex}"
        kind = dict(table.dtypes)["id"]
        rows = table.where("id is not null and embedding is not null").select("id", F.col("embedding").cast("array<double>").alias("embedding"))
        n = rows.count()
        cells = cells or int(np.clip(np.ceil(np.sqrt(n)), 1, MAX_CELLS))
        start = rows.select("embedding").orderBy(F.xxhash64("id", "embedding"), "embedding").limit(cells).toPandas()  # a bounded sample
        centroids = np.unique(units(start["embedding"]), axis=0) if len(start) else np.zeros((0, 1))
        sent = spark.sparkContext.broadcast(centroids)

        def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for a in range(0, len(frame), CHUNK_ROWS):
                    part = frame.iloc[a : a + CHUNK_ROWS]
                    own = units(part["embedding"])
                    cell = (own @ sent.value.T).argmax(axis=1)
                    far = np.sqrt(((own - sent.value[cell]) ** 2).sum(axis=1))
                    yield pd.DataFrame({"id": part["id"].astype(object), "embedding": list(own), "cell": cell, "far": far})

        placed = written(rows.mapInPandas(assign, f"id {kind}, embedding array<double>, cell int, far double"), "index-placed")
        sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).toPandas()  # a row for each of at most MAX_CELLS cells
        sizes["centroid"] = [centroids[c].tolist() for c in sizes["cell"]]
        named = spark.createDataFrame(list(sizes[["cell", "centroid", "n", "radius"]].itertuples(index=False, name=None)), "cell int, centroid array<double>, n long, radius double")

        def pack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"chunk": [key[1]], "n": [len(frame)], "body": [pickle.dumps((frame["id"].to_numpy(object), np.stack(frame["embedding"].to_numpy())), protocol=5)], "cell": [key[0]]})

        chunk = F.pmod(F.xxhash64("id", "embedding", F.monotonically_increasing_id()), F.ceil(F.col("n") / CHUNK_ROWS)).cast("int")  # repeated rows are dealt out too
        chunked = placed.join(F.broadcast(named.select("cell", "n")), "cell").select("id", "embedding", "cell", chunk.alias("chunk"))
        packed = chunked.groupBy("cell", "chunk").applyInPandas(pack, "chunk int, n long, body binary, cell int")
        packed.write.partitionBy("cell").parquet(f"{path}/rows")
        named.coalesce(1).write.parquet(f"{path}/cells")
        spark.createDataFrame([(path, kind)], "path string, id_type string").coalesce(1).write.mode("overwrite").json(f"{folder}/newest")
        return VectorIndex(spark, path, kind)

    @staticmethod
    def open(spark: SparkSession, folder: str) -> VectorIndex:
        row = spark.read.schema("path string, id_type string").json(f"{folder}/newest").first()
        if row is None:
            raise LookupError(f"no index in {folder}")
        return VectorIndex(spark, row["path"], row["id_type"])

    @staticmethod
    def drop(spark: SparkSession, folder: str) -> None:
        """Readers find no index any more; those that have opened one keep it."""
        spark.createDataFrame([], "path string, id_type string").write.mode("overwrite").json(f"{folder}/newest")

    def cells(self) -> DataFrame:
        return self.spark.read.schema("cell int, centroid array<double>, n long, radius double").parquet(f"{self.path}/cells")

    def rows(self) -> DataFrame:
        return self.spark.read.schema("chunk int, n long, body binary, cell int").parquet(f"{self.path}/rows")

    def _blocks(self, queries: DataFrame, places: tuple) -> DataFrame:
        """block, cell (the home) and the packed questions."""
        sent = self.spark.sparkContext.broadcast(places)

        def home(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names, centroids, _ = sent.value
            for frame in frames:
                own = units(frame["embedding"])
                yield pd.DataFrame({"id": frame["id"].astype(object), "embedding": list(own), "cell": names[(own @ centroids.T).argmax(axis=1)]})

        def pack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"block": [(int(key[0]) << 32) + int(key[1])], "cell": [key[0]], "questions": [pickle.dumps((frame["id"].to_numpy(object), np.stack(frame["embedding"].to_numpy())), protocol=5)]})

        asked = queries.where("id is not null and embedding is not null").select("id", F.col("embedding").cast("array<double>").alias("embedding"))
        asked = written(asked.mapInPandas(home, f"id {self.id_type}, embedding array<double>, cell int"), "index-questions")
        sizes = asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
        share = F.pmod(F.xxhash64("id", "embedding"), F.col("blocks")).cast("int")
        dealt = asked.join(F.broadcast(sizes), "cell").withColumn("part", share)
        return written(dealt.groupBy("cell", "part").applyInPandas(pack, "block long, cell int, questions binary"), "index-blocks")

    def _searched(self, pairs: DataFrame, k: int, floor: float | None) -> DataFrame:
        """pairs: block, cell, questions, kth. The rows found: block, query, id, similarity."""
        kind = f"block long, query {self.id_type}, id {self.id_type}, similarity double"
        names = [c.split()[0] for c in kind.split(", ")]
        shares = pairs.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("shares"))  # a row for each cell
        wanted = self.rows().join(F.broadcast(shares), "cell")  # only the cells asked for are read
        rows = wanted.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).select("cell", "chunk", "share", "body")
        chunks = self.rows().groupBy("cell").agg(F.max("chunk").alias("last"))
        dealt = pairs.join(F.broadcast(shares), "cell").join(F.broadcast(chunks), "cell").withColumn("share", F.pmod(F.xxhash64("block"), F.col("shares")).cast("int"))
        dealt = dealt.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("last")))).select("cell", "chunk", "share", "block", "questions", "kth")

        def search(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            out = [pd.DataFrame({c: [] for c in names})]
            if len(held):
                ids, rows = pickle.loads(held["body"].iloc[0])
                for block, questions, kth in zip(asked["block"], asked["questions"], asked["kth"], strict=True):
                    named, matrix = pickle.loads(questions)
                    least = _least(named, kth, floor)
                    q, found, score = best(named, matrix, ids, rows, k, least)
                    out.append(pd.DataFrame({"block": block, "query": named[q], "id": found, "similarity": score}))
            return pd.concat(out[1:] or out).astype({"query": object, "id": object})

        by = ["cell", "chunk", "share"]
        return dealt.groupBy(*by).cogroup(rows.groupBy(*by)).applyInPandas(search, kind)

    def search(self, queries: DataFrame, k: int, floor: float | None = None) -> DataFrame:
        """query, id, similarity and rank: of each query (id, embedding) the k rows most like it."""
        order = Window.partitionBy("query").orderBy(F.desc("similarity"), "id")
        top = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        cells = self.cells().orderBy("cell").toPandas()
        if not len(cells):
            return self.spark.createDataFrame([], f"query {self.id_type}, id {self.id_type}, similarity double, rank int")
        places = (cells["cell"].to_numpy(np.int32), np.stack(cells["centroid"].to_numpy()), cells["radius"].to_numpy(np.float64))
        blocks = self._blocks(queries, places)
        none = F.lit(None).cast(f"array<struct<query:{self.id_type},kth:double>>")
        first = written(top(self._searched(blocks.withColumn("kth", none), k, floor)), "index-home")
        pairs = self.pairs(blocks, first, places, k, floor)
        second = self._searched(pairs, k, floor)
        return top(first.drop("rank").unionByName(second)).select("query", "id", "similarity", F.col("rank").cast("int").alias("rank"))

    def pairs(self, blocks: DataFrame, first: DataFrame, places: tuple, k: int, floor: float | None) -> DataFrame:
        """The blocks with every cell but their home that a question's bound reaches: block, cell, questions, kth."""
        sent = self.spark.sparkContext.broadcast(places)
        kth = first.groupBy("block", "query").agg(F.min("similarity").alias("kth"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
        known = blocks.join(kth.groupBy("block").agg(F.collect_list(F.struct("query", "kth")).alias("kth")), "block", "left")  # BLOCK_ROWS questions, more or less

        def reach(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names, centroids, radius = sent.value
            for frame in frames:
                for block, home, questions, kth in zip(frame["block"], frame["cell"], frame["questions"], frame["kth"], strict=True):
                    named, matrix = pickle.loads(questions)
                    over = (matrix @ centroids.T + radius + SLACK >= _least(named, kth, floor)[:, None]).any(axis=0)
                    left = names[over & (names != home)]
                    yield pd.DataFrame({"block": block, "to": left})

        wanted = written(known.mapInPandas(reach, "block long, to int"), "index-pairs")
        return wanted.join(known.drop("cell"), "block").withColumnRenamed("to", "cell")


def _least(named: np.ndarray, kth: list | None, floor: float | None) -> np.ndarray:
    """What a row must reach for each question."""
    known = {} if kth is None else {r["query"]: r["kth"] for r in kth}
    low = -np.inf if floor is None else floor
    return np.array([max(known.get(i, -np.inf), low) for i in named.tolist()], np.float64)
