"""One graph behind one object: load or ingest it, ask it, trace what an answer used."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions.text import intent as classified
from weftline.functions.text import one_line
from weftline.operators import folds, graph
from weftline.operators.documents import context_lines
from weftline.operators.entities import extract_entities
from weftline.operators.records import named_seeds
from weftline.options import DEFAULTS, Options
from weftline.plans import lexical, retrieval
from weftline.sources import landing
from weftline.sources.edges import EdgeStore
from weftline.sources.shared import written


class Engine:
    """Tables: entity (id, label, type, ts), relates_to (src, dst, relation, confidence), document (id, path, content), mentions (doc, entity), and vectors (id, embedding) if there are any."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], options: Options = DEFAULTS) -> None:
        self.spark, self.tables, self.options = spark, dict(tables), options
        self._store: EdgeStore | None = None

    @classmethod
    def open(cls, spark: SparkSession, folder: str, version: int | None = None, options: Options = DEFAULTS) -> Engine:
        return cls(spark, landing.read_snapshot(spark, folder, version), options)

    def publish(self, folder: str, version: int) -> None:
        landing.write_snapshot(self.tables, folder, version)

    def ingest(self, new: dict[str, DataFrame]) -> Engine:
        """The graph with a batch folded in: first names stay, later documents win, the dearest relation of a pair counts."""
        old = self.tables
        stacked = lambda name: old[name].withColumn("seq", F.lit(0)).unionByName(new[name].withColumn("seq", F.lit(1))) if name in new else old[name].withColumn("seq", F.lit(0))
        entity = folds.upsert_entities(stacked("entity"))
        document = folds.upsert_documents(stacked("document"))
        mentions = old["mentions"].unionByName(new["mentions"]) if "mentions" in new else old["mentions"]
        tables = {"entity": entity, "relates_to": folds.upsert_relations(stacked("relates_to"), entity), "document": document, "mentions": folds.add_mentions(mentions, document, entity)}
        return Engine(self.spark, old | tables, self.options)

    @property
    def edges(self) -> EdgeStore:
        """The edges by hashed origin, written before the first walk."""
        if self._store is None:
            self._store = EdgeStore.write(self.tables["relates_to"], self.tables["entity"])
        return self._store

    def _intent(self, question: str, named: bool = False) -> str:
        """One row on the driver: a question is a value, not data."""
        return self.spark.range(1).select(classified(F.lit(question), F.lit(named)).alias("i")).first()["i"]["intent"]

    def find_entity(self, name: str, vector: Sequence[float] | None = None, limit: int = 5) -> DataFrame:
        """Entities of this label, or where there are none the nearest vectors of at least 0.4."""
        exact = self.tables["entity"].where(F.lower("label") == name.lower()).select("id", "label", "type", F.lit(1.0).alias("score")).orderBy("id").limit(limit)
        if vector is None or exact.limit(1).count():
            return exact
        near = retrieval.vector_search(self.tables["vectors"], vector, limit, 0.4)
        return near.join(self.tables["entity"], "id").select("id", "label", "type", F.round("similarity", 4).alias("score"))

    def retrieve(self, question: str, now: str, vector: Sequence[float] | None = None) -> DataFrame:
        """Both arms fused. Seeds are entities that the question names, else the best vector hits."""
        entity = self.tables["entity"]
        empty = self.spark.createDataFrame([], "id string, similarity double")
        near = retrieval.vector_search(self.tables["vectors"], vector, self.options.total_k) if vector is not None and question.strip() else empty
        seeds = retrieval.select_seeds(self.named(question), near, self.options)
        hits = retrieval.best_path_walk(self.edges, entity, seeds, self.options)
        return retrieval.fuse(near, hits, entity, self._intent(question), F.to_timestamp(F.lit(now)), self.options)

    def named(self, question: str) -> DataFrame:
        """Entities whose label is a word of the question, of three characters or more and not a number."""
        words = F.transform(F.regexp_extract_all(F.lit(question), F.lit(r"(?U)\w[\w.-]*\w"), F.lit(0)), F.lower)
        usable = F.filter(words, lambda w: (F.length(w) >= 3) & ~w.rlike(r"^\d+$"))
        return self.tables["entity"].where(F.array_contains(usable, F.lower("label"))).select("id", "label")

    def route(self, question: str, seeds: DataFrame | None = None, vector: Sequence[float] | None = None, vectors: DataFrame | None = None) -> DataFrame:
        """The router's ranking: seeds stay at 1, each node expands once. With nothing named or linked, the nearest vectors of at least ``find_at`` are the seeds."""
        start = (self.linked(question, vectors) if seeds is None else seeds).select("id").distinct()
        if vector is not None and not start.limit(1).count():
            start = retrieval.vector_search(self.tables["vectors"], vector, self.options.seed_top, self.options.find_at).select("id")
        return retrieval.router_walk(self.edges, self.tables["entity"], start, self.options).orderBy(F.desc("score"), "id")

    def impact(self, name: str, hops: int = 3) -> DataFrame:
        return retrieval.impact(self.edges, self.tables["entity"], self.find_entity(name, limit=1).select("id"), hops, self.options)

    def impact_report(self, name: str, hops: int = 3) -> DataFrame:
        """The same with the documents that support each."""
        return retrieval.impact_report(self.impact(name, hops), self.tables["mentions"], self.tables["document"])

    def lexical(self, question: str, top: int = 10) -> DataFrame:
        """Nodes by the words of their label and documents."""
        chunks = self.tables["mentions"].join(self.tables["document"].select(F.col("id").alias("doc"), "content"), "doc").select(F.col("entity").alias("origin"), "content")
        path = F.when(F.col("type") == "File", F.col("label"))
        return lexical.lexical_trace(self.tables["entity"].select("id", F.col("label").alias("text"), "ts", path.alias("path")), self.tables["relates_to"], question, top, chunks)

    def local_trace(self, question: str, repository: str, top: int = 10) -> DataFrame:
        """The items of a lexical trace with their text, an answer that cites the first of them, and how much of each it used."""
        chunks = self.tables["mentions"].join(self.tables["document"].select(F.col("id").alias("doc"), "content"), "doc").select(F.col("entity").alias("origin"), F.col("doc").alias("seq"), "content")
        chunks = chunks.withColumn("seq", F.row_number().over(Window.partitionBy("origin").orderBy("seq")))
        path = F.when(F.col("type") == "File", F.col("label"))
        nodes = self.tables["entity"].select("id", F.col("label").alias("text"), "ts", path.alias("path"), "label", F.lit(None).cast("string").alias("uri"))
        found = lexical.lexical_trace(nodes.select("id", "text", "ts", "path"), self.tables["relates_to"], question, top, chunks.drop("seq"), repository)
        return lexical.answered(written(found, "trace"), nodes, chunks, question, repository)

    def linked(self, question: str, vectors: DataFrame | None = None) -> DataFrame:
        """Seeds that a question names: entities that its words or its extracted names are the label of; a name that is nobody's label links to the
        nearest entity of at least ``find_at``. ``vectors``: name and embedding of the question's names (an embedder's, if there is one)."""
        asked = self.spark.createDataFrame([("q", question)], "doc string, content string")
        names = extract_entities(asked).select(F.col("text").alias("name")).distinct()
        near = self.spark.createDataFrame([], "name string, id string, similarity double")
        if vectors is not None and "vectors" in self.tables:
            found = retrieval.vector_search_all(self.tables["vectors"], vectors.select(F.col("name").alias("id"), "embedding"), 1)
            near = found.select(F.col("query").alias("name"), "id", "similarity")
        seeds = named_seeds(names, self.tables["entity"], near.join(names, "name", "left_semi"), self.options.find_at)
        return self.named(question).select("id").unionByName(seeds.select("id")).distinct()

    def subgraph(self, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
        nodes = graph.subgraph_nodes(self.tables["relates_to"], self.tables["entity"], ids)
        return nodes, graph.subgraph_edges(self.tables["relates_to"], nodes)

    def suggestions(self, limit: int = 4) -> DataFrame:
        hubs = graph.hubs(self.tables["relates_to"], self.tables["entity"], 4 * limit)
        return lexical.suggestions(hubs, limit)

    def citations(self, ids: DataFrame, per_entity: int = 2, width: int = 280) -> DataFrame:
        """id, doc, path and snippet of the first documents of each entity that are not blank."""
        found = graph.documents_for(ids, self.tables["mentions"], self.tables["document"]).select("id", F.posexplode(F.slice("documents", 1, per_entity)).alias("n", "d")).select("id", "n", "d.doc", "d.path")
        return found.join(self.tables["document"].select(F.col("id").alias("doc"), "content"), "doc").withColumn("snippet", one_line(F.col("content"), width)).where("snippet <> ''").drop("content")

    def context(self, question: str, hits: DataFrame) -> DataFrame:
        """One text for a prompt from ranked hits (id, label, score): each document once."""
        ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "id")))  # at most total_k rows
        docs = ranked.join(self.tables["mentions"].withColumnRenamed("entity", "id"), "id").join(self.tables["document"].select(F.col("id").alias("doc"), "content"), "doc")
        return context_lines(docs.select(F.lit(question).alias("query"), "rank", "id", "label", "doc", "content"))
