"""A corpus pipeline: toxicity, quality, near-duplicates, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet and read again as the next
stage's ``docs``. All but the last give the columns of ``docs``. Filters learn from the labels in sf_dir of documents
that are in ``docs``, with the same held-out rows as the single operators. The mixing stage's decision is the order of
the rows in its files, and packing follows it: sequences hold documents of one stretch of that order. Null, empty and repeated rows are treated as the operators' own docstrings say; a row with a null
id passes every filter that its text passes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm import mixing, neardup, packing, quality, toxicity
from weftline.llm._spark import fresh, materialize, read


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.3."""
    index = toxicity.train(docs, read(spark, sf_dir, "labels", "doc_id", "toxic"), quality.id_remainder("doc_id", 4) != 2)
    score = fresh(docs, "__score")
    return toxicity.score_texts(docs, index, score).where(F.col(score) < 0.3).select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more."""
    trees = quality.train(docs, read(spark, sf_dir, "labels", "doc_id", "quality"), quality.id_remainder("doc_id", 3) != 1)
    score = fresh(docs, "__score")
    return quality.classify_texts(docs, trees, score).where(F.col(score) >= 0.5).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (sets of five words' shingles of similarity 0.80 or more): that of the least id. Rows go, never all of an id."""
    return neardup.without_duplicates(docs, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents, in files ordered by their place in the mixture."""
    names = tuple(fresh(docs, n) for n in ("__mix_block", "__mix_slot", "__mix_position"))
    mixed, place = mixing.mix_sources(docs, names=names), names[2]
    return mixed.repartitionByRange(place).sortWithinPartitions(place).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of 4096 tokens, which follow the order of the rows in the files of ``docs``."""
    rows = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"))
    files = rows.groupBy("file").agg((F.max("at") + 1).alias("n"))  # a row for each file
    files = files.select("file", (F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("file")) - F.col("n")).alias("before"))
    return packing.pack_documents(rows.join(F.broadcast(files), "file"), position=F.col("before") + F.col("at"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The classifiers, min-hashes and the tokenizer are not SQL: tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
