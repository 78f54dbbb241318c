"""The pipeline's stages in order, each against a plain version, and the query registry."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weftline.llm import mixing, neardup, packing

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, mix_slot int"
CLASHING = ["__score", "__SCORE_", "__neardup_text", "__mix_position", "__mix_note", "__rank_n", "score", "label", "part", "file", "at"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    path = tmp_path_factory.mktemp("tables")
    docs, labels = [], []
    for i in range(500):
        words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(rng.randint(20, 60))]
        toxic, junk = i % 9 == 0, i % 7 == 0
        if toxic:
            words[rng.randrange(len(words))] = "grumfous"
        if junk:
            words = [w + "###" for w in words]
        docs.append((i, " ".join(words), "en", f"src{i % 3}" if i % 2 else "src0", 1, 3))
        labels.append((i, int(not junk), int(toxic)))
    good = docs[1]
    docs += [(1000, good[1], "en", None, 1, 3), (1001, good[1] + " more", "en", "src1", 1, 3), (1002, None, None, None, None, None), (good[0], good[1], "en", "src0", 1, 3), (None, docs[2][1] + " abcd hgfe", "en", "src1", 1, 3)]
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = docs.toPandas()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        given, docs = docs, neardup.materialize(stage(spark, docs, folder), f"test-{name}")
        after = docs.toPandas()
        assert list(after.columns) == list(before.columns)
        texts = before.text.fillna("")
        if name == "toxicity":
            assert len(after) == (~texts.str.contains("grumfous")).sum()
        if name == "quality":
            kept = before[~texts.str.contains("###")]
            assert len(after) in (len(kept), len(kept) - before.text.isna().sum())
        if name == "near_duplicates":
            assert (after.doc_id == 1).sum() == 1 and not after.doc_id.isin([1000, 1001]).any()
            assert after.doc_id.isna().sum() == 1 and len(after) == len(before) - 3
        if name == "mixing":
            assert sorted(map(str, after.itertuples(index=False))) == sorted(map(str, before.itertuples(index=False)))
            files = [pd.read_parquet(f.removeprefix("file://")) for f in sorted(docs.inputFiles())]
            order = mixing.mix_sources(given.drop("mix_slot")).orderBy("mix_position").toPandas()
            assert pd.concat(files).doc_id.fillna(-1).tolist() == order.doc_id.fillna(-1).tolist()
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).toPandas()
    assert set(packed.doc_id.dropna()) == set(before.doc_id.dropna())
    assert (packed.groupby("sequence_id").length.sum() <= packing.CAPACITY).all()


def test_stages_keep_columns_with_helpers_names(spark, folder):
    docs = neardup.materialize(spark.read.parquet(f"{folder}/documents.parquet").withColumns({c: F.concat(F.lit(c), F.coalesce("doc_id", F.lit(-1))) for c in CLASHING}), "test-clash")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = neardup.materialize(stage(spark, docs, folder), f"test-clash-{name}")
        assert after.schema.simpleString() == docs.schema.simpleString()
        assert after.where(" or ".join(f"`{c}` <> concat('{c}', coalesce(doc_id, -1))" for c in CLASHING)).count() == 0 and after.count() > 300
        docs = after
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() >= docs.count()


def test_packing_follows_the_mixture(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(packing, "PARTITION_ITEMS", 20)
    rows = [(i, " ".join(["word"] * 300), "en", f"s{i % 3}", 1, 1) for i in range(200)]
    spark.createDataFrame(rows, COLUMNS).repartitionByRange(5, F.desc("doc_id")).sortWithinPartitions(F.desc("doc_id")).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    got = corpus_pipeline.packing_stage(spark, docs, "").toPandas()
    whole = got.groupby("sequence_id").doc_id.agg(["min", "max"])
    assert len(got) == 200 and ((whole["max"] - whole["min"]) < 60).all()
    first = whole[whole.index < 1 << 56].sort_index()
    assert list(first["max"]) == sorted(first["max"], reverse=True) or (first["max"].diff().dropna() <= 20).all()


def test_run_is_the_stages(spark, folder):
    rows = corpus_pipeline.run(spark, folder)
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and rows.count() > 300


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registry():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert [n for k in range(1, 14) for n in names if n.startswith(f"op{k}_")] and "pipeline" in names
    assert len([n for n in names if n.startswith("op")]) == 13 and set(__spark_entry__.oracle_sql()) <= set(names)
