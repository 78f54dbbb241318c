"""Packing against the tokenizer itself and the rules of a packing."""

import zlib

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
from weftline.llm import packing


def check(got, capacity):
    for _, part in got.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert part.length.sum() <= capacity
        assert list(part.offset) == [0, *part.length.cumsum()[:-1]]


def test_pieces_are_the_tokenizers(spark):
    texts = ["Hello, WORLD! don't", None, "", "a<|endoftext|>b é’s İ x.,", "word " * 9000, "tab\tline\n nbsp"]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(1, None, "x", 1), (None, "no id", "x", 1)]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string, piece string, length long")).toPandas()
    check(got, packing.CAPACITY)
    own = packing.WordTokenizer(packing.default_path()).tokenizer
    for i, t in enumerate(texts):
        ids = np.array([*own.encode(t or "", add_special_tokens=False).ids, packing.END_ID], "<u4")
        part = got[got.doc_id == i].sort_values("piece").drop_duplicates("piece")
        assert list(part.start) == list(range(0, len(ids), packing.CAPACITY))
        assert list(part.ids_crc32) == [zlib.crc32(ids[s : s + packing.CAPACITY].tobytes()) for s in part.start]
    assert (got.doc_id == 1).sum() == 2 and got.doc_id.isna().sum() == 1


def test_levels_merge_and_stay_near_the_bound(spark, monkeypatch):
    monkeypatch.setattr(packing, "PARTITION_ITEMS", 60)
    rng = np.random.default_rng(1)
    rows = [(i, 0, 0, int(n), 0) for i, n in enumerate(rng.integers(1, 1500, 2000))]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack_pieces(pieces).toPandas()
    check(got, packing.CAPACITY)
    assert len(got) == 2000 and got.sequence_id.nunique() <= 1.01 * sum(r[3] for r in rows) / packing.CAPACITY + 2


def test_best_fit_prefers_the_fullest_bin():
    bins, offsets, fill = packing.best_fit(np.array([6, 5, 4, 5]), 10)
    assert list(fill) == [10, 10] and bins[0] == bins[2] and list(offsets) == [0, 0, 6, 5]


def test_empty(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def plain_best_fit(lengths, capacity):
    """Longest first, into the fullest bin that has room, found by looking at all."""
    fill = []
    for size in sorted(lengths, reverse=True):
        fits = [k for k, f in enumerate(fill) if f + size <= capacity]
        if fits:
            fill[max(fits, key=lambda k: fill[k])] += size
        else:
            fill.append(size)
    return sorted(fill)


def test_best_fit_is_the_plain_one():
    rng = np.random.default_rng(4)
    for n in (0, 1, 7, 200, 400):
        lengths = np.minimum(rng.geometric(0.05, n), 100)
        bins, offsets, fill = packing.best_fit(lengths, 100)
        assert sorted(fill.tolist()) == plain_best_fit(lengths.tolist(), 100)
        assert all(fill[k] == lengths[bins == k].sum() <= 100 for k in range(len(fill)))
