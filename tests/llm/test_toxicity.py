"""Toxicity: exact neighbours, held-out accuracy, edge cases."""

import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from weftline.llm import _bytes, quality, toxicity


def plain_counts(text):
    """Words (runs of letters and digits, A-Z lower-cased) and their beginnings."""
    words = re.findall(rb"[a-z0-9\x80-\xff]+", (text or "").encode().lower())
    return Counter([*words, *[(k, w[:k]) for w in words for k in toxicity.PREFIXES if len(w) >= k]])


def plain_search(examples, labels, corpus, query):
    """Places and cosines of a query's nearest examples, by the formulas over whole texts."""
    counts, every = [plain_counts(t) for t in examples], [plain_counts(t) for t in corpus]
    scale = sum(labels) / max(len(labels) - sum(labels), 1)
    weight = {}
    for t in set().union(*counts):
        a, b = (sum(t in c for c, y in zip(counts, labels, strict=True) if y == side) for side in (1, 0))
        weight[t] = (math.log((1 + len(corpus)) / (1 + sum(t in c for c in every))) + 1) * math.log2(2 + a / max(1, b * scale))

    def unit(c):
        v = {t: (1 + math.log(n)) * weight[t] for t, n in c.items() if t in weight}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    units, q = [unit(c) for c in counts], unit(plain_counts(query))
    cosines = [sum(x * u.get(t, 0) for t, x in q.items()) for u in units]
    order = sorted((k for k in range(len(examples)) if cosines[k] > 1e-9), key=lambda k: (-round(cosines[k], 7), k))
    return [(k, cosines[k]) for k in order[: toxicity.NEIGHBOURS]]


@pytest.mark.parametrize(("dense", "postings"), [(8, 50), (0, 1 << 18), (10_000, 1 << 18)])
def test_nearest_is_brute_force_over_whole_texts(monkeypatch, dense, postings):
    for name, value in (("BLOCK", 4), ("DENSE", dense), ("POSTINGS", postings), ("NEIGHBOURS", 6)):
        monkeypatch.setattr(toxicity, name, value)
    rng = random.Random(dense)
    text = lambda: " ".join(rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(rng.randint(0, 25)))
    examples, queries = [text() for _ in range(70)] + [""], [text() for _ in range(60)] + ["", None, "unknown words"]
    labels = [rng.randrange(2) for _ in examples]
    corpus = examples + queries
    hashed = toxicity.hashed_counts([t.encode() for t in examples])
    vocabulary = np.unique(hashed.terms)
    table = _bytes.Places(vocabulary)
    encoded = [None if t is None else t.encode() for t in corpus]
    frequencies = np.bincount(toxicity.known_counts(encoded, table).terms, minlength=len(vocabulary))
    numbered = toxicity.Counts(hashed.offsets, np.searchsorted(vocabulary, hashed.terms), hashed.times)
    index = toxicity.build_index(np.arange(len(examples)), np.array(labels), numbered, vocabulary, frequencies, len(corpus), (600, 60))
    for query, (at, cosines) in zip(queries, index.ready().nearest(toxicity.known_counts(encoded[len(examples) :], table), toxicity.NEIGHBOURS), strict=True):
        expected = plain_search(examples, labels, corpus, query)
        assert np.allclose(cosines, [c for _, c in expected], atol=1e-6)
        clear = [k for (k, c), (_, n) in zip(expected, expected[1:], strict=False) if c - n > 1e-6]
        assert set(clear) <= set(index.ids[at].tolist())


def test_isotonic_steps():
    x, y = np.array([0.1, 0.1, 0.2, 0.3, 0.4, 0.4]), np.array([0.0, 1.0, 0.0, 1.0, 1.0, 1.0])
    points, values = toxicity.isotonic(x, y, np.array([1.0, 1.0, 2.0, 1.0, 1.0, 1.0]))
    # 0.1 (mean 0.5) and 0.2 (mean 0) break the order: one pool of weight 4, then 0.3 and 0.4.
    assert np.allclose(points, [0.15, 1.1 / 3])
    assert np.isclose(values[0], 1.5 / 5) and (np.diff(values) >= 0).all()


def corpus(n):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("abcdef") for _ in range(4)) for _ in range(rng.randint(5, 80))]
        bad = rng.random() < 0.2
        if bad:
            words[rng.randrange(len(words))] = rng.choice(["Grumf", "grumf,", "snork!"])
        docs.append((i, " ".join(words), "x", 0.5))
        labels.append((i, int(bad), "x"))
    return docs, labels


def run(spark, docs, labels):
    documents = spark.createDataFrame(docs, "doc_id long, text string, terms string, score double")
    return toxicity.toxic_scores(documents, spark.createDataFrame(labels, "doc_id long, toxic int, text string"), quality.id_remainder("doc_id", 4) != 2).toPandas()


def test_finds_planted_words_and_leaves_clean_ones(spark):
    docs, labels = corpus(1200)
    extra = [(5000, None, None, None), (5001, "", None, None), (None, "grumf you", None, None), (5002, "word " * 50000, None, None), (5003, "x snork", None, None), (5003, "x snork", None, None)]
    got = run(spark, docs + extra, [*labels, (7, None, None), (None, 1, None), (9999, 1, None)])
    assert len(got) == len(docs) + len(extra)
    truth = {i: bad for i, bad, _ in labels}
    known = got[got.doc_id.isin(truth)]
    assert ((known.score >= 0.3).astype(int) == known.doc_id.map(truth)).mean() > 0.99
    by_id = got.groupby("doc_id").score.first()
    assert by_id[5000] < 0.3 and by_id[5001] < 0.3 and by_id[5002] < 0.3 and by_id[5003] >= 0.3
    assert got[got.doc_id.isna()].score.iloc[0] >= 0.3
    assert all(len(e) == len(c) for e, c in zip(got.evidence, got.cosines, strict=True))


def test_no_labels_and_no_rows(spark):
    assert set(run(spark, [(1, "a", "", 0.0)], []).score) == {0.5}
    assert len(run(spark, [], [])) == 0
    assert set(run(spark, [(1, "a", "", 0.0)], [(1, 0, "")]).score < 0.5) == {True}


def test_a_worker_keeps_one_copy_of_the_index_and_searches_few_texts_at_a_time():
    texts = [f"word{i} word{i + 1} common{i % 40}".encode() for i in range(1200)]
    counts = toxicity.hashed_counts(texts)
    vocabulary = np.unique(counts.terms)
    counts = toxicity.Counts(counts.offsets, np.searchsorted(vocabulary, counts.terms).astype(np.int32), counts.times)
    ids = np.arange(len(texts))
    index = toxicity.build_index(ids, ids % 2, counts, vocabulary, np.bincount(counts.terms, minlength=len(vocabulary)), len(texts), (600, 600))
    tracemalloc.start()
    most = index.ready()._most
    grown = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert grown < index.dense.nbytes / 2
    assert index.ready()._most is most  # not worked out again in the worker's next task
    assert max(b - a for a, b in _bytes.groups(texts, toxicity.GROUP_BYTES, toxicity.GROUP_TEXTS)) == toxicity.GROUP_TEXTS
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(texts, pa.binary())], names=["doc_id", "text"])
    parts = list(_bytes.pieces([batch], 1, size=toxicity.GROUP_BYTES, many=toxicity.GROUP_TEXTS))
    assert pa.Table.from_batches(parts).column("doc_id").to_pylist() == ids.tolist()
    assert max(p.num_rows for p in parts) == toxicity.GROUP_TEXTS
