"""Language model: gradients, lanes, counts, probabilities, held-out gain."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from weftline.llm import lm, quality


def small(seed=0):
    rng = np.random.default_rng(seed)
    w = lm.begin(np.arange(3000, 0, -1).astype(float), 50.0, 40.0)
    return {k: v.astype(np.float64) + rng.normal(0, 0.2, v.shape) for k, v in w.items()}, rng


def test_gradients_are_the_derivatives():
    w, rng = small()
    given, target = rng.integers(lm.END, 400, (5, 4)), rng.integers(lm.END, 400, (5, 4))
    target[0, 1] = target[2, 0] = given[3, 1] = lm.UNKNOWN
    fresh, active = rng.random((5, 4)) < 0.3, np.array([4, 4, 3, 2, 1])

    def loss(w):
        h = np.full((4, lm.HIDDEN), 0.3)
        real = np.arange(4) < active[:, None]
        return -float(lm.window(w, given, target, fresh, active, h, False)[0][real].astype(np.float64).mean())

    grads = lm.window(w, given, target, fresh, active, np.full((4, lm.HIDDEN), 0.3), True)[2]
    for name, at in [("gates", (3, 5)), ("new", (2, 7)), ("input", (1, 30)), ("bias", (20,)), ("class", (4, 2)), ("class", (lm.HIDDEN, 1)), ("word", (int(target[1, 1]) // 64, lm.HIDDEN, int(target[1, 1]) % 64)), ("word", (int(target[0, 0]) // 64, 3, int(target[0, 0]) % 64)), ("embed", (int(given[1, 0]), 2))]:
        step, probe = 1e-2, {k: v.copy() for k, v in w.items()}
        probe[name][at] += step
        up = loss(probe)
        probe[name][at] -= 2 * step
        assert math.isclose((up - loss(probe)) / (2 * step), grads[name][at], rel_tol=0.05, abs_tol=2e-5), name


def test_a_document_scores_alike_in_any_company():
    w, rng = small(1)
    docs = [rng.integers(lm.END, 3000, n) for n in (1, 7, 200, 64, 65, 3)]
    ids, offsets = np.concatenate(docs), np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    together = lm.run(w, ids, offsets)
    alone = [lm.run(w, d, np.array([0, len(d)]))[0] for d in docs]
    assert np.allclose(together, alone, rtol=1e-4)


def plain_score(w, ids):
    """A document's log-probability, token by token, by the network's formulas."""
    h, before, total = np.zeros(lm.HIDDEN), lm.END, 0.0
    logistic = lambda a: 1 / (1 + np.exp(-a))
    softmax = lambda a: np.exp(a - a.max()) / np.exp(a - a.max()).sum()
    n = lm.HIDDEN
    for token in ids:
        x = w["embed"][before] @ w["input"] + w["bias"]
        z, r = logistic(x[:n] + h @ w["gates"][:, :n]), logistic(x[n : 2 * n] + h @ w["gates"][:, n:])
        h = (1 - z) * h + z * np.tanh(x[2 * n :] + (r * h) @ w["new"])
        state, (cls, word) = np.append(h, 1), divmod(int(token), lm.CLASS)
        total += np.log(softmax(state @ w["class"])[cls])
        if token != lm.UNKNOWN:
            total += np.log(softmax(state @ w["word"][cls])[word])
        before = int(token)
    return total


def test_documents_score_as_by_a_plain_loop(monkeypatch):
    w, rng = small(3)
    docs = [np.append(np.where(rng.random(n) < 0.3, lm.UNKNOWN, np.where(rng.random(n) < 0.7, rng.integers(lm.END, 120, n), rng.integers(lm.END, 3000, n))), lm.END) for n in (0, 3, 700, 150, 64)]
    ids, offsets = np.concatenate(docs), np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    for together, part in ((128, 512), (0, 7)):
        monkeypatch.setattr(lm, "TOGETHER", together)
        monkeypatch.setattr(lm, "PART", part)
        assert np.allclose(lm.run(w, ids, offsets), [plain_score(w, d) for d in docs], rtol=1e-4)


def test_commonest_breaks_a_range(spark):
    rows = [(i, 1000 if i < 3 else 7) for i in range(500)]
    counts = spark.createDataFrame(rows, "word long, n long")
    top = lm.commonest(counts, 200).collect()
    assert {r.word for r in top} >= {0, 1, 2} and 150 <= len(top) <= 200
    assert lm.commonest(counts, 2).count() <= 2 and lm.commonest(counts, 500).count() == 500 and lm.commonest(counts.limit(0), 5).count() == 0


def test_probabilities_sum_to_one():
    w, _ = small(2)
    ids = np.append(lm.UNKNOWN, np.arange(lm.END, lm.VOCABULARY))
    n = len(ids)
    log_p = lm.window(w, np.zeros((1, n), int), ids[None, :], np.ones((1, n), bool), np.array([n]), np.zeros((n, lm.HIDDEN), np.float32), False)[0]
    assert math.isclose(np.exp(log_p.astype(float)).sum(), 1, rel_tol=1e-3)


def corpus(n):
    rng = random.Random(6)
    tongues = [["".join(rng.choice(a) for _ in range(3)) for _ in range(40)] for a in ("abc", "xyz", "mno")]
    docs = []
    for i in range(n):
        own = rng.choice(tongues)
        docs.append((i, " ".join([rng.choice(own) for _ in range(rng.randint(1, 120))] + [f"rare{rng.randrange(400)}"]), "x", 1))
    return docs


def test_counts_base_and_gain(spark, monkeypatch):
    monkeypatch.setattr(lm, "COMMON", 60)
    docs = corpus(700) + [(900, None, "", 1), (901, "", "", 1), (902, "Abc " * 9000, "", 1), (903, "née\x0bTEST", "", 1), (None, "abc abc", "", 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, words string, n int")
    got = lm.score_documents(frame, quality.id_remainder("doc_id", 7) != 2).toPandas()
    assert len(got) == len(docs)
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter()
    for i, t, *_ in docs:
        if i is not None and not held(i):
            c.update([*words(t), "\0end"])
    n, v = sum(c.values()), len(c)
    text = {i: t for i, t, *_ in docs}
    for r in got.itertuples():
        tokens = [*words(text[None if np.isnan(r.doc_id) else int(r.doc_id)]), "\0end"]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(c[t] > 0 for t in tokens), n)
        assert math.isclose(r.base_score, sum(math.log10((c[t] + 1) / (n + v + 1)) for t in tokens), rel_tol=1e-9)
    out = got[got.doc_id.map(lambda i: not np.isnan(i) and held(int(i)) and i < 700)]
    assert len(out) > 50 and out.score.sum() > out.base_score.sum() and (got.score < 0).all()


def test_no_training_rows_and_no_rows(spark):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    got = lm.score_documents(frame, F.lit(False)).first()
    assert (got.n_tokens, got.n_known, got.train_tokens, got.base_score) == (3, 0, 0, 0.0)
    assert lm.score_documents(frame.limit(0), F.lit(True)).count() == 0


def test_a_very_long_document_needs_memory_in_proportion():
    import tracemalloc

    n = 2_000_000
    ids = np.random.default_rng(1).integers(lm.FIRST, lm.VOCABULARY, n).astype(np.int32)
    lane, first, ends = lm.lanes(np.array([n]))
    assert len(ends) == 1 and ends[0] == n
    many = np.array([0, n // 2, n // 2 + 3, n])  # the windows of a long lane and of a short one
    w = lm.begin(np.ones(lm.VOCABULARY - lm.FIRST), 1.0, 1.0)
    tracemalloc.start()
    stop = {"steps": 0}
    real = lm.window

    def some(*given):
        stop["steps"] += 1
        if stop["steps"] > 300:
            raise StopIteration
        return real(*given)

    lm.window = some
    try:
        lm.run(w, ids, many)
    except StopIteration:
        pass
    finally:
        lm.window = real
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()
