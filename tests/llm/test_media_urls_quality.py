"""Media round trips, URL rules against brute force, quality on held-out rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import media, quality, urlfilter


def test_media_round_trip_and_fingerprints(spark):
    texts = [None, "", "é" * 288, "é" * 289, "word " * 40000, "a", "a"]
    frame = spark.createDataFrame([(i, t, b"x", [1]) for i, t in enumerate(texts)] + [(None, "a", b"x", [1])], "doc_id long, text string, media binary, times array<int>")
    full = {r.doc_id: r for r in media.media_columns(frame).collect()}
    short = media.media_features(frame).collect()
    assert len(short) == 8
    for r in short:
        raw = (texts[r.doc_id] or "").encode() if r.doc_id is not None else b"a"
        padded = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest())
        assert r.tail_crc32 == zlib.crc32(padded[-32:])
        one = full[r.doc_id]
        assert media.from_wav(bytes(one.media)) == padded and r.media_bytes == len(one.media) and r.media_sha256 == hashlib.sha256(one.media).hexdigest()
        assert r.feature == one.feature == media.feature(np.array(one.times, np.int64), np.array(one.codes, np.int64))
        assert r.times == one.times and r.codes == one.codes
    assert len({r.feature for r in short if r.doc_id in (5, 6, None)}) == 1 and full[4].times == sorted(full[4].times) and len(full[4].codes) > 100
    assert media.media_features(frame.limit(0)).count() == 0


def plain_fingerprint(samples):
    """Peak pairs by loops over frames, bins and an explicit transform."""
    turns = np.exp(-2j * np.pi * np.outer(np.arange(289), np.arange(576)) / 576)
    tops = []
    for at in range(0, len(samples), 576):
        frame = (np.frombuffer(samples[at : at + 576], np.uint8) - 128.0) * np.hanning(576)
        power = np.round(np.abs(turns @ frame), 3)
        local = [k for k in range(1, 288) if power[k] > power[k - 1] and power[k] >= power[k + 1]]
        tops.append(sorted(local, key=lambda k: (-power[k], k))[: media.PEAKS])
    found = [(i, a << 20 | b << 8 | d) for d in range(1, media.FAN_OUT + 1) for i in range(len(tops) - d) for a in tops[i] for b in tops[i + d]]
    return sorted(found)


@pytest.mark.parametrize("chunk", [4096, 2])
def test_fingerprint_is_the_plain_one(monkeypatch, chunk):
    monkeypatch.setattr(media, "CHUNK", chunk)
    rng = random.Random(1)
    for text in ("short", " ".join(rng.choice(["the", "wave", "of", "é", "xylophone"]) for _ in range(700))):
        samples = media.from_wav(media.to_wav(text.encode()))
        times, codes = media.pairs(media.peaks(samples))
        assert list(zip(times.tolist(), codes.tolist(), strict=True)) == plain_fingerprint(samples)


def test_peaks_of_a_tone():
    t = np.arange(576 * 3)
    samples = np.round(128 + 60 * np.sin(2 * np.pi * 40 * t / 576)).astype(np.uint8).tobytes()
    assert (media.peaks(samples)[:, 0] == 40).all()


RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"), ("block", "www.example.com", "/de/x")]


def judged(url):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_urls_are_brute_force(spark):
    rng = random.Random(4)
    hosts = ["net", "example.net", "a.b.Example.NET", "xexample.net", "example.com", "WWW.example.com", "org", "é.org", ".net", "a.net:80", "", "com"]
    paths = ["", "/", "/en", "/en/", "/EN/", "/en/1?x=/de/", "/de/x#y", "/de/", "/fr/é", "?q=/en/", "#/de/", "//en/"]
    urls = [f"{rng.choice(['http', 'https', 'x'])}://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(400)] + [None, "", "example.net/en/", "a://b://net/", "://net/"]
    frame = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(urls)] + [(0, urls[0], "x", 1), (None, urls[0], "x", 1)], "page_id long, url string, host string, head int")
    got = urlfilter.judge_urls(frame, RULES).collect()
    assert len(got) == len(urls) + 2
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == judged(urls[r.page_id or 0])
    assert urlfilter.judge_urls(frame.limit(0), RULES).count() == 0 and urlfilter.judge_urls(frame, []).where("rule is null and verdict = 'allow'").count() == len(urls) + 2


def test_rules_beyond_broadcast(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "BROADCAST_RULES", 1)
    frame = spark.createDataFrame([(1, "http://a.example.net/en/x", 0)], "page_id long, url string, n int")
    assert urlfilter.judge_urls(frame, RULES).first().rule == "example.net/en/"


def quality_corpus(n):
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(10, 80))]
        kind = rng.randrange(6)
        text = {0: " ".join(w + "###" for w in words), 1: words[0] * 1 + (" " + words[0]) * 60, 2: " ".join(words).upper() + "!!"}.get(kind, " ".join(words) + ".")
        docs.append((i, text, 1.0, "x"))
        labels.append((i, int(kind > 2), None))
    return docs, labels


def test_quality_held_out(spark):
    docs, labels = quality_corpus(900)
    extra = [(2000, None, 0.0, ""), (2001, "", 0.0, ""), (2002, "x" * 300000, 0.0, ""), (2002, "x" * 300000, 0.0, ""), (None, docs[0][1], 0.0, "")]
    documents = spark.createDataFrame(docs + extra, "doc_id long, text string, log_words double, score string")
    rated = spark.createDataFrame([*labels, (3, None, 1), (None, 1, 1), (7777, 1, 1)], "doc_id long, quality int, toxic int")
    held = quality.id_remainder("doc_id", 3) == 1
    trees = quality.train(documents, rated, ~held)
    got = quality.classify(documents, trees).withColumn("held", held).toPandas()
    assert len(got) == len(docs) + len(extra) and got.score.between(0, 1).all()
    truth = dict((i, q) for i, q, _ in labels)
    out = got[got.held & got.doc_id.isin(truth)]
    assert ((out.score >= 0.5).astype(int) == out.doc_id.map(truth)).mean() > 0.98
    inline = quality.classify_texts(documents, trees).select("doc_id", "log_words", "score", "__score").toPandas()
    assert sorted(inline["__score"]) == sorted(got.score)


@pytest.mark.parametrize(("labels", "score"), [([], 0.5), ([(1, 1, 0), (2, 1, 0)], None)])
def test_quality_without_both_labels(spark, labels, score):
    documents = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    trees = quality.train(documents, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), F.lit(True))
    got = {r.score for r in quality.classify(documents, trees).collect()}
    assert len(got) == 1 and (score is None or got == {score})
    assert quality.classify(documents.limit(0), trees).count() == 0


def plain_boost(x, y):
    """Boosting by loops: every node tries every cut of every feature, rows walk their trees one by one."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, quality.BINS + 1)[1:-1])) for j in range(x.shape[1])]
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    margin = np.full(len(y), np.log(share / (1 - share)))

    def grow(rows, g, h, depth):
        if depth == 0:
            return -quality.RATE * g[rows].sum() / (h[rows].sum() + quality.L2)
        best, cut = 1e-9, None
        value = lambda r: g[r].sum() ** 2 / (h[r].sum() + quality.L2)
        for j, points in enumerate(cuts):
            for point in points:
                left, right = rows[x[rows, j] <= point], rows[x[rows, j] > point]
                if h[left].sum() >= 1 and h[right].sum() >= 1 and value(left) + value(right) - value(rows) > best + 1e-9:
                    best, cut = value(left) + value(right) - value(rows), (j, point)
        if cut is None:
            return grow(rows, g, h, depth - 1) if depth > 1 else -quality.RATE * g[rows].sum() / (h[rows].sum() + quality.L2)
        side = x[rows, cut[0]] > cut[1]
        return (*cut, grow(rows[~side], g, h, depth - 1), grow(rows[side], g, h, depth - 1))

    def walk(tree, row):
        while isinstance(tree, tuple):
            tree = tree[3] if row[tree[0]] > tree[1] else tree[2]
        return tree

    for _ in range(quality.TREES):
        p = 1 / (1 + np.exp(-margin))
        tree = grow(np.arange(len(y)), p - y, np.maximum(p * (1 - p), 1e-9), quality.DEPTH)
        margin += [walk(tree, row) for row in x]
    return 1 / (1 + np.exp(-margin))


def test_trees_are_a_plain_booster(monkeypatch):
    for name, value in (("TREES", 5), ("BINS", 8), ("DEPTH", 3)):
        monkeypatch.setattr(quality, name, value)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 4)).round(2)
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] + 0.3 * rng.normal(size=300) < 0)).astype(float)
    assert np.allclose(quality.fit(x, y).probability(x), plain_boost(x, y), atol=1e-9)
