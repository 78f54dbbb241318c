"""Phrase mining against counting by plain loops, and the automata on their own."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from weftline.llm import collocations as c

SCHEMA = "lang string, text string, n long, phrase string, size int"


def plain(rows, least, top):
    """Every n-gram of every piece, counted by a dictionary."""
    count, sizes = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        lower = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", lower):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            sizes[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    count[lang, tuple(words[i : i + k])] += 1
    found = {}
    for (lang, p), a in count.items():
        if len(p) < 2 or a < least:
            continue
        inside = any(m[0] == lang and len(m[1]) > len(p) and b >= a and b >= least and any(m[1][i : i + len(p)] == p for i in range(len(m[1]) - len(p) + 1)) for m, b in count.items())
        if not inside:
            cuts = [(1000 * a * sizes[lang] // (count[lang, p[:k]] * count[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), count[lang, p[:k]], count[lang, p[k:]]))
    return {(lang, r): (p.decode(), -a, left, right, sizes[lang], -s) for lang, rows in found.items() for r, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)}


def mined(spark, rows, least, top=2000):
    frame = spark.createDataFrame([(a, b, 1, "x", 2) for a, b in rows], SCHEMA).repartition(3)
    return {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in c.collocations(frame, least, top).collect()}


def test_against_plain_counting(spark):
    rng = random.Random(4)
    words = ["the", "of", "New", "york", "ÉTÉ", "straße", "a b", "x" * 3000, "it's", "日本"]
    rows = []
    for i in range(160):
        said = [rng.choice(words) for _ in range(rng.randint(0, 40))]
        if i % 3 == 0:
            said += ["at", "the", "end", "of", "the", "day"]
        gaps = [rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n"]) for _ in said]
        rows.append((["en", "de", None][i % 3], "".join(w + g for w, g in zip(said, gaps, strict=True))))
    rows += [("en", None), (None, ""), ("fr", "one word only"), ("en", rows[0][1])] + [("und", "same same same same same same same")] * 5
    got = mined(spark, rows, 8)
    assert got == plain(rows, 8, 2000) and len(got) > 50
    assert mined(spark, rows, 8, 3) == plain(rows, 8, 3)


def test_without_frequent_phrases_and_empty(spark):
    assert mined(spark, [("en", "a b c")], 2) == {}
    assert mined(spark, [("en", "a. a. a"), (None, None)], 2) == {}
    assert mined(spark, [], 2) == {}


def test_scores_beyond_64_bits(spark):
    n, a, left, right = 9 * 10**18, 10**16 + 1, 3 * 10**17 + 7, 5 * 10**16 + 3
    counts = spark.createDataFrame([("en", "x y", a, 1, "l", left), ("en", "x y", a, 1, "r", right)], "lang string, phrase string, a long, cut int, side string, count long")
    row = c.ranked(counts, spark.createDataFrame([("en", n)], "lang string, n long"), 5).first()
    assert row.score == 1000 * a * n // (left * right) and (row.l, row.r) == (left, right)


@pytest.mark.parametrize("size", [1, 2, 3, 5])
def test_transducers(size):
    rng = np.random.default_rng(size)
    words = sorted(f"w{i}".encode() for i in range(40))
    grams, weights = c.summed(rng.integers(0, 40, (3000, size)), rng.integers(1, 9, 3000))
    one = c.Transducer.unpack(c.Transducer.build(words, grams, weights).pack())
    assert (one.grams() == grams).all()
    ask = [[words[i] for i in g] for g in grams[rng.permutation(len(grams))[:500]]] + [[b"none"] * size, [words[0]] * (size - 1) + [b"none"]]
    table = {tuple(words[i] for i in g): w for g, w in zip(grams.tolist(), weights.tolist(), strict=True)}
    assert one.compose(ask).tolist() == [table.get(tuple(a), -1) for a in ask]


def test_cuts_and_unions_give_back_the_sums(monkeypatch):
    monkeypatch.setattr(c, "HELD", 50)
    rng = random.Random(1)
    total, sent = Counter(), []
    every = np.full(c.BITMAP_BITS // 64, 2**64 - 1, np.uint64)
    shard = c.Shard("en", 2, every)
    for _ in range(60):
        said = [rng.choice("abcdefghijkl") for _ in range(30)]
        total.update(zip(said, said[1:], strict=False))
        words = [b".", *sorted({w.encode() for w in said})]
        shard.add_sequence(words, np.array([words.index(w.encode()) for w in said] + [0], np.uint8))
        if shard.full():
            sent += list(shard.sent(7))
    sent += list(shard.sent(7))
    assert len({s[2] for s in sent}) > 1
    got = Counter()
    for part in {s[2] for s in sent}:
        words, grams, weights = c.united(s[3] for s in sent if s[2] == part)
        got.update({tuple(words[i].decode() for i in g): w for g, w in zip(grams.tolist(), weights.tolist(), strict=True)})
    assert got == total


def test_hot_ranges_are_dealt_over_copies(spark, monkeypatch):
    monkeypatch.setattr(c, "REQUESTS", 10)
    rows = [("en", f"the w{i % 60} end. the w{i % 60} end") for i in range(240)]
    assert mined(spark, rows, 4) == plain(rows, 4, 2000)
