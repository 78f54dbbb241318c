"""Personal data against plain regular expressions, and revealing terms against counting by loops."""

import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict

import regex

from weftline.llm import pii, queries

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
WORD = regex.compile(r"[\p{L}\p{M}]+")


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def fits(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {"email": True, "ip": all(int(p) <= 255 for p in value.split(".")) if kind == "ip" else 0, "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def spans(text):
    return [(k, m.start(), m.end(), m[0]) for k, p in BASE.items() for m in p.finditer(text) if fits(k, m[0])]


def revealing(texts, alpha, least):
    """Terms and their general forms, by loops."""
    blank = lambda t: BASE["email"].sub(" ", t)
    forms = lambda w: [w] + [w[:n] + "*" for n in pii.FORMS if len(w) > n]
    reach, both, contexts, count = Counter(), Counter(), defaultdict(set), Counter()
    for text in texts:
        for w in WORD.findall(blank(text).lower()):
            count.update(forms(w))
            count[None] += 1
        for kind, pattern in BASE.items():
            said = text if kind == "email" else blank(text)
            found = list(pattern.finditer(said))
            for i, m in enumerate(found):
                if not fits(kind, m[0]):
                    continue
                before, after = said[found[i - 1].end() if i else 0 : m.start()], said[m.end() : found[i + 1].start() if i + 1 < len(found) else len(said)]
                sides = []
                for side, edge in ((before[-pii.REACH - 1 :], r"^[\p{L}\p{M}]+"), (after[: pii.REACH + 1], r"[\p{L}\p{M}]+$")):
                    side = blank(side)
                    sides.append(regex.sub(edge, "", side) if len(side) > pii.REACH else side)
                value = m[0].lower() if kind == "email" else re.sub("[^0-9.]" if kind == "ip" else "[^0-9]", "", m[0])
                for w in WORD.findall(" ".join(s.lower() for s in sides)):
                    reach[kind, value] += 1
                    for f in forms(w):
                        both[(kind, value), f] += 1
                        contexts[(kind, value), f].add(tuple(sides))
    tells = defaultdict(float)
    for (e, f), n in both.items():
        known = -math.log2(reach[e] / count[None])
        if len(contexts[e, f]) >= least and known > 0:
            tells[f] = max(tells[f], 1 + math.log2(min(1, n / count[f])) / known)
    told = {f for f, d in tells.items() if d >= alpha}
    return {t: next((f for f in forms(t)[1:] if f not in told), None) for t in told if not t.endswith("*")}


def all_spans(text, terms):
    base = spans(text)
    more = [("term", m.start(), m.end()) for m in WORD.finditer(text) if m[0].lower() in terms and not any(a < m.end() and m.start() < b for _, a, b, _ in base)]
    return [s[:3] for s in base] + more


def corpus():
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    odd = ["a@b.c%d@e.f", "éabc@x.y-z.de.", "1.2.3.4.5.6.7.8", "300.1.1.1", "000255.0.0.1", "4111 1111 1111 1111", "4111-1111 1111-1112", "+49 (30) 1234-5678", "+1 1", "+1", "😀 x@y.z 1 2", "a@b", "@", "++1 234 567 890"]
    rows = []
    for i in range(150):
        said = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        if i % 2:
            said.insert(rng.randint(0, len(said)), rng.choice(odd))
        if i % 5 == 0:
            near = ["Zorblax", "Quintessa", "zorblaxia", rng.choice(words), "ann.lee@corp.example.com", rng.choice(words), "Berlinish"]
            at = rng.randint(0, len(said))
            said[at:at] = near
        rows.append(" ".join(said))
    return rows + ["the Zorblax alone, berlinesk berlinord", "berlinish", rows[1], "", odd[0] * 3, " ".join(odd)]


def test_against_plain_loops(spark):
    texts = corpus()
    rows = [(i if i % 7 else None, t, "clash", 1) for i, t in enumerate(texts)] + [(5, texts[5], "x", 1), (None, None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, term string, base int").repartition(3)
    terms = revealing([r[1] or "" for r in rows], pii.ALPHA, pii.MIN_CONTEXTS)
    assert {r.term: r.form for r in pii.revealing_terms(frame.selectExpr("coalesce(text, '') AS text")).collect()} == terms
    assert {"zorblax", "quintessa"} <= set(terms) and not set(terms) & {"the", "alone"}
    got = sorted(((r.doc_id, [(k, s.start, s.end) for k in (*pii.KINDS, "term") for s in r[k]], r.clean_text) for r in pii.find_personal_data(frame).collect()), key=repr)
    want = []
    for i, t, *_ in rows:
        found, clean, at = all_spans(t or "", terms), "", 0
        for k, a, b in sorted(found, key=lambda s: (s[1], -s[2], s[0])):
            if a >= at:
                clean, at = clean + (t[at:a] + (f"[{k}]" if k != "term" else terms[t[a:b].lower()] or "[term]")), b
        want.append((i, found, clean + (t or "")[at:]))
    assert got == sorted(want, key=repr)


def test_the_query_gives_digests(spark, tmp_path):
    spark.createDataFrame([(1, "x@y.zz and 10.0.0.1"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in queries.op13_personal_data(spark, str(tmp_path)).collect()}
    assert rows[1].spans == "email:0:6,ip:11:19" and rows[1].base_sha256 == hashlib.sha256(b"email:0:6,ip:11:19").hexdigest()
    assert rows[2].spans == "" and rows[2].base_sha256 == hashlib.sha256(b"").hexdigest() and rows[2].n_card == 0


def test_very_long_runs_and_many_matches(spark):
    texts = ["a" * 2_000_000, "1" * 2_000_000, "1 " * 500_000, "a@" * 300_000, "+1 " + "(" * 1_000_000, "a@b" + ".c" * 300_000, "1." * 400_000, "x@y.z " * 20_000, " ".join(["word"] * 200_000)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    began = time.time()
    rows = {r.doc_id: r for r in pii.find_personal_data(frame).select("doc_id", *pii.KINDS).collect()}
    assert time.time() - began < 120
    assert [(s.start, s.end) for s in rows[7].email] == [(6 * i, 6 * i + 5) for i in range(20_000)] and len(rows[5].email) == 1
    assert len(rows[6].ip) == len([m for m in BASE["ip"].finditer(texts[6])])


def test_empty_table(spark):
    assert pii.find_personal_data(spark.createDataFrame([], "doc_id long, text string")).count() == 0
