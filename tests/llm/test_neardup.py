"""Near-duplicates against brute force over all pairs of sets."""

import random
import re

import pytest

import corpus_pipeline
from weftline.llm import neardup


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)}


def brute(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def run(spark, rows):
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n long, comp string")
    return neardup.near_duplicates(frame).toPandas()


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(4))
    base = [[word() for _ in range(rng.randint(3, 300))] for _ in range(60)]
    passage = [word() for _ in range(60)]
    rows = []
    for i in range(420):
        words = list(base[0] if i % 3 == 0 else rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
            words[rng.randrange(len(words))] = word()
        if i % 7 == 0:
            words = passage + words[:20]
        rows.append((1000 - i, " ".join(words).upper() if i % 5 == 0 else "  ".join(words)))
    return rows


@pytest.mark.parametrize("short_list", [48, 3])
def test_brute_force(spark, monkeypatch, short_list):
    monkeypatch.setattr(neardup, "SHORT_LIST", short_list)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rows = corpus(short_list)
    got = run(spark, rows)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got.itertuples()} == brute(rows)


def test_nulls_empty_short_and_repeats(spark):
    rows = [(1, None), (2, ""), (3, " \t"), (4, "a b"), (5, "A\nB"), (6, "a b c"), (7, "a b c"), (7, "a b c"), (8, "x " * 3000)]
    got = sorted(map(tuple, run(spark, rows).itertuples(index=False)))
    assert got == [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (7, 1, 6, False), (7, 1, 6, False), (8, 1, 8, True)]
    assert len(run(spark, [])) == 0
    lost = run(spark, [(None, "a b"), (4, "a b")])
    assert set(lost.kept) == {True} and lost.component_id.isna().sum() == 1


def between(rng, low, high):
    """Two texts of 101 shingles each, of similarity in percent from low to below high."""
    while True:
        words = [f"{rng.choice('abcd')}{rng.randrange(10**6)}" for _ in range(105)]
        other = list(words)
        for at in rng.sample(range(105), rng.randint(2, 4)):
            other[at] = "changed"
        a, b = shingle_set(" ".join(words)), shingle_set(" ".join(other))
        if low * len(a | b) <= 100 * len(a & b) < high * len(a | b):
            return " ".join(words), " ".join(other)


def test_the_percent_is_the_callers(spark):
    assert neardup.matches(85) == 38 and neardup.matches(80) == 34
    rng = random.Random(80)
    rows = [(2 * i + k, text, 1, "x") for i in range(30) for k, text in enumerate(between(rng, *((80, 85) if i < 20 else (70, 80))))]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n long, comp string")
    kept = {percent: {r.doc_id for r in neardup.without_duplicates(frame, percent).collect()} for percent in (80, 85)}
    assert kept[80] == {r[0] for r in rows if r[0] >= 40 or r[0] % 2 == 0} and kept[85] == {r[0] for r in rows}
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    assert {r.doc_id for r in stage(spark, frame, "").collect()} == kept[80]


def test_long_lists_at_80_percent(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SHORT_LIST", 3)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(105)]
    rows = []
    for i in range(60):
        other = list(words)
        for at in rng.sample(range(105), rng.randint(1, 3)):
            other[at] = f"own{i}"
        rows.append((i, " ".join(other)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: shingle_set(t) for i, t in rows}
    comp = {i: i for i in sets}
    for _ in sets:
        comp = {a: min(comp[b] for b in sets if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])) for a in sets}
    assert len(set(comp.values())) > 1 and comp != {i: c for i, (_, c, _) in brute(rows).items()}
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(frame, 80).collect()} == comp


def grouped(sets, percent):
    """Root of each key of ``sets``, over all pairs of similar sets."""
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a != b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    return {i: find(i) for i in sets}


def shared_rows(seed):
    """Rows with ids of several texts, null ids, repeated rows and empty texts."""
    rng = random.Random(seed)
    texts = [text for _, text in corpus(seed)[:90]] + ["a b", "A  b", "", " ", None]
    rows = [(rng.choice([None, *range(60)]), rng.choice(texts)) for _ in range(160)]
    return rows + rng.sample(rows, 30)


@pytest.mark.parametrize("seed", [1, 2])
def test_rows_that_share_ids(spark, seed):
    rows = shared_rows(seed) + [(103, "one " * 9 + "end"), (105, "one " * 9 + "end"), (105, "two three"), (109, "two three")]
    usable = {(i, t) for i, t in rows if i is not None and shingle_set(t)}
    by_text = grouped({k: shingle_set(k[1]) for k in usable}, 85)
    reach = {i: i for i, _ in usable}
    for _ in reach:  # ids are linked by similar texts, and texts by their id
        least = {}
        for k, c in by_text.items():
            least[c] = min(least.get(c, k[0]), reach[k[0]])
        reach = {i: min(least[by_text[k]] for k in usable if k[0] == i) for i in reach}
    expected = sorted((i is None, i or 0, len(shingle_set(t)), reach[i] if (i, t) in usable else i) for i, t in rows)
    got = run(spark, rows)
    assert sorted((i != i, 0 if i != i else int(i), n, None if c != c else int(c)) for i, n, c in zip(got.doc_id, got.n_shingles, got.component_id, strict=True)) == expected

    frame = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, comp string")
    left = [(r.doc_id, r.text) for r in neardup.without_duplicates(frame).collect()]
    stay = [r for r in rows if r not in usable]
    assert sorted(map(str, (r for r in left if r not in usable))) == sorted(map(str, stay))
    kept = [r for r in left if r in usable]
    assert len(kept) == len({by_text[k] for k in kept}) == len(set(by_text.values()))
    assert {by_text[k]: k[0] for k in kept} == {c: min(k[0] for k in usable if by_text[k] == c) for c in by_text.values()}
