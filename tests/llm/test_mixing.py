"""Pfair mixing against the properties that define it."""

from collections import Counter, defaultdict

from weftline.llm import mixing

SCHEMA = "doc_id long, source string, mix_slot int, __x int"


def mixed(spark, rows, weights, block_rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    return mixing.mix_sources(frame, weights, 1, block_rows).toPandas()


def expected_slots(blocks, weights):
    """Earliest deadline first, slot by slot, round by round."""
    left, out, slot = dict(blocks), {}, 0
    done = Counter()
    while any(left.values()):
        m = {s: min(left[s], weights[s]) for s in left if left[s]}
        total, placed = sum(m.values()), Counter()
        for t in range(total):
            ready = [s for s in sorted(m) if placed[s] < m[s] and placed[s] * total // m[s] <= t]
            s = min(ready, key=lambda s: ((placed[s] + 1) * total / m[s], s))
            assert (placed[s] + 1) * total / m[s] > t, "no block misses its deadline"
            out[slot] = (s, done[s])
            placed[s] += 1
            done[s] += 1
            slot += 1
        for s in m:
            left[s] -= m[s]
    return out


def test_schedule_and_deviation(spark):
    sizes, weights = {"a": 61, "b": 17, "c": 40, "d": 3, "": 9}, {"a": 5, "b": 3, "c": 2}
    rows = [(i * 31 + k, s or None, 7, 1) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    got = mixed(spark, rows, weights, 2)
    assert sorted(got.mix_position) == list(range(len(rows))) and sorted(got.doc_id) == sorted(r[0] for r in rows)
    got["source"] = got.source.fillna("")
    w = {s: weights.get(s, 1) for s in sizes}
    want = expected_slots({s: -(-n // 2) for s, n in sizes.items()}, w)
    assert {(r.mix_slot, (r.source, r.mix_block)) for r in got.itertuples()} == set(want.items())
    by_slot = [want[t][0] for t in range(len(want))]
    running, full = defaultdict(int), min(-(-sizes[s] // 2) // w[s] for s in sizes) * sum(w.values())
    for t, s in enumerate(by_slot[:full], 1):
        running[s] += 1
        assert all(abs(running[x] - t * w[x] / sum(w.values())) < 1 for x in sizes)


def test_one_source_repeats_and_nulls(spark):
    got = mixed(spark, [(1, None, None, None)] * 3 + [(None, None, 1, 1)], {}, 2)
    assert sorted(got.mix_position) == [0, 1, 2, 3] and list(got.columns) == ["doc_id", "source", "__x", "mix_block", "mix_slot", "mix_position"]


def test_empty(spark):
    assert len(mixed(spark, [], {"a": 2}, 4)) == 0
