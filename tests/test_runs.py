"""Nested runs: the plan over a table, the fold of one run, and the stream give the same rows."""

import datetime as dt
import random

import pytest

from weftline.operators import runs
from weftline.streaming import claims
from weftline.streaming.runs import nested_stream

EVENTS = "run string, id string, parent_id string, kind string, kept boolean, name string, at long, items array<string>"
BASE = 1_700_000_000_000_000


def made(rng, run):
    rows, n = [], rng.randint(1, 14)
    for i in range(n):
        parent = None if i == 0 else rng.choice([f"s{rng.randrange(i)}", f"s{rng.randrange(i)}", "gone"])
        begin, end = i * 1_000_000, (200 - i) * 1_000_000
        if i == 0 or rng.random() < 0.9:
            rows.append((run, f"s{i}", parent, "start", rng.random() < 0.6, f"n{i}", BASE + begin, None))
        if i == 0 or rng.random() < 0.85:
            items = rng.choice([None, [], [rng.choice("abcdef") for _ in range(rng.randint(1, 4))]])
            rows.append((run, f"s{i}", parent, rng.choice(["end", "end", "error"]), None, None, BASE + end, items))
    if rng.random() < 0.3:
        rows.append(rows[0])
    return rows


def plain(rows):
    by = {}
    for run, *event in rows:
        by.setdefault(run, []).append(tuple(event))
    return sorted((run, *row[:-1], tuple(row[-1])) for run, events in by.items() for row in map(list, runs.tree(events)))


def shown(frame):
    return sorted((*tuple(r)[:-1], tuple(r["items"])) for r in frame.collect())


def key(rows):
    return sorted(rows, key=repr)


def test_a_run_by_hand():
    events = [
        ("root", None, "start", True, "agent", 0, None), ("wrap", "root", "start", False, "wrap", 1, None), ("find", "wrap", "start", True, "find", 2, None), ("find", "wrap", "end", None, None, 5, ["a", "b", "a"]),
        ("again", "root", "start", True, "again", 6, None), ("again", "root", "end", None, None, 7, ["b", "c"]), ("lost", "wrap", "error", None, "lost", 8, None), ("root", None, "end", None, None, 9, None),
    ]
    assert {r[0]: r[1:] for r in runs.tree(events)} == {
        "root": (None, 0, "agent", 0, 9, "ok", []), "find": ("root", 1, "find", 2, 5, "ok", ["a", "b"]), "again": ("root", 1, "again", 6, 7, "ok", ["c"]), "lost": ("root", 1, "lost", 8, 8, "unmatched", []),
    }
    assert runs.tree([("a", "b", "start", True, "x", 0, None), ("b", "a", "start", True, "y", 1, None)]) and runs.tree([]) == []


def test_the_table_gives_what_the_fold_gives(spark):
    rng = random.Random(6)
    rows = [e for k in range(25) for e in made(rng, f"r{k}")]
    rng.shuffle(rows)
    assert key(shown(runs.nested(spark.createDataFrame(rows, EVENTS).repartition(3)))) == key(plain(rows))
    assert runs.nested(spark.createDataFrame([], EVENTS)).count() == 0


@pytest.fixture
def rocks(spark):
    old = {k: spark.conf.get(k, None) for k in claims.STATE_STORE}
    for k, v in claims.STATE_STORE.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_stream_out_of_order_gives_the_table(rocks, tmp_path):
    rng = random.Random(4)
    rows = [(r, i, p, k, kept, n, at + int(r[1:]) * 20_000_000, items) for j in range(8) for r, i, p, k, kept, n, at, items in made(rng, f"r{j}")]
    rows.sort(key=lambda r: r[6] + rng.randrange(25_000_000))  # out of order by less than the delay
    rows += [("z", "s0", None, "start", True, "late", BASE + 10**10, None), ("z", "s1", "s0", "start", True, "late", BASE + 2 * 10**10, None)]
    parts = [rows[a : a + 40] for a in range(0, len(rows) - 2, 40)] + [rows[-2:-1], rows[-1:]]
    schema = "run string, id string, parent_id string, kind string, kept boolean, name string, ts timestamp, items array<string>"

    def go():
        stream = rocks.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        found = nested_stream(stream.where("kind is not null"), 3_600_000, "60 seconds").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state")
        found.outputMode("append").trigger(availableNow=True).start().awaitTermination()

    for n, part in enumerate(parts):
        timed = [(*r[:6], dt.datetime.fromtimestamp(r[6] / 1e6, dt.UTC), r[7]) for r in part]
        rocks.createDataFrame(timed, schema).coalesce(1).write.parquet(f"{tmp_path}/in/n={n:03}")
        if n == len(parts) // 2:
            go()  # and again after a restart
    go()
    want = [r for r in rows if r[0] != "z"]
    assert key(shown(rocks.read.schema(runs.SCHEMA).parquet(f"{tmp_path}/out"))) == key(plain(want))
