"""Bursts claimed by timers of a stream against the fold of the whole table."""

import datetime as dt
import random

import pytest

from weftline.streaming import claims
from weftline.streaming.debounce import bursts

SECOND = 1_000_000
BASE = 1_700_000_000


@pytest.fixture
def rocks(spark):
    old = {k: spark.conf.get(k, None) for k in claims.STATE_STORE}
    for k, v in claims.STATE_STORE.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Feed:
    def __init__(self, spark, folder):
        self.spark, self.folder, self.n = spark, folder, 0

    def put(self, rows):
        self.n += 1
        made = [(k, dt.datetime.fromtimestamp(BASE + t, dt.UTC)) for k, t in rows]
        self.spark.createDataFrame(made, "key long, ts timestamp").coalesce(1).write.parquet(f"{self.folder}/in/n={self.n:03}")

    def go(self, late="60 seconds"):
        """All that waits, one folder after another; a new query object each time, as after a restart."""
        stream = self.spark.readStream.schema("key long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/in/*")
        found = claims.claimed(stream, 120 * SECOND, 600 * SECOND, late)
        query = found.writeStream.format("parquet").option("path", f"{self.folder}/out").option("checkpointLocation", f"{self.folder}/state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        return query

    def out(self):
        rows = self.spark.read.parquet(f"{self.folder}/out").collect()
        return sorted((r.key, r.first // SECOND - BASE, r.last // SECOND - BASE, r.n) for r in rows)


def test_shuffled_batches_give_the_bursts_of_the_table(rocks, tmp_path):
    rng = random.Random(3)
    rows = sorted([(k, rng.randrange(3000)) for k in (1, 2, 3) for _ in range(40)] + [(1, 77)] * 3, key=lambda r: r[1])
    rows.sort(key=lambda r: r[1] + rng.randrange(50))  # out of order by less than the delay
    feed = Feed(rocks, tmp_path)
    for a in range(0, len(rows), 31):
        feed.put(rows[a : a + 31])
    feed.put([(9, 10_000)])
    feed.put([(9, 20_000)])
    feed.go()
    want = bursts(rocks.createDataFrame([(k, (BASE + t) * SECOND) for k, t in rows], "key long, t long"), 120 * SECOND, 600 * SECOND)
    want = sorted((r.key, r.first // SECOND - BASE, r.last // SECOND - BASE, r.n) for r in want.collect())
    assert feed.out() == sorted([*want, (9, 10_000, 10_000, 1)])


def test_once_at_the_deadline_late_rows_and_a_restart(rocks, tmp_path):
    feed = Feed(rocks, tmp_path)
    feed.put([(1, 0), (1, 100), (2, 30)])
    feed.put([(5, 250)])  # the watermark comes to 190: the burst of key 1 is open until 220, that of key 2 until 150
    feed.put([(5, 251)])
    feed.go()
    assert feed.out() == [(2, 30, 30, 1)]
    feed.put([(1, 195), (2, 40)])  # one prolongs the burst, the other is too late
    feed.put([(5, 2000)])
    feed.put([(5, 2001)])
    feed.go()
    assert feed.out() == [(1, 0, 195, 3), (2, 30, 30, 1), (5, 250, 251, 2)]
    feed.put([(5, 9000)])
    feed.put([(5, 9001)])
    last = feed.go()
    assert feed.out() == [(1, 0, 195, 3), (2, 30, 30, 1), (5, 250, 251, 2), (5, 2000, 2001, 2)]
    kept = [s["numRowsTotal"] for p in last.recentProgress for s in p["stateOperators"]]
    assert kept[-1] <= 8  # of the one key that is still open
