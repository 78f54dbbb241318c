"""Timed claims of debounced bursts: each burst of a key is given out once, when its deadline has passed in event time.

Rows may come in any order within the watermark's delay. They wait, as times and counts, until the watermark has passed
them; then they are folded in order of time into the key's open burst, so that batches of any cut give the bursts that
``debounce.bursts`` finds in the whole table. One timer for a key stands at the open burst's deadline. When it fires, the
bursts that have ended are given out and their state is gone; a key without an open burst holds no state and no timer.
Rows older than the watermark are dropped by Spark and counted in its progress. A restart goes on from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from weftline.streaming.debounce import SCHEMA

#: What the state store needs; set on a session before a claim stream is started.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class Claims(StatefulProcessor):
    """State of a key: ``waiting`` (times that the watermark has not passed, with counts; one entry for a batch, since each is a message of its own), ``open`` (the burst begun) and ``timer``."""

    def __init__(self, window: int, wait: int) -> None:
        self.window, self.wait = window, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "t array<long>, n array<long>")
        self.open = handle.getValueState("open", "first long, last long, n long")
        self.timer = handle.getValueState("timer", "at long")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        times, counts = np.unique(np.concatenate([r["t"].dropna().to_numpy(np.int64) for r in rows]), return_counts=True)
        if len(times):
            self.waiting.appendValue((times.tolist(), counts.tolist()))
            self._wake(int(times[0]) + min(self.window, self.wait))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        self.timer.clear()
        now = timerValues.getCurrentWatermarkInMs() * 1000
        every = sorted((int(t), int(n)) for times, counts in self.waiting.get() for t, n in zip(times, counts, strict=True))
        known = [(t, n) for t, n in every if t <= now]
        begun = tuple(self.open.get()) if self.open.exists() else None
        due = [(key[0], a, b, min(b + self.window, a + self.wait), n) for a, b, n in self._folded(known, begun)]
        rest = every[len(known) :]
        self.waiting.put([tuple(map(list, zip(*rest, strict=True)))]) if rest else self.waiting.clear()
        left = due.pop() if due and due[-1][3] > now else None
        if left:
            self.open.update(left[1:3] + left[4:])
        elif self.open.exists():
            self.open.clear()
        later = [left[3]] if left else []
        later += [t + min(self.window, self.wait) for t, _ in rest[:1]]
        if later:
            self._wake(min(later))
        if due:
            yield pd.DataFrame(due, columns=["key", "first", "last", "deadline", "n"])

    def _folded(self, known: list[tuple[int, int]], begun: tuple[int, int, int] | None) -> list[tuple[int, int, int]]:
        """The open burst with the sorted (time, rows), and the bursts that begin after it."""
        out = [begun] if begun else []
        for t, n in known:
            if out and t < min(out[-1][1] + self.window, out[-1][0] + self.wait):
                out[-1] = (out[-1][0], t, out[-1][2] + n)
            else:
                out.append((t, t, n))
        return out

    def _wake(self, at: int) -> None:
        """Keep one timer, the earlier of that set and this (microseconds)."""
        ms = -(-at // 1000)
        if self.timer.exists():
            old = self.timer.get()[0]
            if old <= ms:
                return
            self.handle.deleteTimer(old)
        self.handle.registerTimer(ms)
        self.timer.update((ms,))


def claimed(events: DataFrame, window: int, wait: int, late: str = "10 minutes") -> DataFrame:
    """The bursts (key, first, last, deadline, n) of a stream of events (key, ts), each once, after its deadline. window, wait: microseconds."""
    rows = events.select("key", "ts", F.unix_micros("ts").alias("t")).withWatermark("ts", late)
    return rows.groupBy("key").transformWithStateInPandas(Claims(window, wait), SCHEMA, "append", "EventTime")


def claim_to_end(events: DataFrame, folder: str, window: int, wait: int, late: str = "10 minutes") -> DataFrame:
    """Read all that is there now; all bursts claimed so far under a folder, this run's and earlier ones'."""
    spark: SparkSession = events.sparkSession
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        found = claimed(events, window, wait, late).writeStream.format("parquet").option("path", f"{folder}/claimed").option("checkpointLocation", f"{folder}/checkpoint")
        found.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(SCHEMA).parquet(f"{folder}/claimed")
