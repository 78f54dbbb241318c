"""Nested runs from a stream of callback events in any order within the watermark's delay.

A run's events wait until the watermark has passed the close of its root span (a span without a parent), or, if the root
does not close, until nothing came for ``idle``; then its tree is given out once and its state is gone. The rows are those
that ``operators.runs.nested`` gives for the whole table.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from weftline.operators.runs import SCHEMA, tree

_COLUMNS = ["run", "id", "parent", "depth", "name", "start", "end", "status", "items"]


class Runs(StatefulProcessor):
    """State of a run: its events, and when it is given out (milliseconds; ``closed`` once the root has closed)."""

    def __init__(self, idle: int) -> None:
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", "event string")
        self.due = handle.getValueState("due", "at long, closed boolean")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        frame = pd.concat(list(rows))
        self.events.appendList([(e,) for e in frame["event"]])
        at, closed = self.due.get() if self.due.exists() else (0, False)
        roots = frame[frame["root_close"].fillna(False).astype(bool)]
        if len(roots):  # of several closes the first counts, as in the tree
            first = int(roots["ms"].min())
            new, closed = (min(at, first) if closed else first), True
        else:
            new = at if closed else max(at, int(frame["ms"].max()) + self.idle)
        if new != at:
            if at:
                self.handle.deleteTimer(at)
            self.handle.registerTimer(new)
        self.due.update((new, closed))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        found = tree(tuple(json.loads(e[0]).values()) for e in self.events.get())
        self.events.clear()
        self.due.clear()
        if found:
            yield pd.DataFrame([(key[0], *row) for row in found], columns=_COLUMNS)


def nested_stream(events: DataFrame, idle_ms: int = 600_000, late: str = "1 minute") -> DataFrame:
    """events: run, id, parent_id, kind, kept, name, ts, items. Gives the rows of SCHEMA; start and end are microseconds."""
    at = F.unix_micros("ts")
    packed = events.select(
        "run", "ts", F.unix_millis("ts").alias("ms"), ((F.col("kind") != "start") & F.col("parent_id").isNull()).alias("root_close"),
        F.to_json(F.struct("id", "parent_id", "kind", "kept", "name", at.alias("at"), "items"), {"ignoreNullFields": "false"}).alias("event"),
    )
    rows = packed.withWatermark("ts", late)
    return rows.groupBy("run").transformWithStateInPandas(Runs(idle_ms), SCHEMA, "append", "EventTime")
