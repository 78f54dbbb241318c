"""Debounce: a burst of a key's events ends when none came for ``window``, or ``wait`` after its first one.

``bursts`` folds a whole table, ``burst_stream`` a stream; both give key, first, last, deadline (microseconds) and n.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCHEMA = "key long, first long, last long, deadline long, n long"


def fold(times: list[int], window: int, wait: int, open_burst: tuple[int, int, int] | None = None) -> list[tuple[int, int, int]]:
    """Bursts (first, last, n) of sorted times; an event at or after the deadline begins another."""
    out = [open_burst] if open_burst else []
    for t in times:
        if out and t < min(out[-1][1] + window, out[-1][0] + wait):
            first, last, n = out[-1]
            out[-1] = (first, max(last, t), n + 1)
        else:
            out.append((t, t, 1))
    return out


def bursts(events: DataFrame, window: int, wait: int) -> DataFrame:
    """events: key, t (microseconds). Gaps of ``window`` cut a key's events first, by window functions; only what lies between two gaps is folded in order."""
    before = F.lag("t").over(Window.partitionBy("key").orderBy("t"))
    cut = (before.isNull() | (F.col("t") - before >= window)).cast("int")
    runs = events.withColumn("cut", cut).withColumn("run", F.sum("cut").over(Window.partitionBy("key").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)))

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        rows = fold(sorted(frame["t"].tolist()), window, wait)
        return pd.DataFrame([(int(frame["key"].iloc[0]), a, b, min(b + window, a + wait), n) for a, b, n in rows], columns=["key", "first", "last", "deadline", "n"])

    # A run that cannot reach the longest wait is one burst, by aggregation alone.
    span = Window.partitionBy("key", "run")
    runs = runs.withColumn("lo", F.min("t").over(span)).withColumn("hi", F.max("t").over(span))
    short = runs.where(F.col("hi") - F.col("lo") < wait).groupBy("key", "run").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.count(F.lit(1)).alias("n"))
    short = short.select("key", "first", "last", F.least(F.col("last") + window, F.col("first") + wait).alias("deadline"), "n")
    return short.unionByName(runs.where(F.col("hi") - F.col("lo") >= wait).groupBy("key", "run").applyInPandas(one, SCHEMA))


def pending(found: DataFrame, now: Column) -> DataFrame:
    """How many bursts still wait for their deadline."""
    return found.where(F.col("deadline") > now).agg(F.count(F.lit(1)).alias("n"))


def burst_stream(events: DataFrame, window: int, wait: int) -> DataFrame:
    """The same for a stream whose batches come in order of time: each emits the bursts it touched, so a sink keeps the latest row of each (key, first).

    A row that comes after later ones counts in the open burst; ``claims`` puts such rows in order and drops the state of ended bursts.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        times = sorted(t for frame in frames for t in frame["t"].tolist())
        rows = fold(times, window, wait, tuple(state.get) if state.exists else None)
        state.update(rows[-1])
        yield pd.DataFrame([(key[0], a, b, min(b + window, a + wait), n) for a, b, n in rows], columns=["key", "first", "last", "deadline", "n"])

    return events.groupBy("key").applyInPandasWithState(step, SCHEMA, "first long, last long, n long", "update", "NoTimeout")
