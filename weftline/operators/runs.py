"""Callback events to nested runs: spans paired from starts and closes, hung under the nearest kept ancestor, retrieved items once a run.

events: run, id, parent_id, kind (start, end or error), kept (of a start: whether the span is shown), name, at (long), items
(array of item ids that a close brought). Of several starts or closes of one span the first counts. A close without a start is
a span of its own (``unmatched``, kept), a start without a close stays ``open``. An item that several spans of a run brought
stays with the one that closed first, then with the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.records import kept_ancestors
from weftline.operators.traces import span_depths
from weftline.sources.shared import written

SCHEMA = "run string, id string, parent string, depth int, name string, start long, end long, status string, items array<string>"
Event = tuple[str, str | None, str, bool | None, str | None, int, list[str] | None]


def nested(events: DataFrame) -> DataFrame:
    """The kept spans of every run, in the columns of SCHEMA."""
    first = lambda kind, name, *columns: events.where(kind).groupBy("run", "id").agg(F.min(F.struct("at", *columns)).alias(name))
    both = first("kind = 'start'", "s", "parent_id", "kept", "name").join(first("kind <> 'start'", "c", "kind", "parent_id", "name", "items"), ["run", "id"], "full_outer")
    status = F.when(F.col("c").isNull(), "open").when(F.col("s").isNull(), "unmatched").when(F.col("c.kind") == "error", "error").otherwise("ok")
    spans = both.select(
        "run", "id", F.when(F.col("s").isNotNull(), F.col("s.parent_id")).otherwise(F.col("c.parent_id")).alias("parent_id"), (F.col("s").isNull() | F.coalesce("s.kept", F.lit(False))).alias("kept"),
        F.coalesce("s.name", "c.name").alias("name"), F.coalesce("s.at", "c.at").alias("start"), F.col("c.at").alias("end"), status.alias("status"), F.col("c.items").alias("items"),
    )
    spans = written(spans, "run-spans")
    parents = written(kept_ancestors(spans.select("run", "id", "parent_id", "kept")), "run-parents")
    depths = span_depths(parents.select("run", "id", F.col("parent").alias("parent_id")))
    kept = spans.where("kept")
    brought = kept.where("items is not null").select("run", "id", "end", F.posexplode(F.array_distinct("items")).alias("place", "item"))
    own = brought.withColumn("turn", F.row_number().over(Window.partitionBy("run", "item").orderBy("end", "id"))).where("turn = 1")
    items = own.groupBy("run", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "item"))), lambda x: x["item"]).alias("items"))
    found = kept.drop("items", "parent_id", "kept").join(parents, ["run", "id"]).join(depths, ["run", "id"]).join(items, ["run", "id"], "left")
    return found.select("run", "id", "parent", "depth", "name", "start", "end", "status", F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def tree(events: Iterable[Event]) -> list[tuple]:
    """The same of one run's events (id, parent_id, kind, kept, name, at, items): id, parent, depth, name, start, end, status, items."""
    starts: dict[str, tuple] = {}
    closes: dict[str, tuple] = {}
    low = lambda x: (x is not None, x)  # noqa: E731  nulls come first, as Spark orders them
    for name, parent, kind, kept, label, at, items in events:
        if kind == "start":
            new = (at, parent, kept, label)
            if name not in starts or tuple(map(low, new)) < tuple(map(low, starts[name])):
                starts[name] = new
        else:
            new = (at, kind, parent, label, items)
            if name not in closes or tuple(map(low, new)) < tuple(map(low, closes[name])):
                closes[name] = new
    up = {i: starts[i][1] if i in starts else closes[i][2] for i in {*starts, *closes}}
    shown = {i: i not in starts or bool(starts[i][2]) for i in up}

    def above(i: str) -> str | None:
        """The nearest kept ancestor; none beyond a span that is not there."""
        seen, at = set(), up[i]
        while at is not None and at in up and not shown[at]:
            if at in seen:
                return None
            seen.add(at)
            at = up[at]
        return at if at in up else None

    parents = {i: above(i) for i in up if shown[i]}
    out, taken = [], set()
    for i in sorted(parents, key=lambda i: (closes[i][0] if i in closes else float("inf"), i)):
        depth, seen, at = 0, {i}, parents[i]
        while at is not None:
            depth += 1
            if at in seen:
                break
            seen.add(at)
            at = parents[at]
        start, close = starts.get(i), closes.get(i)
        items = [x for x in dict.fromkeys(close[4] or []) if x not in taken] if close else []
        taken.update(items)
        status = "open" if close is None else "unmatched" if start is None else "error" if close[1] == "error" else "ok"
        label = next((x for x in (start and start[3], close and close[3]) if x is not None), None)
        out.append((i, parents[i], depth, label, start[0] if start else close[0], close[0] if close else None, status, items))
    return out
