"""Entity resolution in order of mention, spread over tasks.

A mention joins the canonical entity of its (block, type) that is most like it, or becomes one itself, so what it finds
depends on all mentions before it. Only mentions that nothing known so far is like can become canonical: these are folded
in order, at most ``fold_rows`` of a (block, type) in a task and turn. All others, wherever they stand, are compared with
a turn's new canonical entities in parts of ``part_rows``, whatever block they belong to, and keep the best of those that
came before them. A turn's canonical vectors of a (block, type) are one row of at most ``fold_rows`` vectors.

Vectors are scaled to length one and similarities rounded to 9 places, so that equal ones tie; ties go to the entity that
came first. Mentions of a null vector or seq, or of vectors of another width than their (block, type)'s first, take no part.
Of repeated seqs the order is by text. A judge that fails has not said that two names are the same.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.options import DEFAULTS
from weftline.sources.shared import written

FOLD_ROWS, PART_ROWS = 1024, 32_768
Judge = Callable[[str, str], bool]
KEYS = ["block", "type"]
_TODO = "block int, type string, turn long, seq long, text string, vector array<double>, best double, at long, label string"
_FOUND = "block int, type string, turn long, seq long, text string, canonical string, path string, similarity double, vector array<double>"


def _same(judge: Judge | None, text: str, label: str) -> bool:
    try:
        return judge is not None and judge(text, label) is True
    except Exception:  # noqa: BLE001  stated above
        return False


def fold(rows: pd.DataFrame, judge: Judge | None, merge_at: float, ask_at: float) -> pd.DataFrame:
    """Mentions of one (block, type) in order of turn, none of which an entity known before is like enough: canonical, path and similarity.

    ``best`` and ``label`` are the most like of the entities known before (null: none).
    """
    rows = rows.sort_values("turn", kind="stable")
    vectors = np.stack(rows["vector"].to_numpy())
    known, labels, out = np.empty_like(vectors), [], []
    for i, (text, best, label) in enumerate(zip(rows["text"], rows["best"], rows["label"], strict=True)):
        if pd.isna(best):
            best, label = -np.inf, None
        if labels:
            scores = np.round(known[: len(labels)] @ vectors[i], 9)
            k = int(scores.argmax())
            if scores[k] > best:  # of equals the one known before came first
                best, label = float(scores[k]), labels[k]
        if best >= merge_at:
            out.append((label, "repeat" if label == text else "merged", best))
        elif best >= ask_at and _same(judge, text, label):
            out.append((label, "judged", best))
        else:
            known[len(labels)] = vectors[i]
            labels.append(text)
            out.append((text, "created", best if np.isfinite(best) else None))
    return rows[[*KEYS, "turn", "seq", "text"]].assign(canonical=[o[0] for o in out], path=[o[1] for o in out], similarity=np.array([o[2] for o in out], np.float64), vector=rows["vector"])


def resolve(mentions: DataFrame, judge: Judge | None = None, merge_at: float = DEFAULTS.merge_at, ask_at: float = DEFAULTS.ask_at, fold_rows: int = FOLD_ROWS, part_rows: int = PART_ROWS) -> DataFrame:
    """mentions: block, type, seq, text, vector. Gives block, type, seq, text, canonical, path (created, repeat, merged, judged), similarity, and whether a judge was to be asked."""
    if ask_at > merge_at:
        raise ValueError("ask_at cannot exceed merge_at")
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x))
    rows = mentions.where("vector is not null and seq is not null").select(F.col("block").cast("int").alias("block"), F.col("type").cast("string").alias("type"), F.col("seq").cast("long").alias("seq"), "text", F.col("vector").cast("array<double>").alias("v"))
    first = rows.groupBy(*KEYS).agg(F.min_by(F.size("v"), F.struct("seq", "text")).alias("width"), F.count(F.lit(1)).alias("n"))
    null_safe = lambda a, b: a["block"].eqNullSafe(b["block"]) & a["type"].eqNullSafe(b["type"])
    first = written(first, "resolve-keys")
    rows = rows.join(first.drop("n"), null_safe(rows, first)).where(F.size("v") == F.col("width")).select(rows["block"], rows["type"], "seq", "text", F.transform("v", lambda x: x / F.when(length > 0, length).otherwise(1.0)).alias("vector"))
    turn = F.row_number().over(Window.partitionBy(*KEYS, "slice").orderBy("seq", "text"))
    rows = _numbered(rows, turn)
    none = {"best": F.lit(None).cast("double"), "at": F.lit(None).cast("long"), "label": F.lit(None).cast("string")}
    todo = written(rows.withColumns(none).select(*[c.split()[0] for c in _TODO.split(", ")]), "resolve-todo")
    parts = first.select(*KEYS, F.ceil(F.col("n") / part_rows).cast("int").alias("parts"))
    spark, found, k = mentions.sparkSession, [], 0
    unlike = F.col("best").isNull() | (F.col("best") < merge_at)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return fold(frame, judge, merge_at, ask_at)

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("turn")
        body = pickle.dumps((frame["turn"].to_numpy(np.int64), frame["canonical"].tolist(), np.stack(frame["vector"].to_numpy())), protocol=5)
        return pd.DataFrame({"block": frame["block"].iloc[:1], "type": frame["type"].iloc[:1], "body": [body]})

    def compare(frame: pd.DataFrame, packed: pd.DataFrame) -> pd.DataFrame:
        if not len(frame) or not len(packed):
            return frame[[c.split()[0] for c in _TODO.split(", ")]]
        turns, labels, known = pickle.loads(packed["body"].iloc[0])
        own, best = frame["turn"].to_numpy(np.int64), frame["best"].to_numpy(np.float64)
        at, label = frame["at"].to_numpy(np.float64), frame["label"].to_numpy(object)
        for a in range(0, len(frame), 4096):
            part = slice(a, a + 4096)
            scores = np.round(np.stack(frame["vector"].iloc[part].to_numpy()) @ known.T, 9)
            scores[turns[None, :] > own[part][:, None]] = -np.inf  # an entity is known to those after it
            top = scores.argmax(axis=1)
            score = scores[np.arange(len(top)), top]
            better = (score > np.nan_to_num(best[part], nan=-np.inf)) | ((score == best[part]) & (turns[top] < at[part]))
            where = np.flatnonzero(better) + a
            best[where], at[where] = score[better], turns[top[better]]
            label[where] = np.array(labels, object)[top[better]]
        return frame.assign(best=best, at=pd.array(at, "Float64").astype("Int64"), label=label)[[c.split()[0] for c in _TODO.split(", ")]]

    while todo.where(unlike).limit(1).count():
        k += 1
        place = F.row_number().over(Window.partitionBy(*KEYS).orderBy("turn"))
        folded = written(todo.where(unlike).withColumn("place", place).where(F.col("place") <= fold_rows).drop("place").groupBy(*KEYS).applyInPandas(run, _FOUND), f"resolve-fold-{k}")
        found.append(folded.drop("vector", "turn"))
        upto = folded.groupBy(*KEYS).agg(F.max("turn").alias("upto"))
        new = folded.where("path = 'created'").groupBy(*KEYS).applyInPandas(pack, "block int, type string, body binary")
        left = todo.join(folded.select(*KEYS, "turn"), null_safe_on(todo, folded, "turn"), "left_anti")
        share = lambda frame: frame.join(F.broadcast(parts) if parts.count() <= 100_000 else parts, null_safe(frame, parts), "left").drop(parts["block"]).drop(parts["type"])
        rows = share(left).withColumn("part", F.pmod(F.xxhash64("turn"), F.col("parts")).cast("int")).drop("parts")
        copies = share(new).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        met = rows.groupBy(*KEYS, "part").cogroup(copies.groupBy(*KEYS, "part")).applyInPandas(compare, _TODO)
        met = written(met, f"resolve-met-{k}")
        # What lies before the last mention folded has met all entities that came before it.
        ends = met.join(upto, null_safe(met, upto), "left").drop(upto["block"]).drop(upto["type"])
        done = ~unlike & (F.col("turn") < F.coalesce("upto", F.lit(-1)))
        same = F.when(F.col("label") == F.col("text"), "repeat").otherwise("merged")
        settled = written(ends.where(done).select(*KEYS, "seq", "text", F.col("label").alias("canonical"), same.alias("path"), F.col("best").alias("similarity")), f"resolve-done-{k}")
        found.append(settled)
        todo = written(ends.where(~done).drop("upto"), f"resolve-todo-{k}")
    same = F.when(F.col("label") == F.col("text"), "repeat").otherwise("merged")
    result = todo.select(*KEYS, "seq", "text", F.col("label").alias("canonical"), same.alias("path"), F.col("best").alias("similarity"))
    for more in found:
        result = result.unionByName(more)
    asked = F.col("path").isin("created", "judged") & F.coalesce(F.col("similarity") >= ask_at, F.lit(False))
    return result.withColumn("asked", asked)


def null_safe_on(a: DataFrame, b: DataFrame, *more: str):  # noqa: ANN201
    condition = a["block"].eqNullSafe(b["block"]) & a["type"].eqNullSafe(b["type"])
    for name in more:
        condition = condition & (a[name] == b[name])
    return condition


def _numbered(rows: DataFrame, turn) -> DataFrame:  # noqa: ANN001
    """Number each (block, type)'s mentions in order, without a task that sees all of one: by slices of seq, whose counts are summed."""
    span = rows.groupBy(*KEYS).agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"))
    at = rows.join(span, null_safe_on(rows, span), "left").drop(span["block"]).drop(span["type"])
    width = F.greatest(F.ceil((F.col("hi") - F.col("lo") + 1) / 256), F.lit(1))
    at = at.withColumn("slice", F.floor((F.col("seq") - F.col("lo")) / width).cast("int")).drop("lo", "hi")
    cells = at.groupBy(*KEYS, "slice").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(*KEYS).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.select(*KEYS, "slice", F.coalesce(before, F.lit(0)).alias("before"))
    joined = at.join(cells, null_safe_on(at, cells, "slice")).drop(cells["block"]).drop(cells["type"]).drop(cells["slice"])
    return joined.withColumn("turn", (F.col("before") + turn).cast("long")).drop("before", "slice")
