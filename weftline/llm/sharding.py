"""Balanced label propagation: linked documents gather in shards of equal size, in DataFrame operations only.

Links are group memberships: rows that share a group key are neighbours of each other, and only counts per (group,
shard) are ever built, never pairs. Every row starts in a shard by hash of its id. In each round every group's linked
rows want the shard where most of their neighbours are (those of a group larger than a quota, the fewest shards that can
hold it), and moves into a shard are admitted, strongest group first, as far as its load with the round's moves in and
out stays under its quota: full shards swap. Rounds go on until none of a round's moves is admitted; each move leaves fewer
links cut, so they end. Rows without neighbours do not move in rounds: they fill up at the end, when rows beyond a shard's exact quota (rows without neighbours first) go to shards with room. Shard sizes differ by one at most.

Null texts count as empty ones and are neighbours of these. Null and repeated ids are kept as rows of their own (which
of two equal rows comes first is not defined). An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm._spark import materialize, number_rows, spread

SHARDS = 16
#: A group's rows in one shard move in so many parts, so that a large group can fill a shard.
PARTS = 8
#: Hash buckets of groups by which moves are admitted where a quota cuts through equally strong groups.
CUTS = 1024
#: Steps in which a round's flows are fitted to the quotas bit by bit; after them what overfills a shard is refused whole.
STEPS = 5_000


def _fitted(flow: np.ndarray, load: np.ndarray, room: int) -> np.ndarray:
    """How much of each flow (strength, from, to) is admitted, so that no shard takes in rows beyond the room; weak flows are refused first."""
    flow = flow.copy()
    for step in range(STEPS + len(load)):
        into = flow.sum(axis=(0, 1))
        over = np.where(into > 0, load + into - flow.sum(axis=(0, 2)) - room, 0)
        to = int(over.argmax())
        if over[to] <= 0:
            break
        refuse = int(min(over[to], into[to]) if step < STEPS else into[to])
        for cell in flow[:, :, to]:
            part = min(refuse, int(cell.sum()))
            if not part:
                continue
            less = part * cell // cell.sum()
            # The rest of the division, one row each from the largest.
            less[np.argsort(less - cell, kind="stable")[: part - less.sum()]] += 1
            cell -= less
            refuse -= part
    return flow


def _propagate(linked: DataFrame, room: int, shards: int) -> DataFrame:
    """linked: group key g1, g2, first (a part of a shard) and n, the group's rows there. Gives the shard each of these moves to.

    These parts are the rows here: their number is bounded by groups x shards x PARTS, and they move whole.
    """
    spark = linked.sparkSession
    parts = linked.select("g1", "g2", "first", F.floor(F.col("first") / PARTS).cast("int").alias("shard"), "n")
    k = 0
    while True:
        load = np.zeros(shards, np.int64)
        for row in parts.groupBy("shard").agg(F.sum("n").alias("load")).collect():  # a row for each shard
            load[row["shard"]] = row["load"]
        held = parts.groupBy("g1", "g2", "shard").agg(F.sum("n").alias("held"))
        # Ties are drawn anew in each round: a group that was refused one way may go the other.
        ranked = F.array_sort(F.collect_list(F.struct((-F.col("held")).alias("less"), F.xxhash64("g1", "shard", F.lit(k)).alias("tie"), "shard")))
        want = held.groupBy("g1", "g2").agg(ranked.alias("ranked"), F.sum("held").alias("all")).where(F.size("ranked") > 1)
        want = want.select("g1", "g2", F.slice("ranked", F.lit(1), F.ceil(F.col("all") / max(room, 1)).cast("int")).alias("w"))
        moves = parts.join(want, ["g1", "g2"]).where(~F.array_contains("w.shard", F.col("shard")))
        moves = moves.withColumn("w", F.get("w", F.pmod(F.xxhash64("first", "g1", F.lit(k)), F.size("w")).cast("int"))).select(
            "g1", "g2", "first", "shard", "n", F.col("w.shard").alias("want"), F.floor(F.log2(-F.col("w.less").cast("double"))).cast("int").alias("strength"),
            F.pmod(F.xxhash64("g2", "g1", F.lit(k)), F.lit(CUTS)).cast("int").alias("cut"),
        )
        flows = moves.groupBy("strength", "shard", "want").agg(F.sum("n").alias("m")).collect()  # at most shards x shards for each power of two
        flow = np.zeros((1 + max((f["strength"] for f in flows), default=0), shards, shards), np.int64)
        for f in flows:
            flow[f["strength"], f["shard"], f["want"]] = f["m"]
        fitted = _fitted(flow, load, room)
        if not fitted.any():
            break
        most = spark.createDataFrame([(*map(int, at), int(fitted[tuple(at)])) for at in np.argwhere(fitted)], "strength int, shard int, want int, most long")
        cells = moves.groupBy("strength", "shard", "want", "cut", "first").agg(F.sum("n").alias("m")).join(F.broadcast(most), ["strength", "shard", "want"])
        order = Window.partitionBy("strength", "shard", "want").orderBy("cut", "first").rowsBetween(Window.unboundedPreceding, 0)
        admitted = cells.withColumn("upto", F.sum("m").over(order)).where("upto <= most").select("strength", "shard", "want", "cut", "first")
        moved = moves.join(admitted, ["strength", "shard", "want", "cut", "first"]).select("g1", "g2", "first", F.col("want").alias("to"))
        parts = parts.join(moved, ["g1", "g2", "first"], "left").select("g1", "g2", "first", F.coalesce("to", "shard").alias("shard"), "n", F.col("to").isNotNull().alias("moved"))
        parts = materialize(parts, f"shard-round-{k}")
        if not parts.where("moved").limit(1).count():
            break
        parts, k = parts.drop("moved"), k + 1
    return parts.select("g1", "g2", "first", F.col("shard").alias("label"))


def shard_documents(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard (0 to shards - 1, sizes at most one apart) and slot (gapless from 0 within the shard)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("g1"),
    ).withColumns({"g2": F.col("text_crc32") * (1 << 30) + F.col("size"), "first": F.pmod(F.xxhash64("doc_id", "size", F.lit("shard")), F.lit(shards * PARTS)).cast("int")})
    rows = materialize(rows, "shard-rows")
    total = rows.count()
    groups = rows.groupBy("g1", "g2", "first").agg(F.count(F.lit(1)).alias("n"))
    several = groups.groupBy("g1", "g2").agg(F.sum("n").alias("all")).where("all > 1").select("g1", "g2")
    linked = materialize(groups.join(several, ["g1", "g2"]), "shard-links")
    labels = _propagate(linked, -(-total // shards), shards)

    # Only rows of groups have a label; the others stay where their hash put them until the end.
    rows = rows.join(labels, ["g1", "g2", "first"], "left").withColumns({
        "label": F.coalesce("label", F.floor(F.col("first") / PARTS).cast("int")), "alone": F.col("label").isNull().cast("int"), "__bucket": spread("doc_id", "g1"),
    }).withColumn("alone_bucket", F.col("alone") * 4096 + F.col("__bucket"))
    rows = number_rows(rows.drop("__bucket", "first"), ["label"], "alone_bucket", ["g1", "doc_id"], "rank")

    # Exact quotas: 16 rows. A shard's surplus is numbered across shards and meets the free slots, numbered alike.
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    quotas = documents.sparkSession.range(shards).select(F.col("id").cast("int").alias("label")).join(counts, "label", "left")
    quotas = quotas.select("label", F.coalesce("n", F.lit(0)).alias("n"), (F.lit(total // shards) + (F.col("label") < total % shards).cast("long")).alias("quota"))
    before = Window.partitionBy(F.lit(0)).orderBy("label").rowsBetween(Window.unboundedPreceding, -1)
    quotas = quotas.withColumns({"over": F.coalesce(F.sum(F.greatest(F.col("n") - F.col("quota"), F.lit(0))).over(before), F.lit(0)), "free": F.coalesce(F.sum(F.greatest(F.col("quota") - F.col("n"), F.lit(0))).over(before), F.lit(0))})
    table = quotas.orderBy("label").collect()  # as many rows as shards
    n, quota, over, free = (F.array(*[F.lit(int(r[c])).cast("long") for r in table]) for c in ("n", "quota", "over", "free"))
    beyond = F.when(F.col("rank") >= F.get(quota, F.col("label")), F.get(over, F.col("label")) + F.col("rank") - F.get(quota, F.col("label")))
    placed = rows.withColumn("beyond", beyond)
    # Shards without room share their ``free`` with the next one, so the last of equals is the one with room.
    placed = placed.withColumn("to", F.when(F.col("beyond").isNull(), F.col("label")).otherwise(F.size(F.filter(free, lambda x: x <= F.col("beyond"))) - 1))
    placed = placed.withColumn("slot", F.when(F.col("beyond").isNull(), F.col("rank")).otherwise(F.get(n, F.col("to")) + F.col("beyond") - F.get(free, F.col("to"))))
    return placed.select("doc_id", "size", "text_crc32", F.col("to").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"))
