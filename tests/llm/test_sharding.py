"""Balanced label propagation: balance, slots, and groups kept together."""

import random
import zlib
from collections import Counter

from weftline.llm import sharding


def shard(spark, rows, shards=4):
    return sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string, shard string, n long"), shards).toPandas()


def check(got, rows, shards):
    assert sorted(got.doc_id.dropna()) == sorted(r[0] for r in rows if r[0] is not None) and len(got) == len(rows)
    counts = got.groupby("shard").size().reindex(range(shards), fill_value=0)
    assert counts.max() - counts.min() <= 1
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))


def test_groups_stay_together_and_sizes_are_even(spark):
    rows = [(i, f"group {i % 20}" if i < 100 else f"alone {i}", "x", 1) for i in range(403)]
    got = shard(spark, rows)
    check(got, rows, 4)
    text = dict((r[0], r[1]) for r in rows)
    got["text"] = got.doc_id.map(text)
    spans = got[got.text.str.startswith("group")].groupby("text").shard.nunique()
    assert (spans == 1).all()
    assert (got.text_crc32 == got.text.map(lambda t: zlib.crc32(t.encode()))).all()


def test_hot_group_fills_few_shards(spark):
    rows = [(i, "the same" if i % 3 == 0 else f"alone {i}", "x", 1) for i in range(600)]
    got = shard(spark, rows, 8)
    check(got, rows, 8)
    assert got[got.doc_id % 3 == 0].shard.nunique() <= 5


def test_nulls_repeats_and_few_rows(spark):
    rows = [(1, None, None, None), (2, "", None, None), (None, "é" * 5000, None, None), (3, "a", None, None), (3, "a", None, None)]
    got = shard(spark, rows, 3)
    check(got, rows, 3)
    assert sorted(got["size"]) == [1, 1, 2, 2, 10001]
    assert len(shard(spark, [])) == 0


def test_every_row_has_a_copy(spark):
    for size, shards, few in ((2, 16, 0.1), (3, 16, 0.15), (2, 4, 0.1)):
        rows = [(i, f"group {i // size}", "x", 1) for i in range(4800)]
        got = shard(spark, rows, shards)
        check(got, rows, shards)
        cut = (got.groupby(got.doc_id // size).shard.nunique() > 1).mean()
        assert cut < few, (size, shards, cut)


def cut_edges(groups, shard_of):
    """Pairs of a group's rows that lie in different shards."""
    total = 0
    for rows in groups.values():
        sizes = Counter(shard_of[i] for i in rows)
        total += (len(rows) ** 2 - sum(n * n for n in sizes.values())) // 2
    return total


def plain_propagation(groups, start, shards):
    """Row by row: each moves to the shard of most of its neighbours as long as that has room, until none moves."""
    quota = -(-len(start) // shards)
    shard_of, load = dict(start), Counter(start.values())
    moved = True
    while moved:
        moved = False
        for rows in groups.values():
            for i in rows:
                near = Counter(shard_of[j] for j in rows if j != i)
                best = max(near, key=lambda s: (near[s], -s), default=shard_of[i])
                if near[best] > near[shard_of[i]] and load[best] < quota:
                    load[shard_of[i]] -= 1
                    load[best] += 1
                    shard_of[i], moved = best, True
    return shard_of


def test_cuts_no_more_than_plain_propagation(spark):
    rng = random.Random(9)
    rows, groups = [], {}
    while len(rows) < 900:
        size = rng.choice([1, 1, 2, 3, 5, 9, 40])
        own = range(len(rows), len(rows) + size)
        groups[len(groups)] = list(own)
        rows += [(i, f"text {len(groups)}", "x", 1) for i in own]
    got = shard(spark, rows, 6)
    check(got, rows, 6)
    found = dict(zip(got.doc_id.astype(int), got.shard, strict=True))
    start = {i: rng.randrange(6) for i, *_ in rows}
    plain = cut_edges(groups, plain_propagation(groups, start, 6))
    assert cut_edges(groups, found) <= plain and plain < cut_edges(groups, start)
