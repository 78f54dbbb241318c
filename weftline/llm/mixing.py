"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

A source's rows, in order of a hash of their id, are cut into blocks of ``BLOCK_ROWS``. While sources with the integer
weights n_1, n_2, ... share rounds of M = n_1 + n_2 + ... slots, the j-th block (from 0) that a source places in a
round is released at slot floor(j * M / n) and due by slot ceil((j + 1) * M / n). Each slot goes to the released block
that is due earliest. One slot holds one block, so no block misses its deadline, and after any number t of a round's
slots a source has placed less than one block more or less than t * n / M. Rounds end with every source exactly at its
weight, so a round's schedule is worked out once for each set of sources that still have blocks (at most two for each
source: its last, possibly shorter round, and the rounds after it has run out) and repeated. No row is dropped: what
remains when a source runs out is shared by the others in proportion to their weights.

Null sources are a source of their own. Null and repeated ids are kept; which of two equal rows comes first is not
defined. An empty table gives an empty result. The schedule's size depends on the weights and the number of sources
alone: about (2 x sources + 1) x total weight slots.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm._spark import number_rows, spread

BLOCK_ROWS = 16
NAMES = ("mix_block", "mix_slot", "mix_position")
#: Target weights of the registered query; every other source weighs DEFAULT_WEIGHT.
WEIGHTS: Mapping[str, int] = {"src0": 6, "src1": 4, "src2": 4, "src3": 2, "src4": 2}
DEFAULT_WEIGHT = 1
#: Up to so many sources, their schedule (a row each) goes to every executor.
BROADCAST_SOURCES = 1000


def _weight(source: Column, weights: Mapping[str, int], default: int) -> Column:
    if not weights:
        return F.lit(default)
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return F.coalesce(F.element_at(table, source), F.lit(default)).cast("int")


#: Slots of one round: an array, by source, of the slots of its blocks. m: blocks of each source in the round.
_ROUND = """
    aggregate(
        sequence(0, aggregate(m, 0, (a, x) -> a + x) - 1),
        named_struct('done', transform(m, x -> 0), 'slots', transform(m, x -> cast(array() as array<int>))),
        (s, t) -> transform(array(
            array_min(filter(transform(m, (n, i) -> if(
                n > s.done[i] and cast(s.done[i] as bigint) * total div greatest(n, 1) <= t,
                named_struct('due', cast(s.done[i] + 1 as bigint) * total / n, 'i', i), null)), x -> x is not null)).i
        ), k -> named_struct(
            'done', transform(s.done, (d, i) -> if(i = k, d + 1, d)),
            'slots', transform(s.slots, (a, i) -> if(i = k, array_append(a, t), a))
        ))[0],
        s -> s.slots
    )
"""


def schedule(stock: DataFrame) -> DataFrame:
    """stock: source, weight (int, 1 at least), blocks (1 at least). Gives each source's ``spans``: array of structs.

    A span is a run of equal rounds: rounds ``a`` to before ``b``, each of ``total`` slots of which the source's blocks
    take ``slots``; ``base`` is the slot where round ``a`` begins.
    """
    one = stock.groupBy().agg(F.array_sort(F.collect_list(F.struct("source", "weight", "blocks"))).alias("s"))
    one = one.withColumn("s", F.expr("transform(s, x -> named_struct('source', x.source, 'n', x.weight, 'blocks', x.blocks, 'rounds', cast(ceil(x.blocks / x.weight) as bigint)))"))
    edges = "array_sort(array_distinct(concat(array(0L), flatten(transform(s, x -> array(x.rounds - 1, x.rounds))))))"
    spans = one.withColumn("e", F.expr(edges)).select("s", F.posexplode("e").alias("k", "a"), "e").withColumn("b", F.expr("get(e, k + 1)")).where("b is not null")
    spans = spans.withColumn("m", F.expr("transform(s, x -> cast(if(b < x.rounds, x.n, if(a < x.rounds, x.blocks - (x.rounds - 1) * x.n, 0)) as int))"))
    # A span that ends at a source's last round holds only full rounds of it; one that is that round holds its rest.
    spans = spans.withColumn("m", F.expr("transform(s, (x, i) -> if(b = x.rounds and a < x.rounds - 1, x.n, m[i]))"))
    spans = spans.withColumn("total", F.expr("aggregate(m, 0, (t, x) -> t + x)")).withColumn("by", F.expr(_ROUND))
    placed = spans.select("s", "a", "b", "total", F.posexplode("by").alias("i", "slots")).withColumn("source", F.expr("s[i].source"))
    gathered = placed.groupBy().agg(F.first("s").alias("s"), F.array_sort(F.collect_list(F.struct("a", "b", "total", "source", "slots"))).alias("p"))
    starts = gathered.withColumn("rounds", F.expr("array_sort(array_distinct(transform(p, x -> named_struct('a', x.a, 'size', (x.b - x.a) * x.total))))"))
    return starts.select("s", "p", "rounds", F.explode("s").alias("x")).select(
        F.col("x.source").alias("source"),
        F.expr("""
            transform(filter(p, y -> y.source = x.source and size(y.slots) > 0), y -> named_struct('a', y.a, 'b', y.b, 'total', y.total, 'slots', y.slots,
                'base', aggregate(filter(rounds, r -> r.a < y.a), 0L, (t, r) -> t + r.size)))
        """).alias("spans"),
    )


def _slot(block: Column, weight: Column, spans: str = "spans") -> Column:
    """The slot of a source's block, from its spans."""
    turn = F.floor(block / weight)
    span = F.get(F.filter(spans, lambda x: (x["a"] <= turn) & (turn < x["b"])), F.lit(0))
    return span["base"] + (turn - span["a"]) * span["total"] + F.get(span["slots"], (block - turn * weight).cast("int"))


def mix_sources(documents: DataFrame, weights: Mapping[str, int] = WEIGHTS, default: int = DEFAULT_WEIGHT, block_rows: int = BLOCK_ROWS, names: tuple[str, str, str] = NAMES) -> DataFrame:
    """The given rows and three columns: the block within its source, its slot, and the row's position (gapless from 0).

    Given columns of these names are replaced.
    """
    block, slot, position = names
    kept = [c for c in documents.columns if c not in names]
    # The given columns travel in a struct, so that none of them can have a helper's name.
    given = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("__mix_given")
    rows = documents.select(given, "doc_id", "source").withColumns({"__mix_source": F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")), "__mix_bucket": spread("doc_id")})
    rows = number_rows(rows, ["__mix_source"], "__mix_bucket", [F.xxhash64("doc_id"), F.col("doc_id")], "__mix_row")
    name = F.when(F.col("source") != "", F.substring("source", 2, 1 << 30))
    sizes = documents.groupBy(F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    stock = sizes.select("source", "n", _weight(name, weights, default).alias("weight"), F.ceil(F.col("n") / block_rows).alias("blocks"))
    plan = schedule(stock).join(stock, "source")
    # Only a source's last block can be short: later slots begin that many positions earlier. All sources are one window, a row each.
    short = F.struct(_slot(F.col("blocks") - 1, F.col("weight")).alias("at"), (F.col("blocks") * block_rows - F.col("n")).alias("by"))
    plan = plan.withColumn("short", short).withColumn("shorts", F.collect_list(F.when(F.col("short.by") > 0, F.col("short"))).over(Window.partitionBy(F.lit(0))))
    plan = plan.select(F.col("source").alias("__mix_source"), F.col("weight").alias("__mix_weight"), "spans", "shorts")
    if sizes.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    plan = plan.withColumnsRenamed({"spans": "__mix_spans", "shorts": "__mix_shorts"})
    rows = rows.join(plan, "__mix_source").withColumn(block, F.floor(F.col("__mix_row") / block_rows))
    rows = rows.withColumn(slot, _slot(F.col(block), F.col("__mix_weight"), "__mix_spans"))
    missing = F.aggregate("__mix_shorts", F.lit(0).cast("long"), lambda t, x: F.when(x["at"] < F.col(slot), t + x["by"]).otherwise(t))
    rows = rows.withColumn(position, F.col(slot) * block_rows + F.col("__mix_row") % block_rows - missing)
    return rows.select("__mix_given.*", *names)
