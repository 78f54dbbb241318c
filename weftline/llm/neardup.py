"""MinHash near-duplicates by an inverted join on signature coordinates, confirmed on full shingle sets.

1. Each text becomes its set of distinct word 5-shingles, the set's fingerprint, and ``COORDINATES`` min-hashes.
2. Rows of equal sets are one class, represented by its least id. All further work is on representatives.
3. Two sets of ``percent`` similarity or more agree in ``matches(percent)`` of the coordinates (they miss it with a
   probability of at most ``MISS``), so they share one of any COORDINATES - matches + 1. Representatives are posted under their first
   so many coordinate-value pairs, and those that meet no other there are out. The rest are posted under all pairs;
   pairs that are nobody else's are skipped, and of what remains each representative keeps a prefix of its rarest pairs,
   as many as a partner must share one of.
4. Posting lists of up to ``SHORT_LIST`` members are joined with themselves. Longer ones are not: each member meets the
   list's leader, the member with the commonest coordinates.
5. Candidates that agree in so many coordinates are confirmed on their texts' whole sets, and links make components.
6. Members of long lists that still lie in different components meet in blocks of about ``BLOCK``. Those of the list's
   largest component are not compared with each other, only with the rest. Blocks first meet with ids, sizes and
   coordinates alone; texts are fetched for members that agree with one of another component, and only links leave a
   task. A third of all rows may be in one list: no list is one task, and none sends out its pairs.
7. Links make components by repeated hooking to the least neighbour and pointer jumping.

A class is one node, named by its least id; where several classes have the same least id (rows that share an id), all
but one are named by a hash. Texts are fetched by id and text hash, so that rows that share an id stay apart.

A null or empty text, or one without words, has no shingles, and is linked with nothing; one with fewer than five words
has its whole sequence as one shingle. Rows with a null id are linked with nothing and kept. In ``near_duplicates`` an id
links the classes of all its rows; in ``without_duplicates`` only texts count, and rows are dropped, never all rows of an
id. Repeated rows are equal sets. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm import _bytes
from weftline.llm._spark import fresh, map_texts, materialize, small_batches

WORDS = 5
#: Similarity in percent from which two sets are linked, unless the caller asks for another.
PERCENT = 85
COORDINATES = 64
#: Greatest probability that a pair of just the similarity agrees in too few coordinates: at 85 % 38 are asked for, at 80 % 34.
MISS = 5e-7
SHORT_LIST = 48
BLOCK = 256
#: Up to so many ids (a few MB) are sent to every executor to pick out their texts.
BROADCAST_IDS = 500_000
#: Rows of a written table of links or components that make one file, so that small ones are not spread over many.
ROWS_PER_FILE = 250_000
#: Copies of a class are found by (fingerprint, salt), so that a class of a third of all rows is not one task.
SALTS = 8

_random = np.random.Generator(np.random.PCG64(20240229))
_MULTIPLY = _random.integers(0, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _random.integers(0, 2**63, COORDINATES, dtype=np.uint64)
_WEIGH = _random.integers(0, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@cache
def matches(percent: int) -> int:
    """Coordinates that sets of so many percent similarity agree in, but for a probability of MISS."""
    p, below, m = percent / 100, 0.0, 0
    while m < COORDINATES and (below := below + comb(COORDINATES, m) * p**m * (1 - p) ** (COORDINATES - m)) <= MISS:
        m += 1
    return m


def shingles(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text as sorted hashes, and the texts' offsets in them."""
    h, which, _, offsets = _bytes.joined_words(texts)
    counts = np.diff(offsets)
    n = len(h) - WORDS + 1
    with np.errstate(over="ignore"):
        if n > 0:
            value = np.zeros(n, np.uint64)
            for j in range(WORDS):
                value += h[j : j + n] * _WEIGH[j]
            inside = which[:n] == which[WORDS - 1 :]
            value, owner = _bytes.mix(value[inside]), which[:n][inside]
        else:
            value, owner = np.empty(0, np.uint64), np.empty(0, np.int64)
        short = np.flatnonzero((counts > 0) & (counts < WORDS))
        whole = [np.uint64(counts[i]) + (h[offsets[i] : offsets[i + 1]] * _WEIGH[: counts[i]]).sum(dtype=np.uint64) for i in short]
        value, owner = np.concatenate([value, _bytes.mix(np.array(whole, np.uint64))]), np.concatenate([owner, short])
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    first = np.ones(len(value), bool)
    first[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[first], owner[first]
    return value, np.searchsorted(owner, np.arange(len(texts) + 1))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _bytes.pieces(batches, 1):
        value, offsets = shingles(batch.column(1).to_pylist())
        size = np.diff(offsets)
        full = np.flatnonzero(size)
        at = offsets[:-1][full]
        marks, signature = np.zeros((len(size), 2), np.uint64), np.zeros((len(size), COORDINATES), np.uint32)
        if len(full):
            with np.errstate(over="ignore"):
                marks[full, 0] = np.add.reduceat(value, at)
                marks[full, 1] = np.add.reduceat(_bytes.mix(value ^ _ADD[0]), at)
                for c in range(COORDINATES):
                    signature[full, c] = np.minimum.reduceat((value * _MULTIPLY[c] + _ADD[c]) >> np.uint64(32), at)
        flat = pa.array(signature.view(np.int32).ravel())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * COORDINATES), flat)
        arrays = [batch.column(0), batch.column(2), pa.array(size), *[pa.array(marks[:, k].view(np.int64)) for k in (0, 1)], lists]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "t", "n", "f1", "f2", "signature"])


def signatures(documents: DataFrame) -> DataFrame:
    """doc_id, t (hash of the text), n (shingles), f1 and f2 (the set's fingerprint) and signature of every row."""
    return map_texts(documents, _signatures, "doc_id long, t long, n long, f1 long, f2 long, signature array<int>", text_hash())


def text_hash() -> Column:
    """Tells the rows of an id apart."""
    return F.xxhash64(F.col("text").cast("binary")).alias("t")


def _posted(signatures: DataFrame, coordinates: int, *more: str) -> DataFrame:
    """A row for each of the first coordinates: ``key`` is the coordinate and its value."""
    rows = signatures.select("doc", *more, F.posexplode(F.slice("signature", 1, coordinates)).alias("c", "v"))
    return rows.select("doc", *more, (F.col("c").cast("long") * (1 << 32) + F.col("v").cast("long")).alias("key"))


def prefixes(representatives: DataFrame, percent: int) -> DataFrame:
    """key, doc, n and heat: the postings that partners must share one of. representatives: doc, n, signature.

    Keys that occur twice or more are written before they are joined, so that Spark can split a frequent key's postings.
    """
    agree = matches(percent)
    must_share = COORDINATES - agree + 1
    first = _posted(representatives, must_share)
    twice = materialize(first.groupBy("key").count().where("count > 1").select("key"), "neardup-keys")
    some = materialize(representatives.join(first.join(twice, "key").select("doc").distinct(), "doc"), "neardup-met")
    every = _posted(some, COORDINATES, "n")
    times = materialize(every.groupBy("key").agg(F.count(F.lit(1)).alias("times")).where("times > 1"), "neardup-times")
    rarest = every.join(times, "key").groupBy("doc", "n").agg(F.array_sort(F.collect_list(F.struct("times", "key"))).alias("p"), F.sum("times").alias("heat"))
    rarest = rarest.where(F.size("p") >= agree).withColumn("p", F.slice("p", F.lit(1), F.size("p") - agree + 1))
    return rarest.select("doc", "n", "heat", F.explode("p.key").alias("key"))


def _sizes_fit(a: str, b: str, percent: int):
    return F.least(F.col(a), F.col(b)) * 100 >= F.greatest(F.col(a), F.col(b)) * percent


def _agreeing(pairs: DataFrame, representatives: DataFrame, percent: int) -> DataFrame:
    """The distinct pairs a < b that agree in matches(percent) coordinates."""
    one = representatives.select(F.col("doc").alias("a"), F.col("signature").alias("sa"))
    two = representatives.select(F.col("doc").alias("b"), F.col("signature").alias("sb"))
    same = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda t, x: t + x)
    return pairs.distinct().join(one, "a").join(two, "b").where(same >= matches(percent)).select("a", "b").distinct()


def _confirm(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _bytes.pieces(batches, 2, 3):
            a, b, ta, tb = (c.to_pylist() for c in batch.columns)
            keep, last, known = [], None, np.empty(0, np.uint64)
            for x, s, t in zip(a, ta, tb, strict=True):
                if last is None or last != (x, len(s)):
                    last, known = (x, len(s)), shingles([s])[0]
                other = shingles([t])[0]
                both = len(np.intersect1d(known, other, assume_unique=True))
                keep.append(bool(both) and 100 * both >= percent * (len(known) + len(other) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return confirm


def _texts_of(nodes: DataFrame, representatives: DataFrame, documents: DataFrame) -> DataFrame:
    """doc and text of the given nodes (doc, distinct), as a written table. A few are sent to the documents, many meet them by shuffle."""
    wanted = materialize(representatives.join(nodes, "doc").select("doc", "doc_id", "t"), "neardup-ids")
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    given = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), text_hash())
    return materialize(given.where("text is not null").join(wanted, ["doc_id", "t"]).select("doc", "text"), "neardup-texts")


def confirmed(pairs: DataFrame, representatives: DataFrame, documents: DataFrame, percent: int) -> DataFrame:
    """The pairs (a written table) whose whole sets are similar enough. Texts of repeated rows confirm a pair more than once."""
    texts = _texts_of(pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct(), representatives, documents)
    both = pairs.join(texts.select(F.col("doc").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("doc").alias("a"), F.col("text").alias("ta")), "a")
    small_batches(documents.sparkSession)
    return both.select("a", "b", "ta", "tb").mapInArrow(_confirm(percent), "a long, b long").distinct()


def components(links: DataFrame, label: str) -> DataFrame:
    """doc and comp (the least id reachable) of every id in the links a, b."""
    links = materialize(links.select("a", "b").distinct(), f"{label}-pairs")
    files = -(-links.count() // ROWS_PER_FILE) or 1
    both = materialize(links.select(F.explode(F.array(F.struct(F.col("a").alias("doc"), F.col("b").alias("other")), F.struct(F.col("b").alias("doc"), F.col("a").alias("other")))).alias("x")).select("x.*"), f"{label}-links")
    now = materialize(both.groupBy("doc").agg(F.least(F.min("other"), F.col("doc")).alias("comp")).coalesce(files), label)
    for k in range(64):
        near = both.join(now.select(F.col("doc").alias("other"), "comp"), "other").groupBy("doc").agg(F.min("comp").alias("near"))
        hooked = now.join(near, "doc").select("doc", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        jump = now.select(F.col("doc").alias("comp"), F.col("comp").alias("root"))
        after = hooked.join(jump, "comp").select("doc", "was", F.least("comp", "root").alias("comp"))
        after = materialize(after.coalesce(files), f"{label}-{k}")
        now = after.select("doc", "comp")
        if not after.where("was != comp").limit(1).count():
            return now
    raise RuntimeError("components did not settle")


def _fitting(frame: pd.DataFrame, percent: int) -> Callable[[int, np.ndarray], np.ndarray]:
    """For a block pair's member ``at`` and the components so far: the later members it has to be compared with."""
    n, block, guest, big = (frame[c].to_numpy() for c in ("n", "block", "guest", "big"))
    signature, agree = np.stack(frame["signature"].to_numpy()), matches(percent)
    other_block = frame["i"].iloc[0] != frame["j"].iloc[0]

    def fitting(at: int, now: np.ndarray) -> np.ndarray:
        ok = (now[at + 1 :] != now[at]) & ~(guest[at + 1 :] & guest[at]) & ~(big[at + 1 :] & big[at])
        ok &= np.minimum(n[at + 1 :], n[at]) * 100 >= np.maximum(n[at + 1 :], n[at]) * percent
        if other_block:
            ok &= block[at + 1 :] != block[at]
        to = np.flatnonzero(ok) + at + 1
        return to[(signature[to] == signature[at]).sum(axis=1) >= agree]

    return fitting


def _agree(percent: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Members of one block pair that agree in matches(percent) coordinates with one of another component."""

    def agree(frame: pd.DataFrame) -> pd.DataFrame:
        fitting, (_, now) = _fitting(frame, percent), np.unique(frame["comp"].to_numpy(), return_inverse=True)
        found = np.zeros(len(frame), bool)
        for at in range(len(frame) - 1):
            to = fitting(at, now)
            found[to] = True
            found[at] |= len(to) > 0
        return frame[found]

    return agree


def _meet(percent: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Links of one block pair by whole sets. Members that a link found here joins are not compared again, so at most as many links as members leave the task."""

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        docs, texts = frame["doc"].to_numpy(), frame["text"].to_numpy()
        fitting, (_, now) = _fitting(frame, percent), np.unique(frame["comp"].to_numpy(), return_inverse=True)
        sets: dict[int, np.ndarray] = {}

        def of(k: int) -> np.ndarray:
            if k not in sets:
                sets[k] = shingles([texts[k]])[0]
            return sets[k]

        links = []
        for at in range(len(docs) - 1):
            for k in fitting(at, now).tolist():
                if now[k] == now[at]:
                    continue
                both = len(np.intersect1d(of(at), of(k), assume_unique=True))
                if 100 * both >= percent * (len(of(at)) + len(of(k)) - both):
                    links.append((docs[at], docs[k]))
                    now[now == now[k]] = now[at]
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return meet


def _rest(long: DataFrame, linked: DataFrame, representatives: DataFrame, documents: DataFrame, percent: int) -> DataFrame:
    """Links among the members of long lists (doc, n, leader) that are still in different components.

    Lists that share members are one cluster, so that no pair is compared list by list; within it only members of sizes
    that fit meet: a cell holds one range of sizes, and the next range as guests. A cell's largest component (``big``) is
    cut into blocks of its own, which meet the blocks of the rest but not each other: with few members left over, each
    one of the largest is copied once or a few times.
    """
    met = long.where("doc <> leader").select(F.col("doc").alias("a"), F.col("leader").alias("b")).distinct()
    clusters = components(met, "neardup-cluster").withColumnRenamed("comp", "cluster")
    members = long.select("doc", "n").distinct().join(clusters, "doc").join(linked, "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))
    # A little wider than the similarity asks for, so that rounding can't part two that fit.
    members = members.withColumn("range", F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / (percent - 1)))).cast("int"))
    cells = members.withColumn("guest", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("cell", F.col("range") - F.col("guest").cast("int"))
    cells = materialize(cells.select("doc", "n", "comp", "cluster", "cell", "guest"), "neardup-cells")
    parts = cells.groupBy("cluster", "cell", "comp").agg(F.count(F.lit(1)).alias("m"), F.min("guest").alias("only_guests"))
    size = parts.groupBy("cluster", "cell").agg(F.max_by("comp", F.struct("m", "comp")).alias("most"), F.max("m").alias("top"), F.sum("m").alias("m"), F.min("only_guests").alias("only_guests"))
    size = size.where("m > top AND NOT only_guests")
    size = materialize(size.select("cluster", "cell", "most", F.ceil(F.col("top") / BLOCK).cast("int").alias("big_blocks"), F.ceil((F.col("m") - F.col("top")) / BLOCK).cast("int").alias("blocks")), "neardup-sizes")
    own = cells.join(size, ["cluster", "cell"]).withColumn("big", F.col("comp") == F.col("most"))
    # The rest's blocks are 0 to blocks - 1, those of the largest component follow.
    hashed = lambda many: F.pmod(F.xxhash64("doc"), F.col(many)).cast("int")
    own = own.withColumn("block", F.when(F.col("big"), F.col("blocks") + hashed("big_blocks")).otherwise(hashed("blocks")))
    last = F.when(F.col("big"), F.col("blocks")).otherwise(F.col("blocks") + F.col("big_blocks")) - 1
    own = own.withColumn("with", F.explode(F.sequence(F.lit(0), last))).withColumns({"i": F.least("block", "with"), "j": F.greatest("block", "with")})
    keys = ["cluster", "cell", "i", "j"]
    own = own.select(*keys, "block", "guest", "big", "doc", "n", "comp").join(representatives.select("doc", "signature"), "doc").select(*keys, "block", "guest", "big", "doc", "n", "comp", "signature")
    small_batches(documents.sparkSession)
    kinds = "cluster long, cell int, i int, j int, block int, guest boolean, big boolean, doc long, n long, comp long, signature array<int>"
    near = materialize(own.groupBy(*keys).applyInPandas(_agree(percent), kinds), "neardup-agree")
    texts = _texts_of(near.select("doc").distinct(), representatives, documents).groupBy("doc").agg(F.first("text").alias("text"))
    return near.join(texts, "doc").select(*keys, "block", "guest", "big", "doc", "n", "comp", "signature", "text").groupBy(*keys).applyInPandas(_meet(percent), "a long, b long")


def linked_classes(documents: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """Written tables: every row's doc_id, t and set; the classes with their node ``doc``, representative row (doc_id, t) and copies; the links of
    similar classes; and the ids of rows of several sets, if there are any."""
    rows = materialize(signatures(documents), "neardup-signatures")
    usable = rows.where("n > 0 and doc_id is not null")
    classes = usable.groupBy("f1", "f2", "n").agg(F.min(F.struct("doc_id", "t", "signature")).alias("first"), F.count(F.lit(1)).alias("copies"))
    classes = classes.select("f1", "f2", "n", F.col("first.doc_id").alias("doc_id"), F.col("first.t").alias("t"), F.col("first.signature").alias("signature"), "copies")
    sets = F.struct("f1", "f2", "n")
    shared = materialize(usable.groupBy("doc_id").agg((F.min(sets) != F.max(sets)).alias("several")).where("several").select("doc_id"), "neardup-shared")
    if shared.limit(1).count():
        turn = Window.partitionBy("doc_id").orderBy("f1", "f2", "n")
        classes = classes.withColumn("doc", F.when(F.row_number().over(turn) == 1, F.col("doc_id")).otherwise(F.xxhash64("doc_id", "f1", "f2", "n")))
    else:
        shared, classes = None, classes.withColumn("doc", F.col("doc_id"))
    classes = materialize(classes, "neardup-classes")
    return rows, classes, materialize(_links(classes.select("doc", "doc_id", "t", "n", "signature"), documents, percent), "neardup-all-links"), shared


def _links(representatives: DataFrame, documents: DataFrame, percent: int) -> DataFrame:
    """Links a, b between nodes of similar sets, enough to connect all that are similar."""
    posted = materialize(prefixes(representatives, percent), "neardup-postings")
    lists = materialize(posted.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.max(F.struct("heat", -F.col("doc"), "n")).alias("top")).where("m > 1"), "neardup-lists")
    short = posted.join(lists.where(F.col("m") <= SHORT_LIST).select("key"), "key").select("key", "doc", "n")
    one, two = short.select("key", F.col("doc").alias("a"), F.col("n").alias("na")), short.select("key", F.col("doc").alias("b"), F.col("n").alias("nb"))
    near = one.join(two, "key").where(F.col("a") < F.col("b")).where(_sizes_fit("na", "nb", percent)).select("a", "b")
    leaders = lists.where(F.col("m") > SHORT_LIST).select("key", (-F.col("top.col2")).alias("leader"), F.col("top.n").alias("nl"))
    long = posted.join(leaders, "key")
    star = long.where(F.col("doc") != F.col("leader")).where(_sizes_fit("n", "nl", percent)).select(F.least("doc", "leader").alias("a"), F.greatest("doc", "leader").alias("b"))
    candidates = materialize(_agreeing(near.union(star), representatives, percent), "neardup-candidates")
    links = materialize(confirmed(candidates, representatives, documents, percent), "neardup-links")
    members = materialize(long.select("doc", "n", "leader").distinct(), "neardup-long")
    if not members.limit(1).count():
        return links
    return links.union(_rest(members, components(links, "neardup-comp"), representatives, documents, percent))


def _told(rows: DataFrame, named: DataFrame) -> DataFrame:
    """The rows with the columns of their class (left join). A class of a third of all rows is met in SALTS parts."""
    salted = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.drop("signature").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["f1", "f2", "n", "salt"], "left")


def near_duplicates(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row; sets of ``percent`` similarity or more are linked, and the sets of rows that share an id."""
    rows, classes, links, shared = linked_classes(documents, percent)
    if shared is not None:
        twice = rows.where("n > 0").join(shared, "doc_id").select("doc_id", "f1", "f2", "n").distinct()
        nodes = twice.withColumnRenamed("doc_id", "id").join(classes.select("f1", "f2", "n", "doc"), ["f1", "f2", "n"])
        links = links.union(nodes.select(F.min("doc").over(Window.partitionBy("id")).alias("a"), F.col("doc").alias("b")).where("a <> b"))
    linked = components(links, "neardup-comp")
    named = classes.join(linked, "doc", "left").where("copies > 1 or comp is not null").select("f1", "f2", "n", F.coalesce("comp", "doc").alias("comp"), F.col("doc_id").alias("first"))
    if shared is not None:  # a component's node may be a hash
        named = named.join(named.groupBy("comp").agg(F.min("first").alias("least")), "comp").withColumn("comp", F.col("least")).drop("least")
    told = _told(rows, named.drop("first"))
    component = F.when(F.col("n") > 0, F.coalesce("comp", "doc_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return told.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def without_duplicates(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The given rows, one of each component of similar texts: that of the least id, of rows with that id one text's, of repeated rows one.

    Rows without words and rows with a null id all stay.
    """
    rows, classes, links, _ = linked_classes(documents, percent)
    named = classes.join(components(links, "neardup-comp"), "doc", "left").where("copies > 1 or comp is not null").withColumn("comp", F.coalesce("comp", "doc"))
    best = named.groupBy("comp").agg(F.min(F.struct("doc_id", "t")).alias("best"))
    named = named.join(best, "comp").select("f1", "f2", "n", F.col("best.doc_id").alias("best_id"), F.col("best.t").alias("best_t"))
    told = materialize(_told(rows.where("n > 0 and doc_id is not null"), named).where("best_id is not null").select("doc_id", "t", ((F.col("doc_id") == F.col("best_id")) & (F.col("t") == F.col("best_t"))).alias("best")), "neardup-told")
    key = ["doc_id", fresh(documents, "__neardup_text")]
    dropped = told.where("not best").select("doc_id", F.col("t").alias(key[1])).distinct()
    if dropped.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        dropped = F.broadcast(dropped)
    hashed = documents.withColumn(key[1], text_hash())
    rest = hashed.join(dropped, key, "left_anti")
    twice = told.where("best").groupBy("doc_id", F.col("t").alias(key[1])).count().where("count > 1").select(*key)
    if not twice.limit(1).count():
        return rest.select(*documents.columns)
    repeated = rest.join(twice, key, "left_semi").dropDuplicates(key)
    return rest.join(twice, key, "left_anti").select(*documents.columns).unionByName(repeated.select(*documents.columns))
