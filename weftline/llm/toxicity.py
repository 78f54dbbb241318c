"""Toxicity from the nearest labelled examples by exact TF-IDF cosine over block-max inverted indexes.

1. Examples: ``EXAMPLES_PER_CLASS`` labelled ids of each class at most, those of least hash. Of examples of a class whose
   texts share their least 5-word shingle hash (copies, and nearly always near copies) one stays, that of the least id:
   else the words of one text that was copied often would look like signs of its class.
2. Terms: every word of the examples and its beginnings in ``PREFIXES`` bytes. None is left out. A term's weight is
   its inverse document frequency over the whole corpus times its relevance frequency, log2(2 + a / max(1, b)) with a
   toxic and b clean examples that hold it (b scaled to as many examples as a), which is 1 at least. Without the second
   factor the nearest examples are those of the same subject (see the README's figures).
3. Index: examples lie in blocks of ``BLOCK``, ordered by their weightiest terms. Rarer terms have postings; the
   ``DENSE`` commonest, which most examples hold, have a row of all examples' weights. Both have each block's greatest.
4. Search: a group of texts is searched together. Postings give the rare terms' share of every cosine; with the greatest
   of it in a block and the common terms' block maxima this bounds the block. A query's best block gives a k-th cosine,
   then every block that can reach it is worked out.
5. Score: neighbours vote by their cosine, relative to the nearest, smoothed by the examples' share; isotonic steps
   turn votes into shares of toxic documents. They are fitted on the examples, each without itself, weighted by the
   classes' sizes among all usable labels. Neighbours are returned as evidence.

Documents that hold no term of an example (empty and null texts among them) get the smoothed share of toxic examples
that have no words either. Without examples the score is 0.5. Of several labels of an id the rounded mean counts, of several texts of a
labelled id the least; null labels and ids are not learned from. Ties in cosine go to the smaller id. Repeated rows are
scored alike, an empty table gives an empty result, and other columns of the inputs are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm import _bytes
from weftline.llm._spark import map_texts, materialize, small_batches
from weftline.llm.neardup import shingles
from weftline.llm.quality import rated, training_sample

EXAMPLES_PER_CLASS = 1_500
PREFIXES = (5, 7)
DENSE = 1024
NEIGHBOURS = 25
BLOCK = 64
#: Weight of the examples' share in a vote, as so many of the nearest neighbour.
PRIOR_WEIGHT = 0.5
#: Bytes of text and texts searched together (a text has a cosine with every example), and postings read at a time.
GROUP_BYTES, GROUP_TEXTS, POSTINGS = 512 << 10, 256, 1 << 18


@dataclass
class Counts:
    """Distinct terms of several texts: text k has ``terms`` and ``times`` from offsets[k] to offsets[k + 1]."""

    offsets: np.ndarray
    terms: np.ndarray
    times: np.ndarray

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))


def hashed_counts(texts: Sequence[bytes | None]) -> Counts:
    """Counts by hash."""
    h, which = _bytes.word_terms(texts, PREFIXES)
    order = np.lexsort((h, which))
    h, which = h[order], which[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (which[1:] != which[:-1])
    at = np.flatnonzero(first)
    return Counts(np.searchsorted(which[at], np.arange(len(texts) + 1)), h[at], np.diff(np.append(at, len(h))))


def known_counts(texts: Sequence[bytes | None], table: _bytes.Places) -> Counts:
    """Counts of the table's terms, by number."""
    h, which = _bytes.word_terms(texts, PREFIXES)
    place = table.of(h)
    hit = place >= 0
    many = max(len(table.keys), 1)
    cell, times = np.unique(which[hit] * many + place[hit], return_counts=True)
    return Counts(np.searchsorted(cell, np.arange(len(texts) + 1) * many), cell % many, times)


def joined(parts: Sequence[Counts]) -> Counts:
    """The counts of all texts of the parts (one at least)."""
    sizes = np.concatenate([np.zeros(1, np.int64), *[np.diff(p.offsets) for p in parts]])
    return Counts(np.cumsum(sizes), np.concatenate([p.terms for p in parts]), np.concatenate([p.times for p in parts]))


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each labelled text's least shingle, and its terms and counts as bytes."""
    for batch in _bytes.pieces(batches, 2):
        texts = batch.column(2).to_pylist()
        value, offsets = shingles(texts)
        least = np.zeros(len(texts), np.uint64)
        full = np.flatnonzero(np.diff(offsets))
        least[full] = value[offsets[full]]  # each text's shingles are sorted
        counts = hashed_counts(texts)
        packed = [[x[a:b].tobytes() for a, b in zip(counts.offsets[:-1], counts.offsets[1:], strict=True)] for x in (counts.terms, counts.times.astype(np.int32))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(least.view(np.int64)), *[pa.array(x, pa.binary()) for x in packed]], names=["doc_id", "label", "least", "terms", "times"])


def examples(documents: DataFrame, labels: DataFrame, usable: Column) -> pd.DataFrame:
    """The examples on the driver: doc_id, label, terms and times, 2 x EXAMPLES_PER_CLASS rows at most, one of each group of copies."""
    drawn = F.broadcast(training_sample(labels, "toxic", usable, EXAMPLES_PER_CLASS))
    small_batches(documents.sparkSession)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    chosen = texts.join(drawn, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    rows = materialize(chosen.mapInArrow(_examples, "doc_id long, label int, least long, terms binary, times binary"), "toxic-examples").toPandas().sort_values("doc_id")
    copies = rows.duplicated(["least", "label"]) & (rows["least"] != 0)
    return rows[~copies].reset_index(drop=True)


def document_frequencies(documents: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """Documents of the whole corpus that hold each term, and how many documents there are. Each task sends one row for each term that it saw."""
    known = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen, rows = _bytes.Places(known.value), np.zeros(len(known.value), np.int64), 0
        for batch in _bytes.pieces(batches, 1, size=GROUP_BYTES):
            seen += np.bincount(known_counts(batch.column(1).to_pylist(), table).terms, minlength=len(seen))
            rows += batch.num_rows
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(seen[at], rows))], names=["term", "n"])

    total = map_texts(documents, count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    found = np.zeros(len(vocabulary), np.int64)
    inside = total["term"] >= 0
    found[total["term"][inside]] = total["n"][inside]
    return found, int(total["n"][~inside].sum())


def relevance_frequency(toxic: np.ndarray, clean: np.ndarray, scale: float) -> np.ndarray:
    """log2(2 + a / max(1, b * scale)) of terms in a toxic and b clean examples."""
    return np.log2(2 + toxic / np.maximum(1, clean * scale))


@dataclass
class Index:
    """Unit vectors of the examples by block, the terms' weights, and the calibration. Stored in single precision, searched in double."""

    vocabulary: np.ndarray
    weight: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    #: A common term's row in ``dense``, -1 for others; the others' postings are place and value from start[t] to start[t + 1].
    row: np.ndarray
    dense: np.ndarray
    start: np.ndarray
    place: np.ndarray
    value: np.ndarray
    share: float
    empty_score: float
    steps: tuple[np.ndarray, np.ndarray] = (np.empty(0), np.empty(0))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def vectors(self, counts: Counts) -> np.ndarray:
        """Weights of the terms, of length 1 in each text."""
        v = (1 + np.log(counts.times)) * self.weight[counts.terms]
        owner = counts.owners()
        return v / np.sqrt(np.bincount(owner, v * v, len(counts.offsets) - 1))[owner]

    def ready(self) -> Index:
        """With the common terms' block maxima, which the next task of a worker finds."""
        if not hasattr(self, "_most"):
            starts = np.arange(0, len(self.ids), BLOCK)
            self._most = np.maximum.reduceat(self.dense, starts, axis=1).astype(np.float64) if len(starts) else np.zeros((len(self.dense), 0))
        return self

    def _rare(self, owner: np.ndarray, terms: np.ndarray, q: np.ndarray, n: int, wide: int) -> np.ndarray:
        """Sums over the rarer terms' postings, texts x examples, for about ``POSTINGS`` at a time."""
        total = np.zeros(n * wide)
        first = self.start[terms].astype(np.int64)
        size = self.start[terms + 1] - first
        upto = np.concatenate([[0], np.cumsum(size)])
        edges = np.unique(np.minimum(np.searchsorted(upto, np.arange(0, upto[-1] + POSTINGS, POSTINGS)), len(size)))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            many = size[a:b]
            at = np.repeat(first[a:b] - upto[a:b], many)
            at += np.arange(upto[a], upto[b])
            cell = np.repeat(owner[a:b] * wide, many)
            cell += self.place[at]
            product = np.repeat(q[a:b], many)
            product *= self.value[at]
            low = int(owner[a]) * wide
            cell -= low
            part = np.bincount(cell, product)
            total[low : low + len(part)] += part
        return total.reshape(n, wide)

    def nearest(self, counts: Counts, many: int = NEIGHBOURS) -> list[tuple[np.ndarray, np.ndarray]]:
        """Places and cosines of each text's nearest examples: greatest cosine first, ties by id; only cosines over 0."""
        n, wide = len(counts.offsets) - 1, self._most.shape[1] * BLOCK
        if not wide or not n:
            return [(np.empty(0, np.int64), np.empty(0))] * n
        owner, q = counts.owners(), self.vectors(counts)
        row = self.row[counts.terms]
        common = np.zeros((n, len(self.dense)))
        common[owner[row >= 0], row[row >= 0]] = q[row >= 0]
        rare = row < 0
        cosine = self._rare(owner[rare], counts.terms[rare], q[rare], n, wide)
        blocks = wide // BLOCK
        bound = cosine.reshape(n, blocks, BLOCK).max(axis=2) + common @ self._most
        done = np.zeros((n, blocks), bool)

        def work_out(todo: np.ndarray) -> None:
            for b in np.flatnonzero(todo.any(axis=0)).tolist():
                who, span = np.flatnonzero(todo[:, b]), slice(b * BLOCK, min((b + 1) * BLOCK, len(self.ids)))
                cosine[who, span] += common[who] @ self.dense[:, span].astype(np.float64)
            done[todo] = True

        # Enough of the best blocks for ``many`` examples give a cosine that the result reaches.
        lead = min(blocks, -(-many // BLOCK))
        best = np.argsort(-bound, axis=1, kind="stable")[:, :lead]
        todo = np.zeros((n, blocks), bool)
        np.put_along_axis(todo, best, True, axis=1)
        work_out(todo)
        some = np.take_along_axis(cosine.reshape(n, blocks, BLOCK), best[:, :, None], axis=1).reshape(n, -1)
        least = -np.sort(-some, axis=1)[:, min(many, some.shape[1]) - 1]
        work_out((bound >= least[:, None] - 1e-9) & ~done)
        np.round(cosine, 12, out=cosine)
        cosine[~np.repeat(done, BLOCK, axis=1)] = 0
        cosine = cosine[:, : len(self.ids)]
        top = min(many, len(self.ids))
        least = np.maximum(np.partition(cosine, len(self.ids) - top, axis=1)[:, len(self.ids) - top], 1e-12)
        found = []
        for k in range(n):
            near = np.flatnonzero(cosine[k] >= least[k])
            near = near[np.lexsort((self.ids[near], -cosine[k, near]))[:many]]
            found.append((near, cosine[k, near]))
        return found

    def vote(self, at: np.ndarray, cosines: np.ndarray) -> float:
        if not len(at):
            return self.share
        w = cosines / cosines[0]
        return float((w @ self.labels[at] + PRIOR_WEIGHT * self.share) / (w.sum() + PRIOR_WEIGHT))

    def scores(self, found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        votes = np.array([self.vote(*x) for x in found])
        calibrated = np.interp(votes, *self.steps) if len(self.steps[0]) else votes
        return np.where([len(x[0]) > 0 for x in found], calibrated, self.empty_score) if found else np.empty(0)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Monotone steps of mean ``y`` over ``x`` with weights by pooling adjacent violators, as points to interpolate."""
    pools: list[list[float]] = []  # sums of w * x, w * y and w
    points, at = np.unique(x, return_inverse=True)
    for point, sum_y, sum_w in zip(points, np.bincount(at, w * y), np.bincount(at, w), strict=True):
        pools.append([point * sum_w, sum_y, sum_w])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            top = pools.pop()
            pools[-1] = [u + v for u, v in zip(pools[-1], top, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([(p[1] + 0.5) / (p[2] + 1) for p in pools])


def build_index(ids: np.ndarray, labels: np.ndarray, counts: Counts, vocabulary: np.ndarray, frequencies: np.ndarray, documents: int, class_sizes: tuple[int, int]) -> Index:
    """The index of examples with the given counts (terms are numbers in the sorted vocabulary). class_sizes: usable labels 0 and 1."""
    labels = labels.astype(np.float64)
    owner = counts.owners()
    toxic, clean = (np.bincount(counts.terms, labels[owner] == y, len(vocabulary)) for y in (1, 0))
    scale = labels.sum() / max((1 - labels).sum(), 1)
    weight = (np.log((1 + documents) / (1 + frequencies)) + 1) * relevance_frequency(toxic, clean, scale)
    each = np.where(labels > 0, class_sizes[1] / max(labels.sum(), 1), class_sizes[0] / max((1 - labels).sum(), 1))
    prior = (each @ labels + 0.5) / (each.sum() + 1)
    bare = np.diff(counts.offsets) == 0
    empty_score = float((each[bare] @ labels[bare] + 0.5 * prior) / (each[bare].sum() + 0.5))
    held = toxic + clean
    common = np.sort(np.argsort(-held, kind="stable")[: min(DENSE, len(vocabulary))])
    row = np.full(len(vocabulary), -1, np.int32)
    row[common] = np.arange(len(common))
    index = Index(vocabulary, weight, ids, labels, row, np.empty((0, 0), np.float32), np.empty(0), np.empty(0), np.empty(0), float((labels.sum() + 0.5) / (len(labels) + 1)), empty_score)

    unit = index.vectors(counts)
    weightiest = [tuple(counts.terms[a:b][np.argsort(-unit[a:b], kind="stable")[:8]].tolist()) for a, b in zip(counts.offsets[:-1], counts.offsets[1:], strict=True)]
    unit = unit.astype(np.float32)
    order = np.array(sorted(np.flatnonzero(~bare), key=lambda k: (weightiest[k], ids[k])), np.int64)
    place_of = np.full(len(ids), -1, np.int64)
    place_of[order] = np.arange(len(order))
    index.ids, index.labels = ids[order], labels[order]
    place, rows = place_of[owner], row[counts.terms]
    index.dense = np.zeros((len(common), len(order)), np.float32)
    index.dense[rows[rows >= 0], place[rows >= 0]] = unit[rows >= 0]
    rare = np.flatnonzero(rows < 0)
    rare = rare[np.argsort(counts.terms[rare], kind="stable")]
    index.start = np.searchsorted(counts.terms[rare], np.arange(len(vocabulary) + 1)).astype(np.int32)
    index.place, index.value = place[rare].astype(np.int32), unit[rare].astype(np.float32)

    del unit, place, rows, rare, owner, toxic, clean
    index.ready()
    votes = []
    for at in range(0, len(order), 128):
        docs = order[at : at + 128]
        own = joined([Counts(np.array([0, counts.offsets[k + 1] - counts.offsets[k]]), counts.terms[counts.offsets[k] : counts.offsets[k + 1]], counts.times[counts.offsets[k] : counts.offsets[k + 1]]) for k in docs])
        for k, (near, cosines) in enumerate(index.nearest(own, NEIGHBOURS + 1), at):
            others = near != k
            votes.append(index.vote(near[others][:NEIGHBOURS], cosines[others][:NEIGHBOURS]))
    del index._most
    if votes:
        w = each[order]
        index.steps = isotonic(np.array(votes), index.labels, w * len(w) / max(w.sum(), 1e-12))
    return index


def train(documents: DataFrame, labels: DataFrame, usable: Column) -> Index | None:
    """The index, or None without examples."""
    rows = examples(documents, labels, usable)
    if not len(rows):
        return None
    ids, kinds = rows["doc_id"].to_numpy(np.int64), rows["label"].to_numpy()
    offsets = np.concatenate([[0], np.cumsum(rows["terms"].map(len).to_numpy() // 8)])
    hashes = np.frombuffer(b"".join(rows.pop("terms")), np.uint64)
    times = np.frombuffer(b"".join(rows.pop("times")), np.int32)
    vocabulary = np.unique(hashes)
    numbered = Counts(offsets, np.searchsorted(vocabulary, hashes).astype(np.int32), times)
    del rows, hashes
    sizes = {r["label"]: r["count"] for r in rated(labels, "toxic", usable).groupBy("label").count().collect()}
    frequencies, total = document_frequencies(documents, vocabulary)
    return build_index(ids, kinds, numbered, vocabulary, frequencies, total, (sizes.get(0, 0), sizes.get(1, 0)))


def score_texts(documents: DataFrame, index: Index | None, name: str = "__score") -> DataFrame:
    """The input's own columns and the score, in a column of a name that they don't have."""
    small_batches(documents.sparkSession)
    model = documents.sparkSession.sparkContext.broadcast(index)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = model.value and model.value.ready()
        table = index and _bytes.Places(index.vocabulary)
        for texts in batches:
            values = texts.tolist()
            parts = [index.scores(index.nearest(known_counts(values[a:b], table))) if index else np.full(b - a, 0.5) for a, b in _bytes.groups(values, GROUP_BYTES, GROUP_TEXTS)]
            yield pd.Series(np.concatenate([np.empty(0), *parts]))

    return documents.withColumn(name, score(F.col("text").cast("binary")))


def toxic_scores(documents: DataFrame, labels: DataFrame, usable: Column) -> DataFrame:
    """doc_id and score of every document, and the evidence: ids, cosines and labels of the nearest examples."""
    model = documents.sparkSession.sparkContext.broadcast(train(documents, labels, usable))
    kinds = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("evidence", pa.list_(pa.int64())), ("cosines", pa.list_(pa.float64())), ("evidence_labels", pa.list_(pa.int32()))])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = model.value and model.value.ready()
        table = index and _bytes.Places(index.vocabulary)
        for batch in _bytes.pieces(batches, 1, size=GROUP_BYTES, many=GROUP_TEXTS):
            found = index.nearest(known_counts(batch.column(1).to_pylist(), table)) if index else [(np.empty(0, np.int64), np.empty(0))] * batch.num_rows
            scores = index.scores(found) if index else np.full(batch.num_rows, 0.5)
            at = np.concatenate([np.empty(0, np.int64), *[x[0] for x in found]])
            offsets = pa.array(np.cumsum([0, *[len(x[0]) for x in found]]), pa.int32())
            values = [index.ids[at], np.concatenate([x[1] for x in found]), index.labels[at].astype(np.int32)] if len(at) else [at, np.empty(0), at]
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, k.type.value_type)) for x, k in zip(values, list(kinds)[2:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), *lists], schema=kinds)

    return map_texts(documents, score, "doc_id long, score double, evidence array<long>, cosines array<double>, evidence_labels array<int>")
