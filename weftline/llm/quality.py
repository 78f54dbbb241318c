"""Quality classifier: histogram gradient-boosted trees over document statistics.

``text_statistics`` turns texts into 20 statistics; ``fit`` learns trees from those of a bounded sample of labelled rows
(``SAMPLE_PER_CLASS`` of each label, the least by hash of their id); ``classify`` works out every row's statistics and
sends them through all trees, which are flattened into arrays of features, thresholds and leaves.

Null texts count as empty; empty and very long texts get statistics like any other. Of several labels of an id the
rounded mean counts, of several texts of a labelled id the least; null labels count as absent. Without labels of both kinds every score is the share of label 1
(0.5 without any label). Repeated rows are scored alike; an empty table gives an empty result; other columns of the
inputs are not read. Rows with a null id are scored and never learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm import _bytes
from weftline.llm._spark import map_texts, materialize, small_batches

#: Labelled rows of each class that the trees are fitted on.
SAMPLE_PER_CLASS = 10_000
#: Bytes of text whose statistics are worked out together.
GROUP_BYTES = 1 << 20
TREES, DEPTH, RATE, BINS, L2 = 60, 4, 0.2, 64, 1.0
FEATURES = [
    "log_bytes", "log_words", "mean_word", "max_word", "sd_word", "upper", "digit", "punct", "symbol", "space", "high", "line_len", "lines_per_word",
    "distinct_words", "top_word", "adjacent_repeats", "end_punct", "distinct_pairs", "stop", "bang",
]

_KIND = np.zeros(256, np.int64)
_KIND[[*range(65, 91)]] = 1
_KIND[[*range(97, 123)]] = 2
_KIND[[*range(48, 58)]] = 3
_KIND[[ord(c) for c in ".,;:!?'\"()-"]] = 4
_KIND[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = 5
_KIND[[32, *range(9, 14)]] = 6
_KIND[128:] = 7


def text_statistics(texts: list[bytes | None]) -> np.ndarray:
    """One row of ``FEATURES`` for each text."""
    n = len(texts)
    raw = [t or b"" for t in texts]
    size = np.array([len(t) for t in raw], np.float64)
    flat = np.frombuffer(b"".join(raw), np.uint8)
    doc = np.repeat(np.arange(n), size.astype(np.int64))
    kinds = np.bincount(doc * 8 + _KIND[flat], minlength=8 * n).reshape(n, 8).astype(np.float64)
    lines = np.bincount(doc[flat == 10], minlength=n) + 1.0
    bangs = np.bincount(doc[flat == 33], minlength=n)

    h, which, length, offsets = _bytes.joined_words(texts)
    count = np.diff(offsets).astype(np.float64)
    some = np.maximum(count, 1)
    total = np.bincount(which, length, n)
    mean = total / some
    variance = np.maximum(np.bincount(which, length.astype(np.float64) ** 2, n) / some - mean**2, 0)
    longest = np.zeros(n)
    np.maximum.at(longest, which, length)
    short = np.bincount(which, length <= 3, n)

    def distinct(x: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((x, w))
        x, w = x[order], w[order]
        first = np.ones(len(x), bool)
        first[1:] = (x[1:] != x[:-1]) | (w[1:] != w[:-1])
        at = np.flatnonzero(first)
        most = np.zeros(n)
        if len(at):
            np.maximum.at(most, w[at], np.diff(np.append(at, len(x))))
        return np.bincount(w[at], minlength=n).astype(np.float64), most

    unique, most = distinct(h, which)
    inner = which[1:] == which[:-1] if len(which) else np.empty(0, bool)
    with np.errstate(over="ignore"):
        pair = (h[:-1] * np.uint64(3) + h[1:])[inner] if len(h) else h
    pair_of = which[1:][inner] if len(which) else which
    pair_n = np.bincount(pair_of, minlength=n)
    pair_unique, _ = distinct(pair, pair_of)
    same = np.bincount(which[1:][inner & (h[1:] == h[:-1])], minlength=n) if len(h) else np.zeros(n)
    some_size = np.maximum(size, 1)
    letters = np.maximum(kinds[:, 1] + kinds[:, 2], 1)
    columns = [
        np.log1p(size), np.log1p(count), mean, longest, np.sqrt(variance), kinds[:, 1] / letters, kinds[:, 3] / some_size, kinds[:, 4] / some_size,
        kinds[:, 5] / some_size, kinds[:, 6] / some_size, kinds[:, 7] / some_size, count / lines, lines / some, unique / some, most / some,
        same / some, kinds[:, 4] / some, pair_unique / np.maximum(pair_n, 1), short / some, bangs / some,
    ]
    return np.stack(columns, axis=1)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", *FEATURES]
    for batch in _bytes.pieces(batches, 1, size=GROUP_BYTES):
        table = text_statistics(batch.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(table[:, k]) for k in range(len(FEATURES))]], names=names)


def document_features(documents: DataFrame) -> DataFrame:
    """doc_id and the statistics of every row's text."""
    return map_texts(documents, _features, "doc_id long, " + ", ".join(f"{x} double" for x in FEATURES))


@dataclass
class Trees:
    """All trees as arrays: an inner node k has children 2k+1 and 2k+2; leaves are numbered from the left."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def probability(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boost ``TREES`` trees of ``DEPTH`` levels for log loss, split by histograms of ``BINS`` quantile bins."""
    none = Trees(0.0, np.zeros((0, 2**DEPTH - 1), np.int64), np.zeros((0, 2**DEPTH - 1)), np.zeros((0, 2**DEPTH)))
    if not len(y):
        return none
    share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
    none.base = float(np.log(share / (1 - share)))
    if y.min() == y.max():
        return none
    width = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    cells = binned + BINS * np.arange(width)
    margin = np.full(len(y), none.base)
    inner = 2**DEPTH - 1
    features, thresholds, leaves = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for depth in range(DEPTH):
            first, many = 2**depth - 1, 2**depth
            key = ((node - first)[:, None] * (BINS * width) + cells).ravel()
            hist = [np.bincount(key, np.repeat(v, width), many * BINS * width).reshape(many, width, BINS) for v in (g, h)]
            gl, hl = (v.cumsum(axis=2) for v in hist)
            gt, ht = gl[:, :1, -1:], hl[:, :1, -1:]
            gain = gl**2 / (hl + L2) + (gt - gl) ** 2 / (ht - hl + L2) - gt**2 / (ht + L2)
            gain[(hl < 1) | (ht - hl < 1)] = -1
            best = gain.reshape(many, -1).argmax(axis=1)
            for k in range(many):
                j, b = divmod(int(best[k]), BINS)
                if gain[k, j, b] > 1e-9 and b < len(cuts[j]):
                    feature[first + k], threshold[first + k] = j, cuts[j][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        at = node - inner
        leaf = -RATE * np.bincount(at, g, 2**DEPTH) / (np.bincount(at, h, 2**DEPTH) + L2)
        margin += leaf[at]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Trees(none.base, np.array(features), np.array(thresholds), np.array(leaves))


def id_remainder(column: str, divisor: int) -> Column:
    """crc32 of an id as text, modulo ``divisor``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor


def rated(labels: DataFrame, label: str, usable: Column) -> DataFrame:
    """doc_id and label (int) of every usable id with a label."""
    some = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & usable)
    return some.groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("label"))


def training_sample(labels: DataFrame, label: str, usable: Column, per_class: int) -> DataFrame:
    """At most ``per_class`` labelled ids of each class, those of least hash: columns doc_id and label."""
    some, order = rated(labels, label, usable), [F.xxhash64("doc_id"), F.col("doc_id")]
    return some.where("label = 1").orderBy(*order).limit(per_class).unionAll(some.where("label = 0").orderBy(*order).limit(per_class))


def train(documents: DataFrame, labels: DataFrame, usable: Column) -> Trees:
    """Fit on the sample; its statistics (2 x SAMPLE_PER_CLASS rows at most) reach the driver."""
    sample = F.broadcast(training_sample(labels, "quality", usable, SAMPLE_PER_CLASS))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    chosen = texts.join(sample, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    chosen = materialize(chosen, "quality-sample")
    rows = document_features(chosen).join(F.broadcast(chosen.select("doc_id", "label")), "doc_id").toPandas().sort_values("doc_id")
    return fit(rows[FEATURES].to_numpy(np.float64), rows["label"].to_numpy(np.float64))


def classify(documents: DataFrame, trees: Trees) -> DataFrame:
    """doc_id and score of every row."""
    model = documents.sparkSession.sparkContext.broadcast(trees)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _bytes.pieces(batches, 1, size=GROUP_BYTES):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.value.probability(text_statistics(batch.column(1).to_pylist())))], names=["doc_id", "score"])

    return map_texts(documents, score, "doc_id long, score double")


def classify_texts(documents: DataFrame, trees: Trees, name: str = "__score") -> DataFrame:
    """The input's own columns and the score, in a column of a name that they don't have."""
    small_batches(documents.sparkSession)
    model = documents.sparkSession.sparkContext.broadcast(trees)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        values = texts.tolist()
        parts = [model.value.probability(text_statistics(values[a:b])) for a, b in _bytes.groups(values, GROUP_BYTES)]
        return pd.Series(np.concatenate([np.empty(0), *parts]))

    return documents.withColumn(name, score(F.col("text").cast("binary")))
