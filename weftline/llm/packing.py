"""Packing tokenised documents into sequences by hierarchical best fit.

Texts become token ids, closed by ``END_ID``, and only those longer than ``CAPACITY`` are cut, into pieces of that
length and a rest. Pieces are dealt to partitions of about ``PARTITION_ITEMS``, each of which packs its own by best
fit, longest first. Bins with at most ``SLACK`` free tokens, and those no other underfull bin could join, are emitted;
the other underfull bins are items of the next level, where ``FAN_IN`` partitions meet, until one partition is left or
a level merges nothing. A partition never holds more than about PARTITION_ITEMS items, on any level.

A null text counts as empty, and an empty one is a document of the closing id alone. Texts of any length are taken
whole. Repeated rows are packed as often as they occur, a null id is kept, an empty table gives an empty result, other
columns are not read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm import _bytes
from weftline.llm._spark import map_texts, materialize

CAPACITY = 4096
END_ID = 1
SLACK = 16
PARTITION_ITEMS = 50_000
FAN_IN = 8
#: Words whose ids a worker remembers; it starts anew beyond that.
CACHE_WORDS = 400_000
#: Bytes of text tokenised together.
GROUP_BYTES = 1 << 20
#: Bytes that may be split off a word's end without changing its ids: ASCII marks that are in no contraction or special token.
_TAIL = np.zeros(256, bool)
_TAIL[[ord(c) for c in '!"#$%&()*+,-./:;=?@[\\]^_`{}~']] = True


class WordTokenizer:
    """A word-level tokenizer (white space always parts tokens) that encodes each distinct word once."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self._encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        self._clear()

    def _clear(self) -> None:
        self.keys, self.starts, self.sizes, self.flat = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        if len(self.keys) + len(keys) > CACHE_WORDS and len(self.keys):
            self._clear()
        ids = [e.ids for e in self._encode(texts, add_special_tokens=False)]
        sizes = np.array([len(x) for x in ids], np.int64)
        starts = len(self.flat) + np.cumsum(sizes) - sizes
        at = np.searchsorted(self.keys, keys)
        self.keys, self.starts, self.sizes = np.insert(self.keys, at, keys), np.insert(self.starts, at, starts), np.insert(self.sizes, at, sizes)
        self.flat = np.concatenate([self.flat, np.array([i for x in ids for i in x], np.uint32)])

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        return at, known

    def ids(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """Ids of each text, as the tokenizer gives them for the whole text."""
        # Texts with special tokens keep their case, so they are encoded whole.
        special = {i for i, t in enumerate(texts) if b"<|" in t}
        plain = [b"" if i in special else t for i, t in enumerate(texts)]
        data = b"\n".join(plain).lower()
        h, starts, ends = _bytes.words(data, _bytes.SPACE, _TAIL)
        begin = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in plain], out=begin[1:])
        offsets = np.searchsorted(starts, begin)
        keys, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        at, known = self._places(keys)
        if not known.all():
            new = np.flatnonzero(~known)
            if len(self.keys) + len(new) > CACHE_WORDS:
                self._clear()
                new = np.arange(len(keys))
            self._learn(keys[new], [data[starts[i] : ends[i]].decode("utf-8", "replace") for i in first[new]])
            at, _ = self._places(keys)
        word = at[inverse] if len(keys) else np.empty(0, np.int64)
        sizes = self.sizes[word]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        flat = self.flat[np.repeat(self.starts[word] - upto[:-1], sizes) + np.arange(upto[-1])]
        edges = upto[offsets]
        for i, text in enumerate(texts):
            if i in special:
                yield np.array(self.tokenizer.encode(text.decode("utf-8"), add_special_tokens=False).ids, np.uint32)
            else:
                yield flat[edges[i] : edges[i + 1]]


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """This worker's tokenizer."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_pieces(documents: DataFrame, path: str | None = None, capacity: int = CAPACITY, position: Column | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and the document's position (0, if none is given) of every document's pieces."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path or default_path())
        for batch in _bytes.pieces(batches, 1, size=GROUP_BYTES):
            names, texts, places = batch.column(0).to_pylist(), [t or b"" for t in batch.column(1).to_pylist()], batch.column(2).to_pylist()
            rows: tuple[list, ...] = ([], [], [], [], [], [])
            for name, ids, place in zip(names, own.ids(texts), places, strict=True):
                ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                for k, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    for column, value in zip(rows, (name, k, start, len(part), zlib.crc32(part.tobytes()), place), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "position"])

    place = F.lit(0).cast("long") if position is None else position.cast("long")
    return map_texts(documents, cut, "doc_id long, piece int, start long, length long, ids_crc32 long, position long", place)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit, longest first: each item's bin and offset, and each bin's fill. Bins by free tokens are stacks; the set of occupied ones is one integer."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    occupied, fill = 0, []
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        rest = occupied >> size
        if rest:
            free = size + (rest & -rest).bit_length() - 1
            at = stacks[free].pop()
            if not stacks[free]:
                occupied ^= 1 << free
        else:
            free, at = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = at, fill[at]
        fill[at] += size
        left = free - size
        if left:
            if not stacks[left]:
                occupied |= 1 << left
            stacks[left].append(at)
    return bins, offsets, np.array(fill, np.int64)


def _level(items: DataFrame, level: int, capacity: int, columns: str) -> DataFrame:
    """Pack each partition ``part`` of items with a ``length``: adds bin, offset and the bin's fill."""

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        bins, offsets, fill = best_fit(frame["length"].to_numpy(np.int64), capacity)
        name = (level << 56) + (int(frame["part"].iloc[0]) << 28)
        return frame.assign(bin=name + bins, offset=offsets, fill=fill[bins])

    return items.groupBy("part").applyInPandas(pack, f"{columns}, part int, bin long, offset long, fill long")


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, in_order: bool = False) -> DataFrame:
    """The pieces (a written table) with sequence_id and offset.

    ``in_order``: partitions are runs of positions, and neighbours are merged, so that the sequences of a run (their ids
    rise with the runs) hold documents of one stretch of the given order. Otherwise pieces are dealt by hash.
    """
    columns = "doc_id long, piece int, start long, length long, ids_crc32 long"
    n, last = pieces.agg(F.count(F.lit(1)), F.max("position") if in_order else F.lit(0)).first()
    parts = max(1, -(-n // PARTITION_ITEMS))
    part = F.floor(F.col("position") * parts / ((last or 0) + 1)) if in_order else F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts))
    dealt = pieces.withColumn("part", part.cast("int")).drop("position")
    placed = materialize(_level(dealt, 0, capacity, columns), "pack-0")
    under = placed.where(F.col("fill") < capacity - SLACK).groupBy("bin", "part").agg(F.first("fill").alias("length"))
    moves = None
    before = None
    for level in range(1, 100):
        least, many = under.agg(F.min("length"), F.count(F.lit(1))).first()
        # A bin that the least filled one does not fit into is as full as it gets.
        open_bins = under.where(F.col("length") + F.lit(least or 0) <= capacity)
        if not many or parts == 1 or many == before:
            break
        before, wide = many, parts
        parts = max(1, parts // FAN_IN, -(-many // PARTITION_ITEMS))
        near = F.floor(F.col("part") * parts / wide) if in_order else F.pmod(F.col("part"), F.lit(parts))
        items = open_bins.select(F.col("bin").alias("item"), "length", near.cast("int").alias("part"))
        merged = materialize(_level(items, level, capacity, "item long, length long"), f"pack-{level}")
        step = merged.select(F.col("item"), F.col("bin").alias("to"), F.col("offset").alias("shift"))
        if moves is None:
            moves = step
        else:
            further = step.select(F.col("item").alias("to"), F.col("to").alias("next"), F.col("shift").alias("more"))
            moves = moves.join(further, "to", "left").select("item", F.coalesce("next", "to").alias("to"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"))
            moves = materialize(moves, f"pack-moves-{level}")
        under = merged.where(F.col("fill") < capacity - SLACK).groupBy("bin", "part").agg(F.first("fill").alias("length"))
    if moves is None:
        return placed.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")
    return placed.join(moves.withColumnRenamed("item", "bin"), "bin", "left").select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("to", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset")
    )


def pack_documents(documents: DataFrame, path: str | None = None, capacity: int = CAPACITY, position: Column | None = None) -> DataFrame:
    """Every document's pieces with their sequence and place in it. ``position``: the documents' order, gapless from 0, that sequences are to follow."""
    return pack_pieces(materialize(token_pieces(documents, path, capacity, position), "pack-pieces"), capacity, position is not None)
