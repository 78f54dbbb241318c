"""Words of many texts as 64-bit hashes, computed on whole byte arrays with numpy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes hashed at a time; a longer word is still taken whole.
SEGMENT = 1 << 18
_BASE = 0x9E3779B97F4A7C55
_powers: tuple[np.ndarray, np.ndarray] = (np.empty(0, np.uint64), np.empty(0, np.uint64))

#: Bytes between words: space and 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
#: Every ASCII byte but letters and digits.
NON_WORD = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: ASCII letters.
LETTER = np.array([b < 128 and chr(b).isalpha() for b in range(256)])


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, SEGMENT + 1)
        tables = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            with np.errstate(over="ignore"):
                tables.append(np.multiply.accumulate(steps))
        _powers = (tables[0], tables[1])
    return _powers


def _segments(data: bytes, apart: np.ndarray) -> Iterator[tuple[int, int]]:
    at, n = 0, len(data)
    view = np.frombuffer(data, np.uint8)
    while at < n:
        end = min(n, at + SEGMENT)
        if end < n:
            back = np.flatnonzero(apart[view[at:end]])
            if len(back) and back[-1]:
                end = at + int(back[-1])
            else:
                while end < n:
                    ahead = np.flatnonzero(apart[view[end : end + SEGMENT]])
                    end = min(n, end + (int(ahead[0]) if len(ahead) else SEGMENT))
                    if len(ahead):
                        break
        yield at, end
        at = end


def words(data: bytes, apart: np.ndarray = SPACE, tail: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word of ``data``, in order. A word's last run of ``tail`` bytes, if it follows an ASCII letter, is a word of its own."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    view = np.frombuffer(data, np.uint8)
    for at, end in _segments(data, apart):
        part = view[at:end]
        inside = np.zeros(len(part) + 2, np.int8)
        inside[1:-1] = ~apart[part]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[0::2], edges[1::2]
        if not len(starts):
            continue
        if tail is not None:
            last = np.maximum.accumulate(np.where(tail[part], -1, np.arange(len(part))))[ends - 1]
            cut = np.flatnonzero((last >= starts) & (last < ends - 1) & LETTER[part[np.maximum(last, 0)]])
            starts, ends = np.insert(starts, cut + 1, last[cut] + 1), np.insert(ends, cut, last[cut] + 1)
        power, inverse = _power_table(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[: len(part)], out=sums[1:])
            h = (sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)
        found.append((mix(h), starts + at, ends + at))
    if not found:
        empty = np.empty(0, np.int64)
        return np.empty(0, np.uint64), empty, empty
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))  # type: ignore[return-value]


def groups(texts: Sequence[bytes | None], size: int = 2 << 20, many: int = 1 << 62) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes together, ``many`` texts at most."""
    at = total = 0
    for i, text in enumerate(texts):
        total += len(text or b"") + 1
        if total >= size or i + 1 - at >= many:
            yield at, i + 1
            at, total = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def pieces(batches: Iterable[pa.RecordBatch], *columns: int, size: int = 1 << 20, many: int = 1 << 62) -> Iterator[pa.RecordBatch]:
    """Parts of the batches, ``many`` rows at most, whose texts (the given columns) have about ``size`` bytes together, so that few become Python objects at a time."""
    for batch in batches:
        lengths = sum(pc.binary_length(batch.column(c)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
        whole = np.cumsum(lengths + 1) // size
        edges = np.concatenate([[0], np.flatnonzero(whole[1:] != whole[:-1]) + 1, [batch.num_rows]]) if batch.num_rows else np.zeros(1, np.int64)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            for at in range(a, b, many):
                yield batch.slice(at, min(many, b - at))


def word_terms(texts: Sequence[bytes | None], prefixes: Sequence[int], apart: np.ndarray = NON_WORD) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every word of several texts, A-Z lower-cased, and of its first bytes in the given lengths; and the text's number of each."""
    data = b"\n".join(t or b"" for t in texts).lower()
    begin = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t or b"") + 1 for t in texts], out=begin[1:])
    h, starts, ends = words(data, apart)
    which = np.searchsorted(begin, starts, side="right") - 1
    view = np.frombuffer(data, np.uint8)
    terms, owners = [h], [which]
    power = _power_table(max([*prefixes, 1]))[0]
    for k in prefixes:
        long = np.flatnonzero(ends - starts >= k)
        value = np.full(len(long), k, np.uint64)
        with np.errstate(over="ignore"):
            for j in range(k):
                value += (view[starts[long] + j].astype(np.uint64) + np.uint64(257)) * power[j]
        terms.append(mix(value))
        owners.append(which[long])
    return np.concatenate(terms), np.concatenate(owners)


def joined_words(texts: Sequence[bytes | None], apart: np.ndarray = SPACE, tail: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of several texts, A-Z lower-cased: hash, text's number, length in bytes, and the texts' word offsets (one more than texts)."""
    data = b"\n".join(t or b"" for t in texts).lower()
    h, starts, ends = words(data, apart, tail)
    begin = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t or b"") + 1 for t in texts], out=begin[1:])
    offsets = np.searchsorted(starts, begin)
    which = np.repeat(np.arange(len(texts)), np.diff(offsets))
    return h, which, ends - starts, offsets


class Places:
    """Places of 64-bit hashes in a table, looked up for many at once by open addressing."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        self.bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 4))))
        self.slots = np.full(1 << self.bits, -1, np.int32)
        left = np.arange(len(keys))
        at = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + 1) & ((1 << self.bits) - 1)

    def of(self, h: np.ndarray) -> np.ndarray:
        """Each hash's place in the keys, or -1."""
        out = np.full(len(h), -1, np.int32)
        left = np.arange(len(h))
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(left):
            found = self.slots[at]
            hit = np.zeros(len(left), bool)
            some = found >= 0
            hit[some] = self.keys[found[some]] == h[left[some]]
            out[left[hit]] = found[hit]
            on = some & ~hit
            left, at = left[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out
