"""Phrases whose words stand together more often than their parts would, counted by weighted acyclic automata.

A task turns its texts into n-grams of word numbers, sums equal ones as it goes, and from the sorted n-grams builds count
transducers: acyclic automata, level by level, whose states are prefixes and whose last transitions carry the counts. A
transducer is cut by ranges of a prefix's hash (the first two words; a single word's own). All transducers of a language
and a range meet in one task, which reads them one after another and unites them by summing weights, and keeps the n-grams
that occur ``MIN_COUNT`` times. Counts of parts come from composition: the parts of all candidates that fall into a range
form an acceptor that is walked together with the range's transducer, level by level.

Lengths are counted one after another. An n-gram can only be frequent if both its parts of n - 1 words are, so a length
starts from windows whose parts have their bits set in a bitmap of ``BITMAP_BITS`` bits, made from the hashes of the frequent
(n - 1)-grams and sent to every task (2 MB whatever the input). A bit too many only costs work: counts are exact on whole words.
A candidate lies inside a longer one that is as frequent only if it does so inside one a word longer, so that is what is compared.

Null texts are empty, null languages ``und``; repeated rows count again. An empty table gives an empty result. Words may be of
any length. Other columns are not read. Results are those of all rows: no n-gram is dropped but by its exact total.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm._bytes import mix, pieces
from weftline.llm._spark import materialize, small_batches

MIN_COUNT = 100
LONGEST = 5
TOP = 2000
BITMAP_BITS = 1 << 24
#: Words of input for each prefix range of a language.
RANGE_WORDS = 2_000_000
#: A task's sums are sent on when it holds so many distinct n-grams (60 MB of pairs), or words.
HELD, HELD_WORDS = 2_500_000, 1_000_000
#: Requests that meet a transducer in one task; a range with more gets copies of it, each for a share of them.
REQUESTS = 250_000
#: Up to so many languages, their word counts (a row each) go to every executor.
BROADCAST_LANGUAGES = 10_000
BUCKETS = 64

_SENT = "lang string, size int, part int, body binary, words long"
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz.........")


@dataclass
class Transducer:
    """An acyclic automaton of n-grams: ``labels[d]`` are the transitions from depth d, ``begin[d]`` where each state's begin; ``weights`` those of the last."""

    words: list[bytes]
    labels: list[np.ndarray]
    begin: list[np.ndarray]
    weights: np.ndarray

    @staticmethod
    def build(words: list[bytes], grams: np.ndarray, weights: np.ndarray) -> Transducer:
        """From n-grams of word numbers in sorted order, without repeats: a state for each prefix that differs from the one before."""
        labels, begin = [], []
        fresh = np.zeros(len(grams), bool)
        fresh[:1] = True
        parents = np.zeros(1, np.int64)
        for d in range(grams.shape[1]):
            fresh[1:] |= grams[1:, d] != grams[:-1, d]
            rows = np.flatnonzero(fresh)
            labels.append(grams[rows, d].astype(np.int32))
            begin.append(np.append(np.searchsorted(rows, parents), len(rows)).astype(np.int64))
            parents = rows
        return Transducer(words, labels, begin, weights)

    def grams(self) -> np.ndarray:
        """The n-grams in order, as numbers of ``words``."""
        columns = [self.labels[-1]]
        owner = np.arange(len(columns[0]))
        for d in range(len(self.labels) - 1, 0, -1):
            owner = np.searchsorted(self.begin[d], owner, side="right") - 1
            columns.append(self.labels[d - 1][owner])
        return np.stack(columns[::-1], axis=1)

    def compose(self, asked: list[list[bytes]]) -> np.ndarray:
        """The weights of several word sequences: their acceptor and this automaton are walked together. -1: not accepted."""
        number = {w: i for i, w in enumerate(self.words)}
        symbols = np.array([[number.get(w, -1) for w in words] for words in asked], np.int64).reshape(len(asked), len(self.labels))
        states, back = np.unique(symbols, axis=0, return_inverse=True)  # sorted: the acceptor's paths
        at = np.zeros(len(states), np.int64)
        alive = np.ones(len(states), bool)
        span = np.int64(len(self.words) + 1)
        for d, labels in enumerate(self.labels):
            keys = np.repeat(np.arange(len(self.begin[d]) - 1), np.diff(self.begin[d])) * span + labels
            want = at * span + states[:, d]
            place = np.minimum(np.searchsorted(keys, want), max(len(keys) - 1, 0))
            alive &= (states[:, d] >= 0) & (len(keys) > 0)
            alive &= keys[place] == want if len(keys) else False
            at = np.where(alive, place, 0)
        return np.where(alive, self.weights[at] if len(self.weights) else -1, -1)[back.ravel()]

    def pack(self) -> bytes:
        """Compressed, every array in the narrowest type that holds it: how many transitions a state has, and the steps between their labels."""
        narrow = lambda x: x.astype(np.min_scalar_type(int(x.max(initial=0))))
        steps = []
        for labels, begin in zip(self.labels, self.begin, strict=True):
            step = np.diff(labels.astype(np.int64), prepend=0)
            first = begin[:-1][np.diff(begin) > 0]
            step[first] = labels[first]
            steps.append(step)
        arrays = [narrow(x) for x in (*steps, *map(np.diff, self.begin), self.weights)]
        return zstandard.compress(pickle.dumps((b" ".join(self.words), len(self.labels), arrays), protocol=5), 1)

    @staticmethod
    def unpack(data: bytes) -> Transducer:
        words, depth, arrays = pickle.loads(zstandard.decompress(data))
        begin = [np.concatenate([[0], np.cumsum(x, dtype=np.int64)]) for x in arrays[depth:-1]]
        labels = []
        for steps, edges in zip(arrays[:depth], begin, strict=True):
            upto = np.concatenate([[0], np.cumsum(steps, dtype=np.int64)])
            labels.append(upto[1:] - np.repeat(upto[edges[:-1]], np.diff(edges)))
        return Transducer(words.split(b" "), labels, begin, arrays[-1].astype(np.int64))


class Numbers(dict):
    """Numbers of words in order of their first sight."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _keys(grams: np.ndarray) -> tuple[list[np.ndarray], int]:
    """N-grams as few integers that sort alike, and the bits of a word in them."""
    bits = max(int(grams.max()).bit_length(), 1)
    each, keys = max(1, 62 // bits), []
    for d in range(0, grams.shape[1], each):
        key = np.zeros(len(grams), np.int64)
        for column in grams[:, d : d + each].T:
            key = (key << bits) | column
        keys.append(key)
    return keys, bits


def summed(grams: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Equal n-grams as one, in order. Without weights each counts once."""
    if not len(grams):
        return grams, np.zeros(0, np.int64)
    keys, bits = _keys(grams)
    if weights is None and len(keys) == 1:
        found, counts = np.unique(keys[0], return_counts=True)
        columns = [found >> (bits * d) & ((1 << bits) - 1) for d in range(grams.shape[1] - 1, -1, -1)]
        return np.stack(columns, axis=1), counts.astype(np.int64)
    weights = np.ones(len(grams), np.int64) if weights is None else weights
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    new = np.zeros(len(grams), bool)
    new[:1] = True
    for key in keys:
        ordered = key[order]
        new[1:] |= ordered[1:] != ordered[:-1]
    first = np.flatnonzero(new)
    return grams[order[first]], np.add.reduceat(weights[order], first)


def word_hashes(words: list[bytes], seed: int) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w, seed) for w in words], np.uint64)


def chained(hashes: np.ndarray) -> np.ndarray:
    """The hash of each row of word hashes."""
    out = hashes[:, 0]
    with np.errstate(over="ignore"):
        for d in range(1, hashes.shape[1]):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[:, d])
    return out


def _range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """The prefix range of each n-gram (rows of word hashes)."""
    return ((chained(hashes[:, :2]) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _seed(lang: str) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode())


def tokens(texts: list[bytes]) -> list[bytes]:
    """The words of several texts, a dot for every break."""
    return b".".join(texts).translate(_LOWER).replace(b".", b" . ").split()


def marked(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bit = hashes >> np.uint64(64 - (BITMAP_BITS.bit_length() - 1))
    return (bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) > 0


class Shard:
    """A task's n-grams of one language and length, summed as texts come in."""

    def __init__(self, lang: str, size: int, bitmap: np.ndarray | None = None) -> None:
        self.lang, self.size, self.bitmap, self.seed = lang, size, bitmap, _seed(lang)
        self.clear()

    def clear(self) -> None:
        self.numbers = Numbers({b".": 0})
        self.hashes = np.zeros(1, np.uint64)
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.rows = self.words = 0

    def _known(self) -> np.ndarray:
        """The hashes of all words seen so far."""
        new = list(self.numbers)[len(self.hashes) :]
        if new:
            self.hashes = np.concatenate([self.hashes, word_hashes(new, self.seed)])
        return self.hashes

    def add_texts(self, texts: list[bytes]) -> None:
        """Single words."""
        said = tokens(texts)
        counts = np.bincount(np.fromiter(map(self.numbers.__getitem__, said), np.int64, len(said)), minlength=1)
        counts[0] = 0
        self.words += int(counts.sum())
        at = np.flatnonzero(counts)
        self._hold(at[:, None], counts[at])

    def add_sequence(self, words: list[bytes], ids: np.ndarray) -> None:
        """N-grams of a sequence of numbers of ``words``, 0 for a break, whose parts are marked."""
        n = self.size
        if len(ids) < n:
            return
        ids = np.fromiter((self.numbers[w] for w in words), np.int64, len(words))[ids]
        breaks = np.concatenate([[0], np.cumsum(ids == 0)])
        h = self._known()[ids]
        fine = marked(self.bitmap, chained(np.stack([h[d : len(h) - n + 2 + d] for d in range(n - 1)], axis=1)))
        at = np.flatnonzero(fine[:-1] & fine[1:] & (breaks[n:] == breaks[: len(breaks) - n]))
        self._hold(*summed(np.stack([ids[at + d] for d in range(n)], axis=1)))

    def _hold(self, grams: np.ndarray, weights: np.ndarray) -> None:
        self.held.append((grams, weights))
        self.rows += len(grams)
        if self.rows > HELD:
            self.held = [summed(np.concatenate([g for g, _ in self.held]), np.concatenate([w for _, w in self.held]))]
            self.rows = len(self.held[0][0])

    def full(self) -> bool:
        return len(self.numbers) > HELD_WORDS or len(self.held) == 1 and self.rows > HELD * 3 // 4

    def sent(self, ranges: int) -> Iterator[tuple]:
        """The transducers of the prefix ranges, from the sorted n-grams."""
        if self.held:
            grams, weights = np.concatenate([g for g, _ in self.held]), np.concatenate([w for _, w in self.held])
            yield from cut(self.lang, list(self.numbers), self._known(), grams, weights, ranges, self.words)
        self.clear()


def cut(lang: str, words: list[bytes], hashes: np.ndarray, grams: np.ndarray, weights: np.ndarray, ranges: int, total: int) -> Iterator[tuple]:
    """(lang, size, range, transducer, words): one for each prefix range that holds n-grams. The first also carries the words counted."""
    part = _range_of(hashes[grams[:, :2]], ranges)
    order = np.argsort(part, kind="stable")
    edges = np.append(np.flatnonzero(np.diff(part[order], prepend=-1)), len(order))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        rows = order[a:b]
        used, place = np.unique(grams[rows], return_inverse=True)
        order_of = sorted(range(len(used)), key=lambda j: words[used[j]])
        rank = np.empty(len(used), np.int64)
        rank[order_of] = np.arange(len(used))
        built = Transducer.build([words[used[j]] for j in order_of], *summed(rank[place].reshape(-1, grams.shape[1]), weights[rows]))
        yield lang, grams.shape[1], int(part[rows[0]]), built.pack(), total if a == 0 else 0


def _record(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """The texts of some rows at a time, by language."""
    for batch in pieces(batches, 1, size=2 << 20):
        langs, texts = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_pylist()
        for lang in sorted(set(langs.tolist())):
            yield lang, [texts[i] for i in np.flatnonzero(langs == lang)]


def sequences(texts: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """The texts once more, as numbers of those words whose bits are set: what the longer lengths are counted on. Other words are breaks."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, some in _by_language(batches):
            said, numbers = tokens(some), Numbers({b".": 0})
            ids = np.fromiter(map(numbers.__getitem__, said), np.int64, len(said))
            fine = marked(bitmap, word_hashes(list(numbers), _seed(lang)))
            fine[0] = False
            to = np.cumsum(fine) * fine
            ids = to[ids]
            ids = ids[(ids > 0) | np.concatenate([[True], ids[:-1] > 0])]  # one break for several
            words = [b".", *(w for w, f in zip(numbers, fine.tolist(), strict=True) if f)]
            body = zstandard.compress(ids.astype(np.min_scalar_type(len(words))).tobytes(), 1)
            yield _record([(lang, b" ".join(words), body, len(words))], ["lang", "words", "body", "n"], [pa.string(), pa.binary(), pa.binary(), pa.int64()])

    return texts.mapInArrow(number, "lang string, words binary, body binary, n long")


def _shards(given: DataFrame, size: int, ranges: int, bitmap: np.ndarray | None) -> DataFrame:
    """Rows of transducers, cut by prefix range: of single words from the texts, of more from their sequences."""
    names, kinds = ["lang", "size", "part", "body", "words"], [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.int64()]

    def grown(held: dict[str, Shard], batches: Iterator[pa.RecordBatch]) -> Iterator[None]:
        if size == 1:
            for lang, some in _by_language(batches):
                yield held.setdefault(lang, Shard(lang, 1)).add_texts(some)
            return
        for row in (r for batch in batches for r in batch.to_pylist()):
            ids = np.frombuffer(zstandard.decompress(row["body"]), np.min_scalar_type(row["n"]))
            yield held.setdefault(row["lang"], Shard(row["lang"], size, bitmap)).add_sequence(row["words"].split(b" "), ids)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Shard] = {}
        for _ in grown(held, batches):
            if sum(s.rows for s in held.values()) > HELD * 3 // 2 or any(s.full() for s in held.values()):
                for shard in held.values():
                    yield _record(list(shard.sent(ranges)), names, kinds)
        for shard in held.values():
            yield _record(list(shard.sent(ranges)), names, kinds)

    return given.mapInArrow(count, _SENT)


def united(bodies: Iterator[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Words, n-grams and weights of several transducers together."""
    numbers, held, rows = Numbers(), [], 0
    for body in bodies:
        one = Transducer.unpack(body)
        to = np.fromiter((numbers[w] for w in one.words), np.int64, len(one.words))
        held.append((to[one.grams()], one.weights))
        rows += len(one.weights)
        if rows > 2 * len(held[0][0]) + HELD:
            held = [summed(np.concatenate([g for g, _ in held]), np.concatenate([w for _, w in held]))]
            rows = len(held[0][0])
    grams, weights = summed(np.concatenate([g for g, _ in held]), np.concatenate([w for _, w in held]))
    return list(numbers), grams, weights


_FOUND = "lang string, size int, part int, body binary, phrase string, a long, cut int, side string, piece string, bit long, words long"


def _unions(sent: DataFrame, size: int, ranges: int, least: int) -> DataFrame:
    """For each language and prefix range: its transducer (a row with ``body``), what its candidates ask (``piece``), the bitmap's bits (``bit``) and the words counted (``words``)."""
    names = [c.split()[0] for c in _FOUND.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    none = (None,) * (len(names) - 3)

    def finish(lang: str, part: int, bodies: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
        words, grams, weights = united(bodies)
        grams, weights = grams[weights >= least], weights[weights >= least]
        if not len(grams):
            return
        hashes = word_hashes(words, _seed(lang))
        bits = np.unique(chained(hashes[grams]) >> np.uint64(64 - (BITMAP_BITS.bit_length() - 1))).tolist() if size < LONGEST else []
        rows: list[tuple] = [(lang, size, *none[:-1], b, None) for b in bits]
        rows += [(lang, size, part, body, *none[2:], None) for _, _, part, body, _ in cut(lang, words, hashes, grams, weights, ranges, 0)]
        texts = [[words[i].decode() for i in g] for g in grams.tolist()] if size > 1 else []
        for k in range(1, size):
            for side, piece, at in (("l", slice(0, k), k), ("r", slice(k, size), size - k)):
                where = _range_of(hashes[grams[:, piece]], ranges).tolist()
                rows += [(lang, at, p, None, " ".join(t), w, k, side, " ".join(t[piece]), None, None) for t, w, p in zip(texts, weights.tolist(), where, strict=True)]
        for a in range(0, len(rows), 50_000):
            yield _record(rows[a : a + 50_000], names, kinds)

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((r["lang"], r["part"], r["body"], r["words"]) for batch in batches for r in batch.to_pylist())
        row = next(rows, None)
        while row is not None:
            key, ahead, words = row[:2], [row], [0]

            def bodies(key: tuple = key, ahead: list = ahead, words: list = words) -> Iterator[bytes]:
                while ahead[0] is not None and ahead[0][:2] == key:
                    words[0] += ahead[0][3]
                    yield ahead[0][2]
                    ahead[0] = next(rows, None)

            yield from finish(*key, bodies())
            if words[0]:
                yield _record([(key[0], size, *none, words[0])], names, kinds)
            row = ahead[0]

    dealt = sent.select("lang", "part", "body", "words").repartition("lang", "part").sortWithinPartitions("lang", "part")
    return dealt.mapInArrow(unite, _FOUND)


def _bitmap(found: DataFrame) -> np.ndarray:
    """The bits of all frequent n-grams of one length: at most BITMAP_BITS / 64 rows reach the driver."""
    bits = found.where(F.col("bit").isNotNull()).select((F.col("bit") / 64).cast("int").alias("at"), F.expr("shiftleft(1L, cast(bit % 64 as int))").alias("bits"))
    out = np.zeros(BITMAP_BITS // 64, np.int64)
    for row in bits.groupBy("at").agg(F.bit_or("bits").alias("bits")).toLocalIterator():
        out[row["at"]] = row["bits"]
    return out.view(np.uint64)


def _answered(asked: DataFrame, automata: DataFrame) -> DataFrame:
    """lang, phrase, a, cut, side and the count of the asked piece."""
    kinds = "lang string, phrase string, a long, cut int, side string, count long"

    def answer(requests: pa.Table, bodies: pa.Table) -> pa.Table:
        weights = np.empty(0, np.int64)
        if requests.num_rows:
            asked_pieces = [p.encode().split(b" ") for p in requests.column("piece").to_pylist()]
            weights = Transducer.unpack(bodies.column("body")[0].as_py()).compose(asked_pieces)
        if (weights < 0).any():
            raise LookupError("a part of a frequent phrase has no count")
        return requests.select(["lang", "phrase", "a", "cut", "side"]).append_column("count", pa.array(weights, pa.int64()))

    # A range that many candidates ask gets several copies of its transducer, and its requests are dealt over them.
    keys = ["lang", "size", "part"]
    copies = asked.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / REQUESTS).cast("int").alias("copies"))
    copies = materialize(copies, "collocation-copies")
    most = copies.agg(F.max("copies")).first()[0] or 1
    hot = copies.where("copies > 1")
    share = F.when(F.col("copies").isNull(), 0).otherwise(F.pmod(F.xxhash64("phrase", "cut"), F.coalesce("copies", F.lit(1)))).cast("int")
    if most > 1:
        asked, automata = asked.join(hot, keys, "left").withColumn("copy", share), automata.join(hot, keys, "left").withColumn("copy", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)))
    else:
        asked, automata = asked.withColumn("copy", F.lit(0)), automata.withColumn("copy", F.lit(0))
    # Both come from one table: its columns are named anew, so that Spark can tell the sides apart.
    sides = [x.select(*[F.col(c).alias(c) for c in (*keys, "copy", *more)]) for x, more in ((asked, ("phrase", "a", "cut", "side", "piece")), (automata, ("body",)))]
    return sides[0].groupBy(*keys, "copy").cogroup(sides[1].groupBy(*keys, "copy")).applyInArrow(answer, kinds)


def ranked(counts: DataFrame, sizes: DataFrame, top: int) -> DataFrame:
    """The result from the counts of parts (lang, phrase, a, cut, side, count) and each language's words (lang, n)."""
    if sizes.limit(BROADCAST_LANGUAGES + 1).count() <= BROADCAST_LANGUAGES:
        sizes = F.broadcast(sizes)
    cuts = range(1, LONGEST)
    pick = lambda side, k: F.max(F.when((F.col("side") == side) & (F.col("cut") == k), F.col("count"))).alias(f"{side}{k}")
    phrases = counts.groupBy("lang", "phrase", "a").agg(*[pick(s, k) for s in "lr" for k in cuts])
    phrases = materialize(phrases, "collocation-phrases").join(sizes, "lang")
    score = lambda k: F.expr(f"cast(cast(1000 as decimal(38,0)) * cast(a as decimal(38,0)) * cast(n as decimal(38,0)) div (cast(l{k} as decimal(38,0)) * cast(r{k} as decimal(38,0))) as bigint)")
    best = F.least(*[F.when(F.col(f"l{k}").isNotNull(), F.struct(score(k).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in cuts], F.lit(None).cast("struct<score:bigint,k:int,l:bigint,r:bigint>"))
    phrases = phrases.withColumns({"best": best, "parts": F.split("phrase", " ")}).withColumn("words", F.size("parts"))
    # The phrases a word shorter that are as frequent: the longer one's first words (the last cut's l), and its last (the first cut's r).
    last = F.coalesce(*[F.when(F.col("words") == k + 1, F.col(f"l{k}")) for k in cuts])
    inside = F.array_compact(F.array(F.when(F.col("a") >= last, F.array_join(F.slice("parts", F.lit(1), F.col("words") - 1), " ")), F.when(F.col("a") >= F.col("r1"), F.array_join(F.slice("parts", F.lit(2), F.col("words") - 1), " "))))
    covered = phrases.where("words > 2").select("lang", F.explode(inside).alias("phrase")).distinct()
    left = phrases.join(covered, ["lang", "phrase"], "left_anti").select("lang", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n", F.col("best.score").alias("score"))
    # Two steps, so that no task sees a whole language.
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    some = left.withColumn("bucket", F.pmod(F.xxhash64("phrase"), F.lit(BUCKETS)).cast("int")).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(*order))).where(F.col("rank") <= top)
    best_of = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best_of.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def collocations(documents: DataFrame, min_count: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first ``top`` phrases. documents: lang, text."""
    spark = documents.sparkSession
    small_batches(spark)
    texts = documents.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(4, -(-size // (6 * RANGE_WORDS)))
    bitmap, found, sizes = None, [], None
    for n in range(1, LONGEST + 1):
        found.append(materialize(_unions(_shards(texts, n, ranges, bitmap), n, ranges, min_count), f"collocation-{n}"))
        if n == 1:
            sizes = materialize(found[0].where("words is not null").groupBy("lang").agg(F.sum("words").alias("n")), "collocation-sizes")
        if n < LONGEST:
            bitmap = _bitmap(found[-1])
            if not bitmap.any():
                break
        if n == 1:
            texts = materialize(sequences(texts, bitmap), "collocation-sequences")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    automata = every.where(F.col("body").isNotNull() & (F.col("size") < LONGEST)).select("lang", "size", "part", "body")
    asked = every.where(F.col("piece").isNotNull()).select("lang", "size", "part", "phrase", "a", "cut", "side", "piece")
    return ranked(materialize(_answered(asked, automata), "collocation-parts"), sizes, top)
