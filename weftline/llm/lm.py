"""Language-model scores of whole documents: a gated recurrent network over words, beside a smoothed unigram score.

Tokens are lower-cased words and one end for each document. One pass counts every training token. The ``VOCABULARY``
commonest tokens are the network's own; any other word is its ``unknown`` token times the word's smoothed share among
these, so a document's score is the probability of its very text. The output is factored: a word's class (words by
frequency, ``CLASS`` in each), then the word within the class.

Training is data-parallel: in each of ``ROUNDS`` rounds every task starts from the same weights and trains, by truncated
backpropagation in numpy, on its part of the round's documents; their weights, averaged by tokens on the executors,
start the next round. Rounds share out the training documents by hash, so that each is used once and whole. Documents
run in lanes, and each lane carries its state over windows until its document ends; the same holds for scoring.

Token ids are written once, and read by every round and by the scoring. Counts of the ``COMMON`` commonest words go to every executor (a few MB); counts of rarer words are joined to the
documents that hold them.

Null and empty texts are documents of one end token. Without training documents the counts are 0 and the network is as
it was begun. Rows with a null id are scored and never learned from; repeated rows are scored alike; an empty table gives an
empty result; other columns are not read. Words are told apart by 64-bit hashes. The weights, and so the scores, depend on
how Spark cuts the rows into tasks: each task learns from its own rows, and results are averaged.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm import _bytes
from weftline.llm._spark import map_texts, materialize

VOCABULARY, CLASS, EMBED, HIDDEN = 4096, 64, 8, 16
COMMON = 262_144
ROUNDS = 3
#: Steps of a window in training and in scoring, and lanes at most and at least.
BPTT, WINDOW, LANES, MIN_LANES = 32, 64, 1024, 128
LEARNING_RATE = 0.08
#: Rows of a softmax worked on at a time.
PART = 512
#: Classes of up to so many rows are worked on together.
TOGETHER = 128
#: Bytes of text whose words are numbered together, and tokens that share lanes.
GROUP_BYTES, GROUP_TOKENS = 2 << 20, 3 << 20
#: Parts by hash of a range of counts that is too large to be taken whole.
SHARES = 1024
#: The unknown token is a class of its own, so that it needs no choice within the class; the end and the words follow in the next ones.
UNKNOWN, END, FIRST = 0, CLASS, CLASS + 1
#: Workers' results that are averaged together, so that no task gathers all of them.
AVERAGE = 64


Weights = dict[str, np.ndarray]


def begin(counts: np.ndarray, unknown: float, ends: float) -> Weights:
    """Small random weights, with output biases (the last rows of class and word) that give the unigram shares. counts: of the vocabulary's words, from id FIRST on."""
    rng = np.random.Generator(np.random.PCG64(7))
    share = np.zeros(VOCABULARY)
    share[END], share[UNKNOWN] = ends + 0.5, unknown + 0.5
    share[FIRST : FIRST + len(counts)] = counts + 0.5
    by_class = share.reshape(-1, CLASS)
    total = by_class.sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        bias_class = np.maximum(np.log(total / total.sum()), -30)
        bias_word = np.maximum(np.nan_to_num(np.log(by_class / total[:, None]), nan=-30, neginf=-30), -30)
    small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    return {
        "embed": small(VOCABULARY, EMBED), "input": small(EMBED, 3 * HIDDEN), "bias": np.zeros(3 * HIDDEN, np.float32), "gates": small(HIDDEN, 2 * HIDDEN),
        "new": small(HIDDEN, HIDDEN), "class": np.concatenate([np.zeros((HIDDEN, VOCABULARY // CLASS)), bias_class[None]]).astype(np.float32),
        "word": np.concatenate([np.zeros((VOCABULARY // CLASS, HIDDEN, CLASS)), bias_word[:, None]], axis=1).astype(np.float32),
    }


def lanes(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents of given token counts (1 at least) in lanes: each one's lane and first step, and the lanes' lengths, longest lane first."""
    many = int(np.clip(lengths.sum() // max(lengths.max(initial=1), 1), MIN_LANES, LANES))
    many = max(1, min(many, len(lengths)))
    order = np.argsort(-lengths, kind="stable")
    end = np.zeros(many, np.int64)
    lane, first = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for at in range(0, len(order), many):  # the longest of the next documents goes to the shortest lane
        docs = order[at : at + many]
        to = np.argsort(end, kind="stable")[: len(docs)]
        lane[docs], first[docs] = to, end[to]
        end[to] += lengths[docs]
    rank = np.empty(many, np.int64)
    by_length = np.argsort(-end, kind="stable")
    rank[by_length] = np.arange(many)
    return rank[lane], first, end[by_length]


def _softmax(weight: np.ndarray, states: np.ndarray, pick: np.ndarray, log_p: np.ndarray, grads: tuple[np.ndarray, np.ndarray] | None, scale: float, loud: bool) -> None:
    """Adds the natural log-probability of each row's pick to ``log_p``. grads: where the gradient by weight is added, and that by state put.

    Rows are worked on in parts that stay in a core's cache. ``loud`` logits are held below 60, where floats can hold their powers.
    """
    ones = np.ones(weight.shape[1], weight.dtype)
    buffer = np.empty((min(PART, len(pick)), weight.shape[1]), weight.dtype)
    back = np.ascontiguousarray(weight.T)
    for at in range(0, len(pick), PART):
        own, chosen = states[at : at + PART], pick[at : at + PART]
        rows = np.arange(len(chosen))
        power = np.matmul(own, weight, out=buffer[: len(chosen)])
        if loud:
            np.minimum(power, 60, out=power)
        log_p[at : at + PART] += power[rows, chosen]
        np.exp(power, out=power)
        total = power @ ones
        log_p[at : at + PART] -= np.log(total)
        if grads is not None:
            by_weight, by_state = grads
            np.divide(scale, total, out=total)
            power *= total[:, None]
            power[rows, chosen] -= scale
            by_weight += own.T @ power
            np.matmul(power, back, out=by_state[at : at + PART])


def _output(w: Weights, state: np.ndarray, ids: np.ndarray, grads: Weights | None) -> tuple[np.ndarray, np.ndarray | None]:
    """Log-probabilities of the ids after the states; with ``grads``, these are filled in, and the gradient of the mean loss by state is given."""
    cls, word = ids // CLASS, ids % CLASS
    scale = 1 / max(len(ids), 1)
    order = np.argsort(cls.astype(np.int16), kind="stable")
    cls, word = cls[order], word[order]
    states = np.ones((len(ids), HIDDEN + 1), state.dtype)
    states[:, :HIDDEN] = state[order]
    edges = np.searchsorted(cls, np.arange(VOCABULARY // CLASS + 1))
    # States lie within -1 and 1, so a logit is below the sum of its weights.
    loud = max(float(np.abs(w["class"]).sum(axis=0).max()), float(np.abs(w["word"]).sum(axis=1).max())) > 60
    log_p, d_state, d_word = np.zeros(len(ids), state.dtype), None, None
    if grads is not None:
        d_state, d_word = np.empty_like(states), np.empty_like(states)
        d_word[: edges[1]] = 0
    _softmax(w["class"], states, cls, log_p, None if grads is None else (grads["class"], d_state), scale, loud)
    many = np.diff(edges)
    many[0] = 0  # the unknown token is alone in its class
    for k in np.flatnonzero(many > TOGETHER).tolist():
        at = slice(int(edges[k]), int(edges[k + 1]))
        _softmax(w["word"][k], states[at], word[at], log_p[at], None if grads is None else (grads["word"][k], d_word[at]), scale, loud)
    low = 0
    for high in sorted({min(8, TOGETHER), min(32, TOGETHER), TOGETHER}):  # classes of about as many rows are filled up to the largest and worked on together
        classes = np.flatnonzero((many > low) & (many <= high))
        low = high
        if not len(classes):
            continue
        lines = np.arange(many[classes].max())
        real = lines < many[classes][:, None]
        at = np.minimum(edges[classes][:, None] + lines, len(ids) - 1)
        own, pick, weight = states[at], word[at][:, :, None], w["word"][classes]
        power = own @ weight
        if loud:
            np.minimum(power, 60, out=power)
        chosen = np.take_along_axis(power, pick, 2)[:, :, 0]
        np.exp(power, out=power)
        total = power @ np.ones(CLASS, power.dtype)
        log_p[at[real]] += (chosen - np.log(total))[real]
        if grads is not None:
            share = (scale * real).astype(power.dtype)
            power *= (share / total)[:, :, None]
            np.put_along_axis(power, pick, np.take_along_axis(power, pick, 2) - share[:, :, None], 2)
            grads["word"][classes] = own.transpose(0, 2, 1) @ power
            d_word[at[real]] = (power @ weight.transpose(0, 2, 1))[real]
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    if grads is not None:
        d_state += d_word
        d_state = d_state[back, :HIDDEN]
    return log_p[back], d_state


def window(w: Weights, given: np.ndarray, target: np.ndarray, fresh: np.ndarray, active: np.ndarray, h: np.ndarray, learn: bool) -> tuple[np.ndarray, np.ndarray, Weights | None]:
    """One window: steps x lanes of given and target ids, and where a document begins; ``active`` lanes (the first ones) of each step.

    Gives natural log-probabilities (steps x lanes), the state after it, and the gradients of the mean loss. Gates are
    worked out as 1 + tanh of half their sum, which is twice the gate; the halves are taken with the weights.
    """
    steps, many = given.shape
    kind = w["input"].dtype
    half_gates, half_new = w["gates"] * kind.type(0.5), w["new"] * kind.type(0.5)
    x = w["embed"] @ w["input"] + w["bias"]
    x[:, : 2 * HIDDEN] *= 0.5
    x = x[given]
    keep, begins = (~fresh).astype(kind)[:, :, None], fresh.any(axis=1)
    whole = int(active[-1]) == many
    new_array = np.empty if whole else np.zeros
    out, before, gated, c = (new_array((steps, many, HIDDEN), kind) for _ in range(4))
    twice = new_array((steps, many, 2 * HIDDEN), kind)
    for t in range(steps):
        n = active[t]
        old = before[t, :n]
        if begins[t]:
            np.multiply(h[:n], keep[t, :n], out=old)
        else:
            old[:] = h[:n]
        gate = np.matmul(old, half_gates, out=twice[t, :n])
        gate += x[t, :n, : 2 * HIDDEN]
        np.tanh(gate, out=gate)
        gate += 1
        np.multiply(gate[:, HIDDEN:], old, out=gated[t, :n])
        new = np.matmul(gated[t, :n], half_new, out=c[t, :n])
        new += x[t, :n, 2 * HIDDEN :]
        np.tanh(new, out=new)
        step = np.subtract(new, old, out=out[t, :n])
        step *= gate[:, :HIDDEN]
        step *= 0.5
        step += old
        h = step if n == len(h) else np.concatenate([step, h[n:]])
    real = None if whole else np.arange(many) < active[:, None]
    grads: Weights | None = {k: np.zeros_like(v) for k, v in w.items()} if learn else None
    flat_out = out.reshape(-1, HIDDEN)
    log_p, d_state = _output(w, flat_out, target.ravel(), grads) if whole else _output(w, out[real], target[real], grads)
    if whole:
        result = log_p.reshape(steps, many)
    else:
        result = np.zeros((steps, many), kind)
        result[real] = log_p
    if grads is None:
        return result, h, None
    twice *= 0.5
    gated *= 0.5
    z, r = twice[:, :, :HIDDEN], twice[:, :, HIDDEN:]
    # What does not depend on later steps is worked out for the whole window at once.
    by_c, by_z, by_r, stay, back = z * (1 - c * c), (c - before) * z * (1 - z), before * r * (1 - r), (1 - z) * keep, r * keep
    d_x = new_array((steps, many, 3 * HIDDEN), kind)
    if whole:
        d_out = np.ascontiguousarray(d_state).reshape(steps, many, HIDDEN)
    else:
        d_out = np.zeros((steps, many, HIDDEN), kind)
        d_out[real] = d_state
    carry = np.zeros((many, HIDDEN), kind)
    new_t, gates_t = np.ascontiguousarray(w["new"].T), np.ascontiguousarray(w["gates"].T)
    for t in range(steps - 1, -1, -1):
        n = active[t]
        d_h = d_out[t, :n]
        d_h += carry[:n]
        d_zr, d_c = d_x[t, :n, : 2 * HIDDEN], d_x[t, :n, 2 * HIDDEN :]
        np.multiply(d_h, by_c[t, :n], out=d_c)
        d_gated = d_c @ new_t
        np.multiply(d_h, by_z[t, :n], out=d_zr[:, :HIDDEN])
        np.multiply(d_gated, by_r[t, :n], out=d_zr[:, HIDDEN:])
        d_h *= stay[t, :n]
        d_gated *= back[t, :n]
        d_h += d_gated
        d_old = d_zr @ gates_t
        if begins[t]:
            d_old *= keep[t, :n]
        np.add(d_h, d_old, out=carry[:n])
    flat, inputs = d_x.reshape(-1, 3 * HIDDEN), given.ravel()  # zero where a lane is over
    grads["gates"] = before.reshape(-1, HIDDEN).T @ flat[:, : 2 * HIDDEN]
    grads["new"] = gated.reshape(-1, HIDDEN).T @ flat[:, 2 * HIDDEN :]
    grads["bias"] = flat.sum(axis=0)
    grads["input"] = w["embed"][inputs].T @ flat
    d_embed = flat @ w["input"].T
    for j in range(EMBED):
        grads["embed"][:, j] = np.bincount(inputs, d_embed[:, j], VOCABULARY)
    return result, h, grads


def run(w: Weights, ids: np.ndarray, offsets: np.ndarray, memory: Weights | None = None) -> np.ndarray:
    """Natural log-probability of each document; with ``memory`` (sums of squared gradients) the weights learn on the way."""
    lengths = np.diff(offsets)
    lane, first, ends = lanes(lengths)
    steps = int(ends[0]) if len(lengths) else 0
    total = np.zeros(len(lengths))
    size = WINDOW if memory is None else BPTT
    # Lanes are runs of documents: their tokens lie one lane after another, and each window takes its own from there.
    order = np.lexsort((first, lane))
    moved = np.repeat(offsets[:-1][order], lengths[order]) + (np.arange(len(ids)) - np.repeat(np.cumsum(lengths[order]) - lengths[order], lengths[order]))
    said, owner = ids[moved].astype(np.int32), np.repeat(order.astype(np.int32), lengths[order])
    del moved
    begin_at = np.cumsum(ends) - ends
    h = np.zeros((len(ends), HIDDEN), np.float32)
    for at in range(0, steps, size):
        to = min(at + size, steps)
        active = np.searchsorted(-ends, -np.arange(at, to), side="left")  # lanes that are longer than the step
        n = int(active[0])
        some = np.arange(at, to)[:, None] < ends[:n]
        place = np.where(some, begin_at[:n] + np.arange(at, to)[:, None], 0)
        target, doc, last = np.where(some, said[place], 0), owner[place], np.maximum(place - 1, 0)
        fresh = some & ((place == begin_at[:n]) | (owner[last] != doc))
        given = np.where(fresh, END, np.where(some, said[last], 0))
        log_p, after, grads = window(w, given, target, fresh, active, h[:n].copy(), memory is not None)
        h[:n] = after
        total += np.bincount(doc[some], log_p[some], len(lengths))
        if grads is not None:
            norm = np.sqrt(sum(float(np.vdot(g, g)) for g in grads.values()))
            for k, g in grads.items():
                g *= min(1.0, 1.0 / max(norm, 1e-12))
                step = g * g
                memory[k] += step
                np.sqrt(memory[k], out=step)
                step += 1e-6
                np.divide(g, step, out=step)
                step *= LEARNING_RATE
                w[k] -= step
    return total


def _token_ids(texts: list[bytes | None], vocabulary: _bytes.Places) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all tokens, ends included, the texts' offsets in them, and the words' hashes and texts."""
    h, which, _, offsets = _bytes.joined_words(texts)
    place = vocabulary.of(h)
    starts = offsets + np.arange(len(offsets))
    ids = np.full(len(h) + len(texts), END, np.int32)
    ids[np.arange(len(h)) + which] = np.where(place >= 0, place + FIRST, UNKNOWN)
    return ids, starts, h, which


def _grouped(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray, np.ndarray]]:
    """Batches of about ``GROUP_TOKENS`` tokens, with all their ids and the documents' offsets in them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(len(x.column(column).flatten()) for x in held) >= GROUP_TOKENS:
            yield held, *_joined(held, column)
            held = []
    if held:
        yield held, *_joined(held, column)


def _joined(held: list[pa.RecordBatch], column: int) -> tuple[np.ndarray, np.ndarray]:
    lists = pa.chunked_array([x.column(column) for x in held]).combine_chunks()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return lists.flatten().to_numpy().astype(np.int32), offsets - offsets[0]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _bytes.pieces(batches, 1, size=GROUP_BYTES):
        word, n = np.unique(_bytes.joined_words(batch.column(1).to_pylist())[0], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], names=["word", "n"])


def count_words(training: DataFrame) -> DataFrame:
    """word (hash) and n of every word of the training documents, as a written table."""
    return materialize(map_texts(training, _count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "lm-counts")


def commonest(counts: DataFrame, many: int | None = None) -> DataFrame:
    """The commonest words, ``COMMON`` at most, so that nothing is sorted as a whole: those of the highest ranges of counts that fit, and of the next
    range the shares by word hash that fit.

    There are eight ranges to a doubling of the count, a few hundred in all, and ``SHARES`` shares of the range that is broken.
    """
    many = many or COMMON
    ranged = counts.withColumn("range", F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int"))
    upto, least, broken = 0, None, None
    for row in sorted(ranged.groupBy("range").count().collect(), reverse=True):
        if upto + row["count"] > many:
            broken = row["range"]
            break
        upto += row["count"]
        least = row["range"]
    whole = F.col("range") >= least if least is not None else F.lit(False)
    if broken is None:
        return ranged.where(whole).select("word", "n")
    share = F.pmod(F.xxhash64("word"), F.lit(SHARES))
    shares = 0
    for row in sorted(ranged.where(F.col("range") == broken).groupBy(share.alias("share")).count().collect()):
        upto += row["count"]
        if upto > many:
            break
        shares = row["share"] + 1
    return ranged.where(whole | ((F.col("range") == broken) & (share < shares))).select("word", "n")


def _averaged(frame: pd.DataFrame) -> pd.DataFrame:
    total = max(frame["tokens"].sum(), 1)
    mean: Weights = {}
    for blob, tokens in zip(frame["weights"], frame["tokens"], strict=True):
        for k, v in pickle.loads(blob).items():
            mean[k] = mean.get(k, 0) + v.astype(np.float64) * (tokens / total)
    return pd.DataFrame({"worker": [int(frame["worker"].iloc[0])], "tokens": [int(frame["tokens"].sum())], "weights": [pickle.dumps({k: v.astype(np.float32) for k, v in mean.items()})]})


def train(tokens: DataFrame, weights: Weights) -> Weights:
    """The weights after all rounds over the documents' ids (a written table: row, doc_id, ids)."""
    context = tokens.sparkSession.sparkContext
    for k in range(ROUNDS):
        start = context.broadcast(weights)

        def learn(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            w = {k: v.copy() for k, v in start.value.items()}
            memory = {k: np.full_like(v, 1e-4) for k, v in w.items()}
            tokens = 0
            for _, ids, offsets in _grouped(batches, 0):
                run(w, ids, offsets, memory)
                tokens += len(ids)
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([tokens], pa.int64()), pa.array([pickle.dumps(w)], pa.binary())], names=["worker", "tokens", "weights"])

        schema = "worker int, tokens long, weights binary"
        mine = tokens.where(F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS)) == k).select("ids")
        results = materialize(mine.mapInArrow(learn, schema), f"lm-round-{k}")
        many = results.count()
        while many > 1:
            near = results.groupBy(F.floor(F.col("worker") / AVERAGE).alias("near")).applyInPandas(_averaged, schema)
            results = materialize(near.withColumn("worker", F.floor(F.col("worker") / AVERAGE).cast("int")), f"lm-mean-{k}")
            many = results.count()
        if many:
            weights = pickle.loads(results.select("weights").first()[0])
    return weights


def numbered(documents: DataFrame, common: np.ndarray, common_n: np.ndarray, own: int, ends: int) -> DataFrame:
    """A written table of every row's token ids, and of what its score has besides the network's.

    row, doc_id, ids, n_tokens, known (tokens among the common words and ends), logs (their log10 of count + 1), rare (that of common words beyond the
    network's ``own``), outside (tokens that the network has as unknown), and the words that are not common with their times.
    """
    model = documents.sparkSession.sparkContext.broadcast((common, common_n))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, common_n = model.value
        known, vocabulary = _bytes.Places(common), _bytes.Places(common[:own])
        log_n = np.log10(common_n + 1.0)
        row = TaskContext.get().partitionId() << 33
        for batch in _bytes.pieces(batches, 1, size=GROUP_BYTES):
            many = batch.num_rows
            ids, offsets, h, which = _token_ids(batch.column(1).to_pylist(), vocabulary)
            place = known.of(h)
            hit = place >= 0
            logs = np.bincount(which[hit], log_n[place[hit]], many)
            beyond = hit & (place >= own)
            rare = np.bincount(which[beyond], log_n[place[beyond]], many)
            outside = np.bincount(which[ids[np.arange(len(h)) + which] == UNKNOWN], minlength=many)
            rest = np.flatnonzero(~hit)
            rest = rest[np.lexsort((h[rest], which[rest]))]
            first = np.ones(len(rest), bool)
            first[1:] = (h[rest][1:] != h[rest][:-1]) | (which[rest][1:] != which[rest][:-1])
            at = np.flatnonzero(first)
            times = np.diff(np.append(at, len(rest))).astype(np.int32)
            edges = np.searchsorted(which[rest[at]], np.arange(many + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(e), pa.array(x)) for e, x in ((offsets.astype(np.int32), ids), (edges, h[rest[at]].view(np.int64)), (edges, times))]
            numbers = [np.diff(offsets).astype(np.int64), np.bincount(which[hit], minlength=many) + int(ends > 0), logs + np.log10(ends + 1), rare.astype(np.float64), outside]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + many)), batch.column(0), *[pa.array(x) for x in numbers], *lists], names=[x.split()[0] for x in schema.split(", ")])
            row += many

    schema = "row long, doc_id long, n_tokens long, known long, logs double, rare double, outside long, ids array<int>, words array<long>, times array<int>"
    return materialize(map_texts(documents, number, schema), "lm-tokens")


def score_documents(documents: DataFrame, learned_from: Column) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row; ``learned_from`` reads doc_id."""
    context = documents.sparkSession.sparkContext
    training = learned_from & F.col("doc_id").isNotNull()
    counts = count_words(documents.where(training))
    ends = documents.where(training).select("doc_id").count()
    n, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    n, distinct = n + ends, distinct + (ends > 0)
    top = commonest(counts).toPandas().sort_values(["n", "word"], ascending=[False, True])
    common, common_n = top["word"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    own = min(len(common), VOCABULARY - FIRST)
    unknown = n - ends - int(common_n[:own].sum())
    rare_base = float(np.log10(unknown + (distinct - (ends > 0) - own) + 1))
    base = float(np.log10(n + distinct + 1))
    tokens = numbered(documents, common, common_n, own, ends)
    weights = train(tokens.where(training), begin(common_n[:own].astype(float), float(unknown), float(ends)))
    model = context.broadcast(weights)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, ids, offsets in _grouped(batches, 1):
            network = run(model.value, ids, offsets) / np.log(10)
            yield pa.RecordBatch.from_arrays([pa.chunked_array([x.column(0) for x in held]).combine_chunks(), pa.array(network)], names=["row", "network"])

    network = tokens.select("row", "ids").mapInArrow(score, "row long, network double")
    tail = tokens.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    found = tail.join(counts, "word").groupBy("row").agg(F.sum("times").alias("seen"), F.sum(F.col("times") * F.log10(F.col("n").cast("double") + 1)).alias("more"))
    both = tokens.drop("words", "times", "ids").join(network, "row").join(found, "row", "left")
    more, seen = F.coalesce("more", F.lit(0.0)), F.coalesce("seen", F.lit(0)).cast("long")
    return both.select(
        "doc_id", "n_tokens", (F.col("known") + seen).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("logs") + more - F.col("n_tokens") * base).alias("base_score"), (F.col("network") + F.col("rare") - F.col("outside") * rare_base + more).alias("score"),
    )
