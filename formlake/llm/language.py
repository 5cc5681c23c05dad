"""Log-likelihood of whole documents under a gated recurrent language model.

Tokens are blank-separated words, A-Z lower-cased, and one end per document. Counts of
all tokens of all training documents are exact: blocks of documents keep their own word
lists, only a block's distinct words meet in the shuffle, and their counts go back to
the block. Documents travel as ids of their block's list, never as one row per token.

The model is a gated recurrent unit in numpy. Its output is factored into classes: the
HEAD most frequent words in groups, in each of which the state chooses the word; words of
like counts, in each of which the corpus counts choose; and all unknown words as one. In
training a word counts without its own occurrence, so the unknown class learns how often
new words come. Scoring runs all documents of a block side by side and carries each
document's state from window to window to its end.

Every training document is learned from, in a few rounds: a task runs truncated
backpropagation over its blocks from the broadcast weights and returns its weights, which
have a fixed size; their mean by tokens starts the next round. So weights, and scores by about
a hundredth, depend on how blocks are dealt over tasks. A block's documents are one
stream, dealt to lanes of equal length, so a long document makes no lane longer.

Held-out documents, crc32(doc_id as text) mod 7 = 2, are not learned from; a null doc_id
is crc32 of empty text, a training document. Null and empty texts are the end alone. Rows
that repeat a doc_id are separate documents. Without training tokens the score is the
base score. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from copy import copy

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import SparkContext, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formlake.session import cut

HELD_OUT, HELD_OUT_REST = 7, 2
BLOCK_BYTES = 16 << 20
ROWS_AT_ONCE = 1 << 14
HEAD, GROUP, STATE = 1600, 40, 16
LANES, WINDOWS, STEPS, RATE = 512, 64, 24, 0.01
ROUND_OF = np.array([0, 1, 1, 1, 2, 2, 2, 2])  # the round that learns from a document, by its place in the block
ROUNDS, SLOWER = 3, 0.6
PARTS = 16  # of the weights, summed apart
BINS = 48
END = b""


def tokens_of(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


# ---- model --------------------------------------------------------------------------


class Vocabulary:
    """Symbols and classes: head words by rank, count bins of the other words, the unknown."""

    def __init__(self, head: list[tuple[bytes, int]], bins: np.ndarray):
        self.head = {w: i for i, (w, _) in enumerate(head)}
        self.head_counts = np.array([c for _, c in head], np.float64)
        self.bins = bins.astype(np.float64)  # tokens of the other words by bin of their count
        self.n_head, self.groups = len(head), -(-len(head) // GROUP)
        self.unknown, self.start = self.n_head + BINS, self.n_head + BINS + 1
        self.n_symbols, self.n_classes = self.n_head + BINS + 2, self.groups + BINS + 1

    def symbols(self, head: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Symbols of words from their place in the head (-1: none) and their counts."""
        bin_of = np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64)
        return np.where(head >= 0, head, np.where(counts > 0, self.n_head + np.minimum(bin_of, BINS - 1), self.unknown)).astype(np.int32)

    def classes(self, symbols: np.ndarray) -> np.ndarray:
        return np.where(symbols < self.n_head, symbols // GROUP, symbols - self.n_head + self.groups)

    def within(self, symbols: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Natural log of the share of a word that isn't in the head in its bin; 0 for the others."""
        out = np.zeros(len(symbols))
        binned = (symbols >= self.n_head) & (symbols < self.unknown)
        out[binned] = np.log(counts[binned] / np.maximum(self.bins[symbols[binned] - self.n_head], counts[binned]))
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _with_one(rows: np.ndarray) -> np.ndarray:
    return np.concatenate([rows, np.ones((len(rows), 1), rows.dtype)], axis=1)


def _exp(rows: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray | float]:
    """Exponentials of rows @ weights, and what was taken from the logits before. Rows end in 1; states are within 1,
    so one bound on all logits serves as long as no row's largest can lie far below it."""
    bias, spread = weights[-1], np.abs(weights[:-1]).sum(axis=0)
    top, most = (bias + spread).max(), bias.argmax()
    weights = weights.copy()
    weights[-1] -= top
    logits = rows @ weights
    if top - bias[most] + spread[most] > 60:
        own = logits.max(axis=1)
        logits -= own[:, None]
        top = top + own
    return np.exp(logits, out=logits), top


def _runs(k: np.ndarray, groups: int) -> list[tuple[int, int, int]]:
    """(group, start, end) of the groups that occur in the sorted classes."""
    cuts = np.searchsorted(k, np.arange(groups + 1)).tolist()
    return [(c, a, z) for c, (a, z) in enumerate(zip(cuts, cuts[1:])) if z > a]


class Gru:
    """Gated recurrent unit with a class-factored softmax; weights in `p`."""

    NAMES = ("x", "u", "b", "wc", "bc", "wo", "bo")

    def __init__(self, words: Vocabulary, seed: int = 5):
        rng, h = np.random.default_rng(seed), STATE
        self.words = words
        prior = np.zeros(words.n_classes)
        for g in range(words.groups):
            prior[g] = words.head_counts[g * GROUP : (g + 1) * GROUP].sum()
        prior[words.groups : -1] = words.bins
        prior[-1] = words.bins[0]  # about as many words are new as were seen once
        seen = prior > 0
        self.masked = np.where(seen | (np.arange(len(prior)) == len(prior) - 1), 0.0, -1e9).astype(np.float32)
        self.p = {
            "x": rng.normal(0, 0.3, (words.n_symbols, 3 * h)), "u": rng.normal(0, 0.25, (h, 3 * h)), "b": np.zeros(3 * h),
            "wc": rng.normal(0, 0.1, (h, words.n_classes)), "bc": np.log(prior + 1),
            "wo": rng.normal(0, 0.1, (h, max(1, words.n_head))), "bo": np.log(np.concatenate([words.head_counts, [1.0]])[: max(1, words.n_head)] + 1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """(r, z, n, next state) from gate inputs of the symbols and the state."""
        u, s = self.p["u"], STATE
        gates = _sigmoid(x[:, : 2 * s] + h @ u[:, : 2 * s])
        r, z = gates[:, :s], gates[:, s:]
        n = np.tanh(x[:, 2 * s :] + (r * h) @ u[:, 2 * s :])
        return r, z, n, n + z * (h - n)

    def log_probability(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Natural log of class and, in the head, word; rows of states before each symbol."""
        parts = [self._log_probability(states[i : i + ROWS_AT_ONCE], symbols[i : i + ROWS_AT_ONCE]) for i in range(0, len(symbols), ROWS_AT_ONCE)]
        return np.concatenate(parts)

    def outputs(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights of classes and of head words, with their biases as the last row."""
        p = self.p
        return np.concatenate([p["wc"], (p["bc"] + self.masked)[None]]), np.concatenate([p["wo"], p["bo"][None]])

    def _log_probability(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        classes, head = self.outputs()
        order = np.argsort(symbols.astype(np.int16), kind="stable")
        symbols = symbols[order]
        rows, k = _with_one(states[order]), self.words.classes(symbols)
        e, top = _exp(rows, classes)
        part = np.einsum("ij,ij->i", rows, classes.T[k]) - top - np.log(e @ np.ones(e.shape[1], e.dtype))
        for c, a, z in _runs(k, self.words.groups):
            at = slice(c * GROUP, (c + 1) * GROUP)
            e, top = _exp(rows[a:z], head[:, at])
            part[a:z] += np.einsum("ij,ij->i", rows[a:z], head.T[symbols[a:z]]) - top - np.log(e @ np.ones(e.shape[1], e.dtype))
        out = np.empty_like(part)
        out[order] = part
        return out

    def score(self, sequences: list[np.ndarray]) -> np.ndarray:
        """Natural log-probability of each sequence of symbols, all read side by side to their ends."""
        lengths = np.array([len(s) for s in sequences], np.int64)
        order = np.argsort(-lengths, kind="stable")
        flat = np.concatenate([sequences[i] for i in order]) if len(order) else np.zeros(0, np.int32)
        lengths = lengths[order]
        first = np.cumsum(lengths) - lengths
        total = np.zeros(len(order))
        x_of = self.p["x"] + self.p["b"]
        h, last = np.zeros((len(order), STATE), np.float32), np.full(len(order), self.words.start, np.int32)
        for at in range(0, int(lengths.max(initial=0)), STEPS):
            states, symbols, lane = [], [], []
            for t in range(at, at + STEPS):
                lanes = int(np.searchsorted(-lengths, -t, side="left"))
                if not lanes:
                    break
                h, last = h[:lanes], last[:lanes]
                h = self.step(x_of[last], h)[3]
                last = flat[first[:lanes] + t]
                states.append(h)
                symbols.append(last)
                lane.append(np.arange(lanes))
            lane = np.concatenate(lane)
            total += np.bincount(lane, self.log_probability(np.concatenate(states), np.concatenate(symbols)), minlength=len(total))
        out = np.zeros(len(order))
        out[order] = total
        return out

    def gradients(self, symbols: np.ndarray, inputs: np.ndarray, live: np.ndarray, h: np.ndarray) -> tuple[float, dict, np.ndarray]:
        """Loss, gradients and last state of one window (steps x lanes); backpropagation ends at its start and at a document's."""
        p, s, (steps, lanes) = self.p, STATE, symbols.shape
        same = (inputs != self.words.start).astype(h.dtype)[:, :, None]
        x = p["x"][inputs] + p["b"]
        before, after, r, z, n = (np.empty((steps, lanes, s), h.dtype) for _ in range(5))
        for t in range(steps):
            before[t] = h * same[t]
            r[t], z[t], n[t], h = self.step(x[t], before[t])
            after[t] = h
        classes, head = self.outputs()
        g_classes, g_head = np.zeros_like(classes), np.zeros_like(head)
        target = symbols[live]
        scale = h.dtype.type(1 / max(1, len(target)))
        order = np.argsort(target.astype(np.int16), kind="stable")  # by class, too
        target = target[order]
        k, rows = self.words.classes(target), _with_one(after[live][order])
        loss = 0.0

        def all_of(rows: np.ndarray, weights: np.ndarray, gradient: np.ndarray) -> np.ndarray:
            """What the normalising sums add to the loss and gradients; returned: to those of the rows."""
            nonlocal loss
            e, top = _exp(rows, weights)
            total = e @ np.ones(e.shape[1], e.dtype)
            loss += float((np.log(total) + top).sum(dtype=np.float64))
            share = (scale / total)[:, None]
            gradient += (rows * share).T @ e
            return (e @ weights[:-1].T) * share

        back = all_of(rows, classes, g_classes)
        for c, a, e in _runs(k, self.words.groups):
            at = slice(c * GROUP, (c + 1) * GROUP)
            back[a:e] += all_of(rows[a:e], head[:, at], g_head[:, at])
        if len(target):  # and the targets themselves
            first = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]]))
            sums, own = np.add.reduceat(rows, first, axis=0), target[first]
            inside = own < self.words.n_head
            np.subtract.at(g_classes.T, self.words.classes(own), sums * scale)
            g_head[:, own[inside]] -= (sums[inside] * scale).T
            loss -= float((sums * classes.T[self.words.classes(own)]).sum(dtype=np.float64) + (sums[inside] * head.T[own[inside]]).sum(dtype=np.float64))
            pull = classes[:-1].T[self.words.classes(own)]
            pull[inside] += head[:-1].T[own[inside]]
            back -= np.repeat(pull * scale, np.diff(np.append(first, len(target))), axis=0)
        g = {"wc": g_classes[:-1], "bc": g_classes[-1], "wo": g_head[:-1], "bo": g_head[-1]}
        dh_out = np.zeros_like(after)
        unsorted = np.empty_like(back)
        unsorted[order] = back
        dh_out[live] = unsorted
        to_z, to_n = (before - n) * z * (1 - z), (1 - z) * (1 - n * n)
        to_r = before * r * (1 - r)
        whole = np.empty((steps, lanes, 3 * s), h.dtype)
        u_gates, u_new = p["u"][:, : 2 * s].T, p["u"][:, 2 * s :].T
        dh = np.zeros_like(h)
        for t in range(steps - 1, -1, -1):
            dh = dh + dh_out[t]
            own = whole[t]
            dn = own[:, 2 * s :] = dh * to_n[t]
            drh = dn @ u_new
            own[:, :s] = drh * to_r[t]
            own[:, s : 2 * s] = dh * to_z[t]
            dh = (dh * z[t] + drh * r[t] + own[:, : 2 * s] @ u_gates) * same[t]
        whole, before = whole.reshape(-1, 3 * s), before.reshape(-1, s)
        g["u"] = np.concatenate([before.T @ whole[:, : 2 * s], (r.reshape(-1, s) * before).T @ whole[:, 2 * s :]], axis=1)
        g["b"] = whole.sum(axis=0)
        read = inputs.ravel().astype(np.int16)
        order = np.argsort(read, kind="stable")
        read = read[order]
        first = np.flatnonzero(np.concatenate([[True], read[1:] != read[:-1]]))
        g["x"] = np.zeros_like(p["x"])
        g["x"][read[first]] = np.add.reduceat(whole[order], first, axis=0)
        return loss, g, h

    def fit(self, streams: Iterable[tuple[np.ndarray, np.ndarray]], rate: float = RATE) -> int:
        """Adam over windows of STEPS words of each stream (symbols, lengths of its documents); the number of symbols."""
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        step = learned = 0
        for symbols, lengths in streams:
            total = len(symbols)
            lanes = max(1, min(LANES, max(8, total // (STEPS * WINDOWS)), total // STEPS))
            long = -(-total // lanes)
            inputs = np.full(total, self.words.start, np.int32)
            inputs[1:] = symbols[:-1]
            inputs[(np.cumsum(lengths) - lengths)[lengths > 0]] = self.words.start
            dealt = lambda v: np.pad(v, (0, lanes * long - total)).reshape(lanes, long).T  # noqa: B023, E731
            symbols, inputs, live = dealt(symbols.astype(np.int32)), dealt(inputs), dealt(np.ones(total, bool))
            learned += total
            h = np.zeros((lanes, STATE), np.float32)
            for at in range(0, long, STEPS):
                w = slice(at, at + STEPS)
                _, g, h = self.gradients(symbols[w], inputs[w], live[w], h)
                step += 1
                now = rate / (1 + step / 200) ** 0.5
                for k in self.p:
                    first[k] = 0.9 * first[k] + 0.1 * g[k]
                    second[k] = 0.99 * second[k] + 0.01 * g[k] * g[k]
                    self.p[k] = self.p[k] - (now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        return learned

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in self.NAMES])

    def with_flat(self, values: np.ndarray) -> Gru:
        """The same model with other weights."""
        other, at = copy(self), 0
        other.p = {}
        for k in self.NAMES:
            size = self.p[k].size
            other.p[k] = values[at : at + size].reshape(self.p[k].shape).astype(np.float32)
            at += size
        return other


# ---- blocks of documents --------------------------------------------------------------


def pack_block(doc_ids: list, held: list[bool], ids: list[np.ndarray], words: list[bytes]) -> bytes:
    lengths = np.array([len(i) for i in ids], np.int64)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    parts = [np.array([d or 0 for d in doc_ids], np.int64), known, np.array(held, np.uint8), lengths, np.concatenate(ids).astype(np.int32)]
    press = zstandard.ZstdCompressor(level=1)
    packed = [press.compress(x.tobytes()) for x in parts] + [press.compress(b" ".join(words))]
    return np.array([len(x) for x in packed], np.int64).tobytes() + b"".join(packed)


def open_block(image: bytes) -> tuple[list, np.ndarray, list[np.ndarray], list[bytes]]:
    sizes, at, opened, parts = np.frombuffer(image, np.int64, 6), 48, zstandard.ZstdDecompressor(), []
    for n in sizes.tolist():
        parts.append(opened.decompress(image[at : at + n]))
        at += n
    docs = [d if k else None for d, k in zip(np.frombuffer(parts[0], np.int64).tolist(), np.frombuffer(parts[1], np.uint8).tolist())]
    lengths = np.frombuffer(parts[3], np.int64)
    return docs, np.frombuffer(parts[2], np.uint8).astype(bool), np.split(np.frombuffer(parts[4], np.int32), np.cumsum(lengths)[:-1]), parts[5].split(b" ")


BLOCK = pa.schema([("block", pa.int64()), ("payload", pa.binary()), ("local", pa.int32()), ("word", pa.binary()), ("n_train", pa.int64())])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block of documents with its payload, and one per distinct word of it."""
    part, number = TaskContext.get().partitionId(), 0

    def block() -> Iterator[pa.RecordBatch]:
        key = (part << 24) + number
        flat = np.concatenate(ids)
        train = np.repeat(~np.array(held, bool), [len(i) for i in ids])
        order = np.argsort(-np.bincount(flat, minlength=len(places)), kind="stable")  # frequent words get small ids, which pack well
        new = np.empty(len(order), np.int32)
        new[order] = np.arange(len(order))
        listed = list(places)
        words = [listed[i] for i in order.tolist()]
        n_train = np.bincount(new[flat[train]], minlength=len(words)).astype(np.int64)
        image = pack_block(doc_ids, held, [new[i] for i in ids], words)
        empty = lambda n, t: pa.nulls(n, t)
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([image], pa.binary()), *(empty(1, t) for t in BLOCK.types[2:])], schema=BLOCK)
        for a in range(0, len(words), 1 << 16):
            some = words[a : a + (1 << 16)]
            n = len(some)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, key)), empty(n, pa.binary()), pa.array(np.arange(a, a + n, dtype=np.int32)), pa.array(some, pa.binary()), pa.array(n_train[a : a + n])],
                schema=BLOCK,
            )

    places: dict[bytes, int] = {}
    doc_ids, held, ids, size = [], [], [], 0
    for batch in batches:
        for doc_id, out, text in zip(batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), batch.column("text")):
            raw = text.as_py() or b""
            put = places.setdefault
            ids.append(np.array([put(w, len(places)) for w in tokens_of(raw)], np.int32))
            doc_ids.append(doc_id)
            held.append(out)
            size += len(raw)
            if size >= BLOCK_BYTES:
                yield from block()
                number, size, places = number + 1, 0, {}
                doc_ids, held, ids = [], [], []
    if ids:
        yield from block()


def held_out(doc_id: str) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % HELD_OUT == HELD_OUT_REST


def blocks_of(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id").alias("held_out"), F.col("text").cast("binary").alias("text"))
    return cut(rows.mapInArrow(_blocks, "block long, payload binary, local int, word binary, n_train long"))


def counted_words(blocks: DataFrame) -> DataFrame:
    """(block, local, word, n, first): every block's words with their count in all training documents."""
    words = blocks.filter("payload IS NULL").select("block", "local", "word", "n_train")
    same = Window.partitionBy("word")
    first = F.row_number().over(same.orderBy("block", "local")) == 1
    counted = words.select("block", "local", "word", F.sum("n_train").over(same).alias("n"), first.alias("first"))
    return cut(counted.select("block", "local", F.when(F.col("first"), F.col("word")).alias("word"), "n", "first"))


def vocabulary(counted: DataFrame) -> Vocabulary | None:
    """Head and bins from the counts of all training tokens."""
    types = counted.filter("first AND n > 0").select("word", "n")
    head = [(bytes(r["word"]), r["n"]) for r in types.orderBy(F.col("n").desc(), "word").limit(HEAD).collect()]
    if not head:
        return None
    bin_of = F.least(F.floor(F.log2("n")), F.lit(BINS - 1)).cast("int")
    totals = {r["bin"]: r["n"] for r in types.groupBy(bin_of.alias("bin")).agg(F.sum("n").alias("n")).collect()}  # at most BINS rows
    bins = np.array([totals.get(b, 0) for b in range(BINS)], np.int64)
    for _, n in head:
        bins[min(int(np.floor(np.log2(n))), BINS - 1)] -= n
    return Vocabulary(head, bins)


# ---- coded blocks: symbols of a block's documents and what scoring needs of their counts


def pack_arrays(arrays: list[np.ndarray]) -> bytes:
    press = zstandard.ZstdCompressor(level=1)
    packed = [press.compress(np.ascontiguousarray(x).tobytes()) for x in arrays]
    return np.array([len(x) for x in packed], np.int64).tobytes() + b"".join(packed)


def open_arrays(image: bytes, types: tuple) -> list[np.ndarray]:
    opened, at, out = zstandard.ZstdDecompressor(), 8 * len(types), []
    for n, kind in zip(np.frombuffer(image, np.int64, len(types)).tolist(), types):
        out.append(np.frombuffer(opened.decompress(image[at : at + n]), kind))
        at += n
    return out


SYMBOLS = (np.int64, np.uint8, np.int16, np.uint8)  # lengths, held out, symbols as learned, packed bits: scored by the next symbol
DOCUMENTS = (np.int64, np.uint8, np.int64, np.float64, np.float64)  # doc_id, not null, n_known, base score, log of shares in bins


def coded_blocks(blocks: DataFrame, counted: DataFrame, words: Vocabulary | None, n_train: int, n_types: int) -> DataFrame:
    """(documents, symbols): one row per block; training rounds and scoring read it without a shuffle."""
    shared = SparkContext.getOrCreate().broadcast(words)

    def code(block: pa.Table, own: pa.Table) -> pa.Table:
        doc_ids, held, ids, listed = open_block(block.column("payload")[0].as_py())
        vocabulary = shared.value
        counts = np.zeros(len(listed), np.int64)
        counts[own.column("local").to_numpy()] = own.column("n").to_numpy()
        flat, lengths = np.concatenate(ids), np.array([len(i) for i in ids], np.int64)
        owner = np.repeat(np.arange(len(ids)), lengths)
        sums = lambda v: np.bincount(owner, v[flat], minlength=len(ids))
        scored = learned = np.zeros(len(listed), np.int32)
        shares = np.zeros(len(ids))
        if vocabulary is not None:
            places = np.array([vocabulary.head.get(w, -1) for w in listed])
            scored, learned = vocabulary.symbols(places, counts), vocabulary.symbols(places, counts - 1)  # without its own occurrence
            shares = sums(vocabulary.within(scored, counts))
        symbols = np.where(np.repeat(held, lengths), scored[flat], learned[flat]).astype(np.int16)
        other = np.packbits(symbols != scored[flat])
        known = np.array([d is not None for d in doc_ids], np.uint8)
        documents = [
            np.array([d or 0 for d in doc_ids], np.int64), known, sums((counts > 0).astype(float)).astype(np.int64),
            sums(np.log10((counts + 1) / (n_train + n_types + 1))), shares,
        ]
        return pa.table({
            "documents": pa.array([pack_arrays(documents)], pa.binary()), "symbols": pa.array([pack_arrays([lengths, held.astype(np.uint8), symbols, other])], pa.binary()),
        })

    payloads = blocks.filter("payload IS NOT NULL").select("block", "payload")
    counts = counted.select("block", "local", "n")
    return cut(payloads.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(code, "documents binary, symbols binary"))


def scored_symbols(symbols: np.ndarray, other: np.ndarray, words: Vocabulary) -> np.ndarray:
    """Symbols with a word's own occurrence: the unknown is a word seen once, and a bin may be the next."""
    moved = np.unpackbits(other, count=len(symbols)).astype(bool)
    return np.where(moved, np.where(symbols == words.unknown, words.n_head, symbols + 1), symbols).astype(np.int32)


def learned_stream(image: bytes, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and lengths of a block's training documents of a round."""
    lengths, held, symbols, _ = open_arrays(image, SYMBOLS)
    chosen = (held == 0) & (ROUND_OF[np.arange(len(lengths)) % len(ROUND_OF)] == number)
    return symbols[np.repeat(chosen, lengths)], lengths[chosen]


def trained(coded: DataFrame, words: Vocabulary) -> tuple[Gru, int]:
    """The model, and the number of tokens it has learned from."""
    model, learned = Gru(words), 0
    bounds = np.linspace(0, len(model.flat()), PARTS + 1).astype(int).tolist()
    schema = "part int, tokens long, weights binary"

    def rows(parts: dict[int, tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for part, (n, sums) in parts.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.array([sums.tobytes()], pa.binary())], names=["part", "tokens", "weights"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for part, n, image in zip(*(batch.column(c).to_pylist() for c in ("part", "tokens", "weights"))):
                before, sums = parts.get(part, (0, 0.0))
                parts[part] = before + n, sums + np.frombuffer(image, np.float64)
        yield from rows(parts)

    def learn(shared, number: int, rate: float):
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value.with_flat(shared.value.flat())
            streams = (learned_stream(image.as_py(), number) for batch in batches for image in batch.column("symbols"))
            n = own.fit((s for s in streams if len(s[0])), rate)
            if n:
                weights = own.flat().astype(np.float64) * n
                yield from rows({i: (n, weights[a:z]) for i, (a, z) in enumerate(zip(bounds, bounds[1:]))})

        return task

    for number in range(ROUNDS):
        shared = SparkContext.getOrCreate().broadcast(model)
        weights = coded.select("symbols").mapInArrow(learn(shared, number, RATE * SLOWER**number), schema)
        parts = {r["part"]: r for r in cut(weights.repartition("part").mapInArrow(summed, schema)).collect()}  # PARTS rows
        if parts:
            model = model.with_flat(np.concatenate([np.frombuffer(parts[i]["weights"], np.float64) / parts[i]["tokens"] for i in range(PARTS)]))
            learned += parts[0]["tokens"]
    return model, learned


ROW = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)


def scored_documents(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    blocks = blocks_of(docs)
    counted = counted_words(blocks)
    words = vocabulary(counted)
    totals = counted.filter("first").agg(F.sum("n"), F.count_if(F.col("n") > 0)).first()
    n_train, n_types = totals[0] or 0, totals[1] or 0
    coded = coded_blocks(blocks, counted, words, n_train, n_types)
    model, learned = trained(coded, words) if words is not None else (None, 0)
    assert learned == n_train, f"learned from {learned} of {n_train} training tokens"
    shared = SparkContext.getOrCreate().broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gru = shared.value
        for batch in batches:
            for documents, image in zip(batch.column("documents"), batch.column("symbols")):
                doc_ids, known, n_known, bases, shares = open_arrays(documents.as_py(), DOCUMENTS)
                lengths, held, symbols, other = open_arrays(image.as_py(), SYMBOLS)
                scores = bases
                if gru is not None:
                    flat = scored_symbols(symbols, other, gru.words)
                    scores = (gru.score(np.split(flat, np.cumsum(lengths)[:-1])) + shares) / np.log(10)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(doc_ids, pa.int64(), mask=known == 0), "held_out": pa.array(held.astype(bool)), "n_tokens": pa.array(lengths),
                    "n_known": pa.array(n_known), "train_tokens": pa.array(np.full(len(lengths), n_train, np.int64)),
                    "base_score": pa.array(bases), "score": pa.array(scores),
                })

    return coded.mapInArrow(score, ROW)
