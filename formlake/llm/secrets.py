"""Secrets in text: three fixed rules, and a character network over further candidates.

The rules give the base spans, which always stay. A candidate is any other run of token
characters that is long enough and holds a digit. A convolutional network reads the
candidate with the characters before and after it, a long one by overlapping windows and
by its parts between / and =, of which the highest score counts. Findings of the rules are its labelled examples
(their keyword is part of the surroundings, sometimes hidden or replaced, so shape must count too),
other candidates its counterexamples. As the rules' findings of a corpus may all look alike, half of
the examples are given drawn keys (hex digits of either case, letters and digits, base64, groups, prefixes, of
many lengths), and a third of the counterexamples drawn numbers, dates, and words of the corpus joined
to names and paths with numbers; unlabelled candidates weigh less, as some are secrets, and those that soon look like keys are left out. A held-out fifth of the examples calibrates its
score and sets the threshold: the highest that still recalls RECALL of the findings and DRAWN_RECALL of the drawn keys of every
alphabet and form, short and long, read in the surroundings of other candidates, as no candidate stands behind a keyword. The
share of other candidates it lets through is kept with the network and logged, as a
warning above FALSE_SHARE.

The network is fitted on all distinct examples and counterexamples of all documents. They are dealt
over blocks of about BLOCK_EACH of a kind, by their hashes; the kind with fewer is dealt again until every
block has both. A task trains over its blocks from the broadcast weights, and each of ROUNDS rounds starts from the mean
of the blocks' weights; a single block is one round. Every held-out case counts once in the threshold, which is an
exact order statistic of all of them, and the calibration is the mean of the blocks' fits. Every whole text is searched. Null
and empty texts have no spans; rows that repeat a doc_id are separate documents. Without examples of both kinds there are no model
spans, which is logged as a warning. An empty table gives no rows.
"""

from __future__ import annotations

import copy
import logging
import re
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formlake.session import cut

BLOCK_EACH = 8000  # examples of a block, and as many counterexamples
HELD_OUT = 5
SENT_AT_ONCE = 16384
KEY_SHIFTS = (20, 10, 0)  # bits of a score's key not yet known after each count
RECALL, DRAWN_RECALL, FALSE_SHARE = 0.95, 0.9, 0.005
BEFORE, INSIDE, STRIDE = 24, 40, 20
WIDTH, EMBED, FILTERS = 5, 8, 24
AROUND = 2 * (BEFORE + WIDTH - 1)  # as many characters after a candidate as before it, apart from each other
STEPS, ROUNDS, BATCH, RATE = 600, 3, 64, 0.006
SCORED_AT_ONCE = 2048
LOG = logging.getLogger(__name__)
KINDS = ("assign", "access", "hex", "model")

#: Fixed: the rules.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_VALUE, ACCESS_LENGTH = 6, 20
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")

_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_HEX_SIGNS = bytes(ord("x") if chr(b) in "0123456789abcdef" else 32 for b in range(256))
_HEX_RUN = b"x" * 24
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
_PART = re.compile(r"[A-Za-z0-9+_-]{12,}")
_DIGIT = re.compile(r"[0-9]")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the rules' findings, leftmost and without overlap within a kind."""
    found, raw = [], text.encode("utf-8", "replace")
    low = raw.lower()
    if any(k in low for k in _KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_VALUE]
    if b"AKIA" in raw:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LENGTH]
    if _HEX_RUN in raw.translate(_HEX_SIGNS):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of the other token runs with a digit; none overlaps a base span."""
    out, k = [], 0
    if not _DIGIT.search(text):
        return out
    for m in _CANDIDATE.finditer(text):
        a, z = m.span()
        while k < len(base) and base[k][2] <= a:
            k += 1
        if _DIGIT.search(text, a, z) and not any(s < z and a < e for s, _, e in base[k : k + 4]):
            out.append((a, z))
    return out


def _classes() -> np.ndarray:
    """Character classes by code: letters, digits and common signs apart, all else together."""
    table = np.zeros(256, np.uint8)
    for i, c in enumerate(b"abcdefghijklmnopqrstuvwxyz"):
        table[c], table[c - 32] = 1 + i, 27 + i
    for i, c in enumerate(b"0123456789 \n=:\"'+/_-.@"):
        table[c] = 53 + i
    return table


CLASSES = _classes()
N_CLASSES = 53 + 22 + 1
GAP = N_CLASSES - 1  # stands for no character


def window(text: str, start: int, end: int) -> np.ndarray:
    """Classes of the characters after the window, of those before it, and of its own, INSIDE at most."""
    out = np.full(AROUND + INSIDE, GAP, np.uint8)
    end = min(end, start + INSIDE)
    after, before, own = (CLASSES[np.frombuffer(text[a:z].encode("latin-1", "replace"), np.uint8)] for a, z in ((end, end + BEFORE), (max(0, start - BEFORE), start), (start, end)))
    out[WIDTH - 1 : WIDTH - 1 + len(after)] = after
    out[AROUND - len(before) : AROUND] = before
    out[AROUND : AROUND + len(own)] = own
    return out


def windows(text: str, start: int, end: int) -> Iterator[np.ndarray]:
    """Windows that cover a candidate: STRIDE apart, and each of its parts between / and =."""
    for a in range(start, max(start + 1, end - INSIDE + STRIDE), STRIDE):
        yield window(text, a, end)
    for m in _PART.finditer(text, start, end):
        if m.span() != (start, end):
            for a in range(m.start(), max(m.start() + 1, m.end() - INSIDE + STRIDE), STRIDE):
                yield window(text, a, m.end())


def moved(codes: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """The same cases, the findings in the surroundings of counterexamples."""
    out, plain = codes.copy(), codes[labels == 0]
    own = np.flatnonzero(labels == 1)
    if len(plain):
        out[own, :AROUND] = plain[np.arange(len(own)) % len(plain), :AROUND]
    return out


# ---- drawn cases ----------------------------------------------------------------------

DRAWN = 4000  # of each kind
LEAST_KEY, LEAST_PLAIN = 16, 12
UNSURE = 0.2  # weight of an unlabelled candidate beside a drawn one


def _signs(text: str) -> np.ndarray:
    return CLASSES[np.frombuffer(text.encode(), np.uint8)]


_SMALL, _LARGE, _NUMBERS = _signs("abcdefghijklmnopqrstuvwxyz"), _signs("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _signs("0123456789")
_KEY_SIGNS = [np.concatenate(a) for a in ((_NUMBERS, _SMALL[:6]), (_NUMBERS, _LARGE[:6]), (_NUMBERS, _SMALL, _LARGE), (_NUMBERS, _SMALL, _LARGE, _signs("+/")), (_NUMBERS, _SMALL))]


def _insides(cases: list[np.ndarray]) -> np.ndarray:
    out = np.full((len(cases), INSIDE), GAP, np.uint8)
    for row, case in zip(out, cases):
        row[: min(len(case), INSIDE)] = case[:INSIDE]
    return out


def drawn_keys(rng: np.random.Generator, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Random keys as windows' own characters, and their kinds: plain runs, groups with -, and runs behind a prefix that ends in _."""

    def key() -> tuple[np.ndarray, int]:
        alphabet, size, chance = int(rng.integers(len(_KEY_SIGNS))), int(rng.integers(LEAST_KEY, INSIDE + 1)), rng.random()
        out, form = rng.choice(_KEY_SIGNS[alphabet], size), 0
        out[rng.integers(size // 2, size)] = rng.choice(_NUMBERS)
        if chance < 0.15:
            group, form = int(rng.integers(4, 9)), 1
            out[group :: group + 1] = _signs("-")[0]
        elif chance < 0.5:
            head, form = int(rng.integers(2, 9)), 2
            out[:head] = rng.choice(_SMALL, head)
            out[head] = _signs("_")[0]
            if head > 4:
                out[head // 2] = _signs("_")[0]
        return out, (alphabet * 3 + form) * 2 + (size < 24)

    cases = [key() for _ in range(n)]
    return _insides([c for c, _ in cases]), np.array([k for _, k in cases], np.int64)


def words_around(codes: np.ndarray) -> list[np.ndarray]:
    """Words of letters alone in the surroundings of windows."""
    out = []
    for row in codes[:, :AROUND]:
        is_letter = (row >= 1) & (row <= 52)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], is_letter, [False]]).astype(np.int8)))
        out += [row[a:z] for a, z in zip(edges[::2], edges[1::2]) if 2 <= z - a <= 12]
    return out


def drawn_plain(rng: np.random.Generator, n: int, words: list[np.ndarray]) -> np.ndarray:
    """Random text without secrets as windows' own characters: numbers, dates and times, and words joined to names and paths."""
    joints = _signs("_-/=")

    def number(size: int) -> np.ndarray:
        return rng.choice(_NUMBERS, size)

    def plain() -> np.ndarray:
        form, joint = rng.random(), joints[rng.integers(len(joints)) : ][:1]
        if form < 0.3 or not words:
            out = number(int(rng.integers(LEAST_PLAIN, INSIDE + 1)))
            if form < 0.15:
                out[int(rng.integers(2, 5)) :: int(rng.integers(3, 6))] = joint[0]
            return out
        if form < 0.45:
            sizes = [4, 2, 2, 2, 2, 2][: int(rng.integers(4, 7))]
            return np.concatenate([x for size in sizes for x in (number(size), joint)][:-1])
        parts: list[np.ndarray] = []
        while sum(map(len, parts)) < LEAST_PLAIN + int(rng.integers(0, 24)):
            parts += [words[rng.integers(len(words))], joint if rng.random() < 0.8 else joint[:0]]
        parts.insert(int(rng.integers(0, len(parts) + 1)), number(int(rng.integers(1, 5))))
        return np.concatenate(parts)

    return _insides([plain() for _ in range(n)])


def with_drawn(codes: np.ndarray, labels: np.ndarray, seed: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cases and as many drawn ones in their surroundings, DRAWN at least; and the kind of each drawn key, -1 for all others."""
    rng, own = np.random.default_rng(seed), labels == 1
    n = max(DRAWN, int(own.sum()))
    again = [np.resize(c, (n, codes.shape[1])) for c in (codes[own], codes[~own])]
    again[0][:, AROUND:], kinds = drawn_keys(rng, n)
    again[1][:, AROUND:] = drawn_plain(rng, n, words_around(codes))
    none = np.full(len(codes), -1)
    return np.concatenate([codes, *again]), np.concatenate([labels, np.ones(n), np.zeros(n)]), np.concatenate([none, kinds, np.full(n, -1)])


# ---- network ------------------------------------------------------------------------


class Network:
    """Embedding, one convolution, the maximum over the surroundings and over the candidate, one logistic unit."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p = {
            "embed": rng.normal(0, 0.3, (N_CLASSES, EMBED)), "filters": rng.normal(0, 0.2, (WIDTH * EMBED, FILTERS)), "shift": np.zeros(FILTERS),
            "out": rng.normal(0, 0.2, (3 * FILTERS,)), "constant": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.slope, self.offset, self.threshold, self.false_share = 1.0, 0.0, 2.0, 0.0

    def _forward(self, codes: np.ndarray) -> tuple:
        p, n = self.p, codes.shape[1] - WIDTH + 1
        letters = p["embed"][codes]
        patches = np.concatenate([letters[:, i : i + n] for i in range(WIDTH)], axis=2)
        maps = np.maximum(patches @ p["filters"] + p["shift"], 0)
        split = AROUND - WIDTH // 2
        left, right = maps[:, :split].argmax(axis=1), maps[:, split:].argmax(axis=1) + split
        rows, cols = np.arange(len(codes))[:, None], np.arange(FILTERS)[None, :]
        pooled = np.concatenate([maps[rows, left, cols], maps[rows, right, cols], maps[:, split:].mean(axis=1)], axis=1)
        return patches, maps, left, right, split, pooled, pooled @ p["out"] + p["constant"]

    def raw(self, codes: np.ndarray) -> np.ndarray:
        parts = [self._forward(codes[i : i + SCORED_AT_ONCE])[-1] for i in range(0, len(codes), SCORED_AT_ONCE)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * raw.astype(np.float64) + self.offset, -500, 500)))

    def score(self, codes: np.ndarray) -> np.ndarray:
        """Calibrated probability of being a secret."""
        return self.calibrated(self.raw(codes))

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def with_flat(self, flat: np.ndarray) -> Network:
        """A network of these weights, not calibrated."""
        out, ends = Network(), np.cumsum([v.size for v in self.p.values()])
        out.p = {k: part.reshape(v.shape).astype(np.float32) for (k, v), part in zip(self.p.items(), np.split(flat, ends[:-1]))}
        return out

    def fit(self, codes: np.ndarray, labels: np.ndarray, seed: int = 11, steps: int = STEPS, before: int = 0) -> None:
        """At least so many steps over whole passes of the cases, after those `before`."""
        rng, p = np.random.default_rng(seed), self.p
        first, second = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
        plain, (keys, _), others = codes[labels == 0], drawn_keys(rng, DRAWN), drawn_plain(rng, DRAWN, words_around(codes))
        weight = np.where(labels == 1, 0.5 / max(1e-9, labels.mean()), 0.5 / max(1e-9, 1 - labels.mean()))
        step = 0
        while step < steps:
            order = rng.permutation(len(codes))
            # an unlabelled candidate that looks like the keys known so far may be one: it is left out
            doubt = (labels == 0) & (self.raw(codes) > 0) if before + step > STEPS // 6 else np.zeros(len(codes), bool)
            for at in range(0, len(order), BATCH):
                some = order[at : at + BATCH]
                own, chance = codes[some].copy(), rng.random(len(some))
                own[chance < 1 / 3, :AROUND] = GAP  # a third of the cases show no surroundings
                other = (chance > 2 / 3) & (labels[some] == 1)  # and a third of the findings those of a counterexample
                if len(plain):
                    own[other, :AROUND] = plain[rng.integers(0, len(plain), other.sum()), :AROUND]
                chance, sure = rng.random(len(some)), labels[some] == 1
                half, third = sure & (chance < 1 / 2), ~sure & (chance < 1 / 3)
                own[half, AROUND:] = keys[rng.integers(0, DRAWN, half.sum())]
                own[third, AROUND:] = others[rng.integers(0, DRAWN, third.sum())]
                patches, maps, left, right, split, pooled, raw = self._forward(own)
                share = weight[some] * np.where(sure | third, 1.0, UNSURE) * ~(doubt[some] & ~third) / len(some)
                d = ((1 / (1 + np.exp(-np.clip(raw, -80, 80))) - labels[some]) * share).astype(np.float32)
                g = {"out": pooled.T @ d, "constant": np.array([d.sum()])}
                back = d[:, None] * p["out"][None, :]
                dm = np.zeros_like(maps)
                rows, cols = np.arange(len(own))[:, None], np.arange(FILTERS)[None, :]
                dm[rows, left, cols] += back[:, :FILTERS]
                dm[rows, right, cols] += back[:, FILTERS : 2 * FILTERS]
                dm[:, split:] += back[:, None, 2 * FILTERS :] / (maps.shape[1] - split)
                dm *= maps > 0
                flat = dm.reshape(-1, FILTERS)
                g["filters"], g["shift"] = patches.reshape(-1, WIDTH * EMBED).T @ flat, flat.sum(axis=0)
                dp = (flat @ p["filters"].T).reshape(len(own), -1, WIDTH, EMBED)
                letters = np.zeros((len(own), own.shape[1], EMBED), np.float32)
                for i in range(WIDTH):
                    letters[:, i : i + dp.shape[1]] += dp[:, :, i]
                g["embed"] = np.zeros_like(p["embed"])
                np.add.at(g["embed"], own, letters)
                step += 1
                for k in p:
                    first[k] = 0.9 * first[k] + 0.1 * g[k]
                    second[k] = 0.999 * second[k] + 0.001 * g[k] ** 2
                    p[k] = p[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)

    def level(self, raw: np.ndarray, labels: np.ndarray) -> None:
        """Logistic fit of the raw score."""
        raw = raw.astype(np.float64)
        scale = raw.std() or 1.0
        a, b = 1.0, 0.0
        for _ in range(300):
            q = 1 / (1 + np.exp(-np.clip(a * raw / scale + b, -500, 500)))
            a, b = a - 0.5 * ((q - labels) * raw / scale).mean(), b - 0.5 * (q - labels).mean()
        self.slope, self.offset = a / scale, b

    def calibrate(self, codes: np.ndarray, labels: np.ndarray, kinds: np.ndarray | None = None) -> None:
        """Logistic fit on held-out cases, then the threshold by the recall of each kind; it lets `false_share` of the others through."""
        raw = self.raw(moved(codes, labels))
        self.level(raw, labels)
        score = self.calibrated(raw)
        own = score[labels == 1]
        of = np.full(len(own), -1) if kinds is None else kinds[labels == 1]
        self.threshold = float(min(np.sort(own[of == k])[least_rank(k, (of == k).sum())] for k in np.unique(of)))
        self.false_share = float((score[labels == 0] >= self.threshold).mean())


def least_rank(kind: int, n: int) -> int:
    """Place, from 0, of the highest threshold that recalls enough of n cases in rising order."""
    return int((n - 1) * (1 - (RECALL if kind < 0 else DRAWN_RECALL)))


def ordered(bits: np.ndarray) -> np.ndarray:
    """Keys in the order of the floats whose bits are given; the same turns keys back to bits."""
    return bits ^ ((bits >> 31) & 0x7FFFFFFF)


def findings(text: str, network: Network | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all spans: the base spans, and the candidates above the threshold."""
    base = base_spans(text)
    if network is None:
        return base
    places = candidates(text, base)
    if not places:
        return base
    best = np.zeros(len(places))
    each = ((i, w) for i, (a, z) in enumerate(places) for w in windows(text, a, z))
    while some := list(islice(each, SCORED_AT_ONCE)):
        np.maximum.at(best, [i for i, _ in some], network.score(np.array([w for _, w in some])))
    return sorted(base + [(a, 3, z) for (a, z), s in zip(places, best.tolist()) if s >= network.threshold])


# ---- jobs ---------------------------------------------------------------------------


def cases_of(text: str) -> Iterator[tuple[int, bytes]]:
    """(label, codes) of the windows of a text's findings and of its other candidates."""
    base = base_spans(text)
    for a, kind, z in base:
        yield 1, window(text, ASSIGN.match(text, a).start(2) if kind == 0 else a, z).tobytes()
    for a, z in candidates(text, base):
        for w in windows(text, a, z):
            yield 0, w.tobytes()


def cases(docs: DataFrame) -> DataFrame:
    """(place, label, codes): all distinct examples and counterexamples of all documents, and their hashes."""

    def rows(kept: set[tuple[int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({
            "place": pa.array([xxhash.xxh64_intdigest(c, y) - (1 << 63) for y, c in kept], pa.int64()),
            "label": pa.array([y for y, _ in kept], pa.int32()), "codes": pa.array([c for _, c in kept], pa.binary()),
        })

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: set[tuple[int, bytes]] = set()
        for case in chain.from_iterable(cases_of(t.as_py() or "") for batch in batches for t in batch.column("text")):
            kept.add(case)
            if len(kept) == SENT_AT_ONCE:
                yield rows(kept)
                kept = set()
        yield rows(kept)

    return cut(docs.select(F.col("text").cast("string").alias("text")).mapInArrow(found, "place long, label int, codes binary").dropDuplicates())


BLOCK = "block long, fit binary, fit_labels binary, held binary, held_labels binary, held_counted binary"


def blocks(found: DataFrame) -> tuple[DataFrame, int]:
    """The cases as one row per block, and the number of blocks, 0 unless there are both kinds.

    A kind is cut into parts by hash, and block b has the part b % parts of each. A part's held-out cases are the
    same wherever it comes; they are counted in its first block."""
    counts = {r["label"]: r["count"] for r in found.groupBy("label").count().collect()}  # two rows
    if len(counts) < 2:
        return found, 0
    parts = {label: -(-count // BLOCK_EACH) for label, count in counts.items()}
    n = max(parts.values())
    own = F.when(F.col("label") == 1, F.lit(parts[1])).otherwise(F.lit(parts[0])).cast("long")
    part = F.pmod("place", own)
    dealt = found.select("place", "label", "codes", part.alias("part"), F.explode(F.sequence(part, F.lit(n - 1).cast("long"), own)).alias("block"))

    def packed(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("place", "codes", "label", "part"))))
        fit, held = [], []
        for label in (0, 1):
            of = [r for r in rows if r[2] == label]
            held += of[::HELD_OUT]
            fit += [r for i, r in enumerate(of) if i % HELD_OUT or len(of) == 1]  # a single one serves for both
        joined = lambda some: (b"".join(r[1] for r in some), bytes(r[2] for r in some))
        values = [block, *joined(fit), *joined(held), bytes(r[3] == block for r in held)]
        kinds = [pa.int64()] + [pa.binary()] * 5
        return pa.Table.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=["block", "fit", "fit_labels", "held", "held_labels", "held_counted"])

    return cut(dealt.repartition(n, "block").groupBy("block").applyInArrow(packed, BLOCK)), n


def _rows(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """The rows of these columns, one at a time."""
    return (tuple(v.as_py() for v in r) for b in batches for r in zip(*(b.column(c) for c in columns)))


def _opened(codes: bytes, labels: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(codes, np.uint8).reshape(-1, AROUND + INSIDE), np.frombuffer(labels, np.uint8).astype(float)


def trained(packs: DataFrame, n: int) -> Network:
    """The network after all rounds: each starts from the mean of the weights of all n blocks."""
    network, rounds = Network(), ROUNDS if n > 1 else 1

    def learn(shared, number: int):
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block, codes, labels in _rows(batches, "block", "fit", "fit_labels"):
                own = copy.deepcopy(shared.value)
                own.fit(*_opened(codes, labels), seed=11 + block + n * number, steps=STEPS // rounds, before=number * STEPS // rounds)
                yield pa.RecordBatch.from_pydict({"weights": pa.array([own.flat().astype(np.float64)], pa.list_(pa.float64()))})

        return task

    for number in range(rounds):
        shared = SparkContext.getOrCreate().broadcast(network)
        weights = packs.select("block", "fit", "fit_labels").mapInArrow(learn(shared, number), "weights array<double>")
        means = weights.select(F.posexplode("weights")).groupBy("pos").agg(F.avg("col").alias("mean"), F.count("*").alias("n")).collect()  # a row per weight
        assert all(r["n"] == n for r in means), "a block is missing"
        network = network.with_flat(np.array([r["mean"] for r in sorted(means, key=lambda r: r["pos"])]))
    return network


PLAIN = -2  # kind of all counterexamples; findings are -1, drawn keys of their own kinds


def least_keys(scores: DataFrame) -> dict[int, int]:
    """Of each kind of key in (kind, key) the key at its `least_rank`, exactly: its bits are counted from the highest on."""
    own, ranks, known, last = scores.filter(F.col("kind") != PLAIN), {}, {}, 0
    for shift in KEY_SHIFTS:
        if known:
            start = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))[F.col("kind")]
            own = scores.filter(F.shiftright("key", last) == start)
        counts: dict[int, list[tuple[int, int]]] = {}
        for r in own.groupBy("kind", F.shiftright("key", shift).alias("bits")).count().collect():  # at most 4,096 rows a kind
            counts.setdefault(r["kind"], []).append((r["bits"], r["count"]))
        for kind, found in counts.items():
            rank = ranks[kind] if known else least_rank(kind, sum(c for _, c in found))
            for bits, count in sorted(found):
                if rank < count:
                    break
                rank -= count
            counts[kind], ranks[kind] = [(bits, count)], rank
        known, last = {kind: found[0][0] for kind, found in counts.items()}, shift
    return known


def calibrated(network: Network, packs: DataFrame) -> Network:
    """The network with slope, offset, threshold and share of others let through from the held-out cases of all blocks."""
    shared = SparkContext.getOrCreate().broadcast(network)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, codes, labels, counted in _rows(batches, "block", "held", "held_labels", "held_counted"):
            own = copy.deepcopy(shared.value)
            codes, labels, kinds = with_drawn(*_opened(codes, labels), seed=5 + block)
            raw = own.raw(moved(codes, labels))
            own.level(raw, labels)
            counts = np.concatenate([np.frombuffer(counted, np.uint8) == 1, np.ones(len(codes) - len(counted), bool)])
            kinds = np.where(labels == 1, kinds, PLAIN)
            yield pa.RecordBatch.from_pydict({
                "slope": [own.slope], "offset": [own.offset], "kinds": pa.array([kinds[counts].astype(np.int8).tobytes()], pa.binary()),
                "raws": pa.array([raw[counts].astype(np.float32).tobytes()], pa.binary()),
            })

    judged = cut(packs.select("block", "held", "held_labels", "held_counted").mapInArrow(judge, "slope double, offset double, kinds binary, raws binary"))
    out = copy.deepcopy(network)
    out.slope, out.offset = judged.agg(F.avg("slope"), F.avg("offset")).first()
    sign = np.float32(-1 if out.slope < 0 else 1)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kinds, raws in _rows(batches, "kinds", "raws"):
            yield pa.RecordBatch.from_pydict({
                "kind": pa.array(np.frombuffer(kinds, np.int8).astype(np.int32)), "key": pa.array(ordered((sign * np.frombuffer(raws, np.float32) + np.float32(0)).view(np.int32))),
            })

    scores = judged.select("kinds", "raws").mapInArrow(keys, "kind int, key int")
    least = min(least_keys(scores).values())
    out.threshold = float(out.calibrated(sign * ordered(np.array([least], np.int32)).view(np.float32))[0])
    out.false_share = scores.filter(F.col("kind") == PLAIN).agg(F.avg((F.col("key") >= least).cast("double"))).first()[0]
    return out


def fitted(docs: DataFrame) -> Network | None:
    """The network of all of the rules' findings and all other candidates of all documents."""
    packs, n = blocks(cases(docs))
    if not n:
        LOG.warning("no network: the documents hold no findings of the rules, or no other candidates; there are no model spans")
        return None
    network = calibrated(trained(packs, n), packs)
    level = logging.WARNING if network.false_share > FALSE_SHARE else logging.INFO
    LOG.log(level, "the threshold %.4g lets %.4f of the held-out other candidates through", network.threshold, network.false_share)
    return network


def findings_column(network: Network | None, text: Column) -> Column:
    """array of (kind, start, end), in code points."""
    shared = SparkContext.getOrCreate().broadcast(network)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    @F.arrow_udf("array<struct<kind: string, start: long, end: long>>")
    def spans(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            out.append([{"kind": KINDS[k], "start": a, "end": z} for a, k, z in findings(t.as_py() or "", shared.value)])
        return pa.array(out, kind)

    return spans(text.cast("string"))


def scanned(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id and `found`, all its spans in order."""
    return docs.select("doc_id", findings_column(fitted(docs), F.col("text")).alias("found"))


def digests(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, and all spans as text, from `scanned`."""
    shown = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.transform(F.filter("found", lambda s: s["kind"] != "model"), shown)
    return found.select(
        "doc_id", *(count(k) for k in KINDS), F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.transform("found", shown), ",").alias("spans"),
    )
