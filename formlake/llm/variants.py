"""Spelling variants: words one edit apart, found by range searches in k-d trees over letter counts.

One inserted or deleted letter changes the vector of letter counts by 1, one replaced letter by 2
(sum of differences). So for each pair of lengths (equal, or one apart) the words of the
shorter length stand in a k-d tree over their counts, and each word of the longer looks for all
within that distance: boxes farther away are pruned, and what is left is compared
letter by letter.

The upper part of each length's tree is made from a bounded sample of words (the splits; every word is
then dealt by them), its leaves are cells of some thousand words; a word goes to every
cell whose box is within reach, few beside all cells, as a cell across three splits is three
away. Cells that hold more words than that, as many words have the same letters, are dealt
over several tasks. In a task words of equal counts are one point of the lower tree. Near words leave
a task as a number and the best one for each word, never as pairs.

Words are counted from whole texts with sums combined before the shuffle, so a word that
makes up a third of all rows is one row for each task. Words whose text is null don't
exist; a null document id is the empty text in the hash. An empty table gives no rows.
Further columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formlake.session import cut

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CELL_WORDS = 8192
SAMPLE_WORDS = 1 << 15  # for the splits of all lengths, chosen by hash
MOST_LEVELS = 12  # of splits; beyond, cells are dealt over tasks by hash
LEAF_POINTS = 48
AT_ONCE = 1 << 14  # queries that go down a tree together
ALPHABET = np.zeros(256, np.int64)  # place of a letter's Latin-1 code in the count vectors
ALPHABET[[*LOWER.encode(), *range(0xC0, 0x100)]] = np.arange(90)
LETTERS = 90


# ---- words ---------------------------------------------------------------------------


def occurrences(docs: DataFrame, every: int) -> DataFrame:
    """(word): every run of letters, in lower case; where `every` divides the CRC of `<doc_id>:<run>` one letter is missing."""
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(RUN), F.lit(0))).alias("run"),
    )
    code = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (code % F.length("run")).cast("int")
    less = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    return runs.select(F.when(code % every == 0, less).otherwise(F.col("run")).alias("word"))


def vocabulary(docs: DataFrame, every: int, least_length: int, least_count: int) -> DataFrame:
    """(word, n): the words of some length that occur often enough."""
    counted = occurrences(docs, every).filter(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= least_count)


# ---- trees ---------------------------------------------------------------------------


def letters(words: list[str]) -> np.ndarray:
    """Words of one length as rows of Latin-1 codes."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def letter_counts(codes: np.ndarray) -> np.ndarray:
    out = np.zeros((len(codes), LETTERS), np.int32)
    for column in ALPHABET[codes].T:
        out[np.arange(len(codes)), column] += 1
    return out


def split_of(counts: np.ndarray) -> tuple[int, int] | None:
    """(letter, most on the left) that parts points most evenly; None where all are equal."""
    best, found = 0, None
    for letter in np.argsort(-counts.var(axis=0), kind="stable")[:8]:
        values = np.sort(counts[:, letter])
        for bar in {values[(len(values) - 1) // 2], values[len(values) // 2] - 1}:
            left = int(np.searchsorted(values, bar, side="right"))
            if min(left, len(values) - left) > best:
                best, found = min(left, len(values) - left), (int(letter), int(bar))
    return found


class Splits:
    """The upper tree of one length: node i has children 2i + 1 and 2i + 2; a node without a split is a cell."""

    def __init__(self, counts: np.ndarray, levels: int):
        self.at: dict[int, tuple[int, int]] = {}
        self._grow(counts, 0, levels)

    def _grow(self, counts: np.ndarray, node: int, levels: int) -> None:
        split = split_of(counts) if levels and len(counts) > 1 else None
        if split:
            self.at[node] = split
            left = counts[:, split[0]] <= split[1]
            self._grow(counts[left], 2 * node + 1, levels - 1)
            self._grow(counts[~left], 2 * node + 2, levels - 1)

    def cells(self, counts: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell): the cells whose box is at most `reach` from each row."""
        rows, found = [], []
        stack = [(0, np.arange(len(counts)), {})]
        while stack:
            node, some, box = stack.pop()
            if not len(some):
                continue
            if node not in self.at:
                rows.append(some)
                found.append(np.full(len(some), node, np.int64))
                continue
            letter, bar = self.at[node]
            low, high = box.get(letter, (None, None))
            for child, side in ((2 * node + 1, (low, bar)), (2 * node + 2, (bar + 1, high))):
                inner = {**box, letter: side}
                away = sum(
                    (0 if a is None else np.maximum(a - counts[some, c], 0)) + (0 if b is None else np.maximum(counts[some, c] - b, 0))
                    for c, (a, b) in inner.items()
                )
                stack.append((child, some[away <= reach], inner))
        return (np.concatenate(rows), np.concatenate(found)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def within(points: np.ndarray, queries: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, point) pairs of rows that differ by exactly `reach` in sum, leaf by leaf of a k-d tree over the points."""
    used = np.flatnonzero((points.max(axis=0) > 0) | (queries.max(axis=0) > 0))
    kind = np.int16 if max(points.max(), queries.max()) < 1 << 14 else np.int32
    points, queries = points[:, used].astype(kind), queries[:, used].astype(kind)

    def down(some: np.ndarray, asked: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        low, high = points[some].min(axis=0), points[some].max(axis=0)
        q = queries[asked]
        away = (np.maximum(low - q, 0) + np.maximum(q - high, 0)).sum(axis=1)
        asked = asked[away <= reach]
        if not len(asked):
            return
        split = split_of(points[some]) if len(some) > LEAF_POINTS else None
        if split:
            left = points[some, split[0]] <= split[1]
            yield from down(some[left], asked)
            yield from down(some[~left], asked)
            return
        for at in range(0, len(asked), 2048):
            part = asked[at : at + 2048]
            differ = np.abs(queries[part][:, None, :] - points[some][None, :, :]).sum(axis=2)
            i, j = np.nonzero(differ == reach)
            yield part[i], some[j]

    for at in range(0, len(queries), AT_ONCE):
        yield from down(np.arange(len(points)), np.arange(at, min(at + AT_ONCE, len(queries))))


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(axis=1) == 1


def one_inserted(longer: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Whether the longer word without one letter is the shorter."""
    ahead = np.logical_and.accumulate(longer[:, :-1] == shorter, axis=1).sum(axis=1)
    behind = np.logical_and.accumulate((longer[:, 1:] == shorter)[:, ::-1], axis=1).sum(axis=1)
    return ahead + behind >= shorter.shape[1]


# ---- near words ------------------------------------------------------------------------


class Best:
    """For each word: how many are near, and the one of largest n, of equals the first in code-point order."""

    def __init__(self, n_words: int):
        self.near = np.zeros(n_words, np.int64)
        self.best = np.full(n_words, -1, np.int64)

    def add(self, who: np.ndarray, other: np.ndarray, place: np.ndarray) -> None:
        """`place` orders the other words, the best one first."""
        if not len(who):
            return
        np.add.at(self.near, who, 1)
        order = np.lexsort((place[other], who))
        who, other = who[order], other[order]
        first = np.r_[True, who[1:] != who[:-1]]
        who, other = who[first], other[first]
        better = (self.best[who] < 0) | (place[other] < place[self.best[who]])
        self.best[who[better]] = other[better]


def order_of(words: list[str], n: np.ndarray) -> np.ndarray:
    """Place of each word by falling n, then code points."""
    order = np.lexsort((np.unique(np.array(words, object).astype(str), return_inverse=True)[1], -n))
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(words))
    return place


def expanded(groups: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pair, row) for pairs whose element `at` is a group: all rows of the group. `groups` gives each row's group."""
    order = np.argsort(groups, kind="stable")
    starts = np.searchsorted(groups[order], np.arange(groups.max() + 2))
    sizes = (starts[1:] - starts[:-1])[at]
    pair = np.repeat(np.arange(len(at)), sizes)
    inside = np.arange(len(pair)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return pair, order[starts[at][pair] + inside]


def compared(asked: pa.Table, held: pa.Table, reach: int) -> tuple[Best, Best]:
    """Near words of the asking words among the held ones, and the other way round."""
    q_words, x_words = asked.column("word").to_pylist(), held.column("word").to_pylist()
    q, x = letters(q_words), letters(x_words)
    q_place, x_place = (order_of(w, t.column("n").to_numpy()) for w, t in ((q_words, asked), (x_words, held)))
    points, x_group = np.unique(letter_counts(x), axis=0, return_inverse=True)
    looked, q_group = np.unique(letter_counts(q), axis=0, return_inverse=True)
    x_group, q_group = x_group.ravel(), q_group.ravel()
    near_q, near_x = Best(len(q)), Best(len(x))
    for i, j in within(points, looked, reach):
        pair, who = expanded(q_group, i)
        again, other = expanded(x_group, j[pair])
        who = who[again]
        for at in range(0, len(who), 1 << 20):
            a, b = who[at : at + (1 << 20)], other[at : at + (1 << 20)]
            fine = one_replaced(q[a], x[b]) if reach == 2 else one_inserted(q[a], x[b])
            near_q.add(a[fine], b[fine], x_place)
            if reach == 1:
                near_x.add(b[fine], a[fine], q_place)
    return near_q, near_x


def _rows(words: pa.Table, others: pa.Table, best: Best) -> pa.Table:
    has = np.flatnonzero(best.near)
    other = others.take(pa.array(best.best[has]))
    return pa.table({
        "word": words.column("word").take(pa.array(has)), "n_near": pa.array(best.near[has]), "other_n": other.column("n"), "other": other.column("word"),
    })


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, form, form_n) of the words that have near ones: their number and the most frequent of them; from (word, n)."""
    spark = words.sparkSession
    sized = words.withColumn("length", F.length("word"))
    sizes = {r["length"]: r["count"] for r in sized.groupBy("length").count().collect()}  # one row for each length
    one_in = max(1, ceil(sum(sizes.values()) / SAMPLE_WORDS))
    sample = sized.filter(F.pmod(F.xxhash64("word"), F.lit(one_in)) == 0).select("word", "length").collect()  # about SAMPLE_WORDS
    by_length: dict[int, list[str]] = {}
    for r in sample:
        by_length.setdefault(r["length"], []).append(r["word"])
    trees = {
        size: Splits(letter_counts(letters(by_length[size])) if size in by_length else np.zeros((0, LETTERS), np.int32), min(MOST_LEVELS, max(0, ceil(log2(n / CELL_WORDS)))))
        for size, n in sizes.items()
    }

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each word to its own cell (reach 0) and to the cells it asks: of its length, and of one less."""
        for batch in batches:
            length = batch.column("length").to_numpy()
            for size in np.unique(length):
                own = np.flatnonzero(length == size)
                counts = letter_counts(letters(batch.column("word").take(pa.array(own)).to_pylist()))
                for tree, reach in ((size, 0), (size, 2), (size - 1, 1)):
                    if tree not in trees:
                        continue
                    at, cell = trees[tree].cells(counts, reach)
                    some = batch.take(pa.array(own[at]))
                    yield pa.RecordBatch.from_pydict({
                        "word": some.column("word"), "n": some.column("n"), "tree": pa.array(np.full(len(at), tree, np.int32)),
                        "cell": pa.array(cell), "reach": pa.array(np.full(len(at), reach, np.int32)),
                    })

    dealt = cut(sized.mapInArrow(deal, "word string, n long, tree int, cell long, reach int"))
    held = dealt.filter("reach = 0")
    parts = held.groupBy("tree", "cell").agg(F.ceil(F.count("*") / (2 * CELL_WORDS)).cast("int").alias("parts"))
    held = held.join(parts, ["tree", "cell"]).withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    asked = dealt.filter("reach > 0").join(parts, ["tree", "cell"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    keys = ["tree", "cell", "part"]

    def task(q: pa.Table, x: pa.Table) -> pa.Table:
        out = [_rows(q.slice(0, 0), x.slice(0, 0), Best(0))]
        for reach in (1, 2):
            some = q.filter(pa.compute.equal(q.column("reach"), reach))
            for at in range(0, len(some) if len(x) else 0, 4 * CELL_WORDS):
                chunk = some.slice(at, 4 * CELL_WORDS)
                near_q, near_x = compared(chunk, x, reach)
                out += [_rows(chunk, x, near_q), _rows(x, chunk, near_x)]
        return pa.concat_tables(out)

    found = asked.select(*keys, "word", "n", "reach").groupBy(*keys).cogroup(held.select(*(F.col(c).alias(c) for c in [*keys, "word", "n"])).groupBy(*keys))
    found = found.applyInArrow(task, "word string, n_near long, other_n long, other string")
    best = F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("form")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", "b.form", (-F.col("b.n")).alias("form_n"))


def with_roots(words: DataFrame) -> DataFrame:
    """`words` (word, form, ..) with `root`, the last word that forms lead to.

    Each round doubles how far every word has looked; forms grow at least fivefold in number,
    so a handful of rounds ends it.
    """
    ahead = cut(words.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        further = ahead.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = cut(ahead.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        ahead = stepped.select("word", "root")
        if stepped.filter("moved").isEmpty():
            break
    return words.join(ahead, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, every: int = 199, least_length: int = 6, least_count: int = 5, ratio: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) from documents (doc_id, text)."""
    words = cut(vocabulary(docs, every, least_length, least_count))
    near = words.join(near_words(words), "word", "left")
    is_form = F.col("form_n") >= ratio * F.col("n")
    forms = near.select(
        "word", F.when(is_form, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("form_n")).alias("form_n"),
    )
    return with_roots(cut(forms)).select("word", "form", "root", "n", "n_near", "form_n")
