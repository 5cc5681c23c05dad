"""Benchmark passages in documents, by a prefix-filtered set join.

A benchmark item is the set of its windows: ten consecutive words, or all words of a
shorter item. A window is the set of its five-word shingles (one shingle, if shorter)
with their places. Documents are read once: a bitmap of the benchmark's shingles, of
bounded size, picks the stretches of words all of whose shingles may be the benchmark's
and that are long enough for a window (length bound). Only these stretches go on, as
text. Their shingles are counted, and each window is joined by its rarest shingle alone:
containment of the whole window needs that one (a prefix of length one). A meeting gives
the place the window would have in the stretch (positional bound), and the words there
are compared with the window's.

Words are lower-cased (A-Z) runs of ASCII letters, digits and non-ASCII characters. Null
and empty texts have none. Rows that repeat a doc_id are separate documents; items that
repeat an item_id are one item, and a null item_id counts as the id of empty text. Empty
documents or an empty benchmark give no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formlake.llm.common import bitmap_of, byte_table, in_bitmap, mixed, packed, span_hashes, spans_of, unpacked
from formlake.session import cut

WINDOW = 10
SHINGLE = 5
_FACTOR = np.uint64(0x9FB21C651E98DF25)

SEPARATES = byte_table(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))


def word_spans(text: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The text with A-Z lower-cased, and its words' starts and ends in bytes."""
    low = text.lower()
    return low, *spans_of(np.frombuffer(low, np.uint8), SEPARATES)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words from the words' hashes."""
    n = len(words) - size + 1
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = out * _FACTOR + words[k : k + n]
    return mixed(out)


def windows_of(text: bytes, length: int = WINDOW) -> list[tuple[int, str, list[int]]]:
    """(words, window text, hashes of its shingles) of each window of an item."""
    low, starts, ends = word_spans(text)
    if not len(starts):
        return []
    words = [low[a:z].decode() for a, z in zip(starts, ends)]
    n = min(length, len(words))
    hashes = shingle_hashes(span_hashes(np.frombuffer(low, np.uint8), starts, ends), min(SHINGLE, n))
    per = n - min(SHINGLE, n) + 1
    return [(n, " ".join(words[i : i + n]), hashes[i : i + per].view(np.int64).tolist()) for i in range(len(words) - n + 1)]


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, n, window, hashes) for every window of every item."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("item_id", pa.string()), ("n", pa.int32()), ("window", pa.string()), ("hashes", pa.list_(pa.int64()))])
        for batch in batches:
            ids, found = [], []
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text")):
                own = windows_of(text.as_py() or b"")
                ids += [item] * len(own)
                found += own
            n, window, hashes = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((ids, n, window, hashes), kind.types)], schema=kind)

    named = F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id")
    return benchmark.select(named, F.col("text").cast("binary").alias("text")).mapInArrow(
        rows, "item_id string, n int, window string, hashes array<long>"
    )


class Filter:
    """Which shingles may be the benchmark's: a packed bitmap for all sizes, and the shortest window of each size."""

    def __init__(self, windows: DataFrame):
        self.bits, self.bitmap = bitmap_of(windows.select(F.explode("hashes").alias("hash")), "hash")
        shortest = windows.groupBy(F.least("n", F.lit(SHINGLE)).alias("size")).agg(F.min("n").alias("n")).collect()  # five rows at most
        self.shortest = {r["size"]: r["n"] for r in shortest}

    def stretches(self, text: bytes) -> tuple[int, list[dict]]:
        """Number of words, and the stretches (start, words) that can hold a window."""
        low, starts, ends = word_spans(text)
        n = len(starts)
        if not n or not self.shortest:
            return n, []
        words = span_hashes(np.frombuffer(low, np.uint8), starts, ends)
        change = np.zeros(n + 1, np.int32)
        for size, shortest in self.shortest.items():
            if n < shortest:
                continue
            a, z = _runs(in_bitmap(self.bitmap, self.bits, shingle_hashes(words, size)))
            long = z - a >= shortest - size + 1
            np.add.at(change, a[long], 1)
            np.add.at(change, z[long] + size - 1, -1)
        a, z = _runs(np.cumsum(change[:-1]) > 0)
        return n, [
            {"start": s, "words": " ".join([low[i:j].decode() for i, j in zip(starts[s:e], ends[s:e])])} for s, e in zip(a.tolist(), z.tolist())
        ]


def _runs(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], marks, [False]]).astype(np.int8)))
    return edges[::2], edges[1::2]


def stretch_column(found: Filter, text: Column) -> Column:
    kind = pa.struct([("n_words", pa.int64()), ("stretches", pa.list_(pa.struct([("start", pa.int64()), ("words", pa.string())])))])
    shared = SparkContext.getOrCreate().broadcast(found)

    @F.arrow_udf("struct<n_words: long, stretches: array<struct<start: long, words: string>>>")
    def stretches(texts: pa.Array) -> pa.Array:
        rows = [shared.value.stretches(t.as_py() or b"") for t in texts]
        return pa.array([{"n_words": n, "stretches": s} for n, s in rows], kind)

    return stretches(text.cast("binary"))


def hits(found: DataFrame, windows: DataFrame) -> DataFrame:
    """(row, at, n, window): each occurrence of a window. `found` has row, n_words and stretches."""
    stretches = found.select("row", F.explode("stretches").alias("s")).select(
        "row", F.col("s.start").alias("start"), F.split("s.words", " ").alias("words")
    )
    distinct = cut(windows.select("n", "window").distinct())

    def shingled(words: Column, size: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.size(words) - size + 1), lambda i: F.struct((i - 1).alias("at"), F.array_join(F.slice(words, i, size), " ").alias("shingle"))
        )

    used = [r["size"] for r in distinct.select(F.least("n", F.lit(SHINGLE)).alias("size")).distinct().collect()]  # five at most
    own = F.array(*(F.lit(s) for s in sorted(used))) if used else F.array().cast("array<int>")
    sized = stretches.select("*", F.explode(own).alias("size")).filter(F.size("words") >= F.col("size"))
    placed = sized.select("*", F.explode(shingled(F.col("words"), F.col("size"))).alias("p"))
    first = F.greatest(F.lit(0), F.col("p.at") - (WINDOW - 1))
    shingles = placed.select(
        "row", (F.col("start") + F.col("p.at")).alias("at"), "p.shingle",
        (F.col("p.at") - first).alias("before"), F.slice("words", first + 1, 2 * WINDOW).alias("around"),
    )
    counts = shingles.groupBy("shingle").agg(F.count("*").alias("count"))
    parts = F.split("window", " ")
    tokens = distinct.select("n", "window", F.explode(shingled(parts, F.least(F.col("n"), F.lit(SHINGLE)))).alias("t"))
    rarity = tokens.select("n", "window", "t.at", "t.shingle").join(counts, "shingle", "left")
    prefix = rarity.groupBy("n", "window").agg(
        F.min(F.struct("count", "shingle", "at")).alias("least"), F.count_if(F.col("count").isNull()).alias("absent")
    ).filter("absent = 0")
    prefix = cut(prefix.select("n", "window", "least.shingle", F.col("least.at").alias("offset")))
    met = shingles.join(prefix, "shingle").filter(F.col("before") >= F.col("offset"))
    there = F.array_join(F.slice("around", F.col("before") - F.col("offset") + 1, F.col("n")), " ")
    return met.filter(there == F.col("window")).select("row", (F.col("at") - F.col("offset")).alias("at"), "n", "window").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    windows = cut(item_windows(benchmark))
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), stretch_column(Filter(windows), F.col("text")).alias("f"))
    rows = cut(rows.select("doc_id", "row", "f.*"))
    found = cut(hits(rows.filter(F.size("stretches") > 0), windows))
    before = Window.partitionBy("row").orderBy("at", "n").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("at") + F.col("n")
    fresh = found.select("row", (end - F.greatest("at", F.least(end, F.coalesce(F.max(end).over(before), F.lit(0))))).alias("fresh"))
    covered = fresh.groupBy("row").agg(F.sum("fresh").alias("n_hit"))
    named = found.select("row", "window").distinct().join(windows.select("item_id", "window").distinct(), "window")
    items = named.groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    whole = rows.select("doc_id", "row", "n_words").join(covered, "row", "left").join(items, "row", "left")
    ids = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return whole.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents of `docs` in which no window of the benchmark occurs."""
    windows = cut(item_windows(benchmark))
    rows = packed(docs).select("_doc", F.monotonically_increasing_id().alias("row"), stretch_column(Filter(windows), F.col("_doc.text")).alias("f"))
    rows = cut(rows.select("_doc", "row", "f.stretches"))
    suspects = rows.filter(F.size("stretches") > 0).select("row", "stretches")
    dirty = cut(hits(suspects, windows).select("row").distinct())
    return unpacked(rows.join(dirty, "row", "left_anti"), docs)
