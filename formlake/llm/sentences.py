"""Repeated passages: sentences covered by any non-first repeated span go.

A span is a run of consecutive sentences with LEAST_WORDS = 25 words and no fewer sentences than
that takes: every start has one, to the first end 25 words on, and every end has one, from the last
start 25 words back. Spans of equal words (A-Z lower-cased) are one span; its first place, by
doc_id and word, stays, and the sentences of every other place are cut out of their texts.

A sentence ends at a word ending in . ! or ?. In every PIECE consecutive words without one
the word with the least hash ends a sentence too, so none is longer and a passage is cut
alike wherever it stands, whatever is around it. A line end also ends a sentence, but no span
begins or ends for it, as lines may be broken anew.

Any 50 shared words hold a common span. Of the first PIECE = 9 one is a common end, whatever is
before. The span that starts there ends at most 33 words on, by word 42; which of its words are ends
depends on up to PIECE - 1 = 8 words after them, all of them shared. A copy that ends with the
passage has one more end, its last word, beyond all that.

The texts are read three times: to count spans, to place the repeated ones (a bitmap of
bounded size keeps most others off the shuffle), and to cut. Null and empty texts have
no sentences and stay as they are. Rows that agree in doc_id and text are one document
and get one result; rows that repeat only the doc_id are separate documents, in order of
their texts' hash. A null doc_id comes before all others. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from formlake.llm.common import BLANKS, bitmap_of, in_bitmap, mixed, prefix_powers, span_hashes, spans_of
from formlake.operators.skew import join_on_counted_key
from formlake.session import cut

LEAST_WORDS = 25
PIECE = 9
_ENDS = np.frombuffer(b".!?", np.uint8)
_SECOND = np.uint64(0xA0761D6478BD642F)


def least_of_each(hashes: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Marks the last of the least hashes of every `size` consecutive words without an end."""
    out = np.zeros(len(hashes), bool)
    if len(hashes) < size:
        return out
    least, at = hashes.copy(), np.arange(len(hashes))
    free, width = ~ends, 1
    while width < size:  # windows that begin at each word, doubled up to `size`
        step = min(width, size - width)
        n = len(least) - step
        right = least[step:] <= least[:n]
        least, at = np.where(right, least[step:], least[:n]), np.where(right, at[step:], at[:n])
        free, width = free[:n] & free[step:], width + step
    out[at[free]] = True
    return out


class Text:
    """Words and sentences of a UTF-8 text."""

    def __init__(self, text: bytes):
        low = text.lower()
        self.data = np.frombuffer(low, np.uint8)
        self.starts, self.ends = spans_of(self.data, BLANKS)
        n = len(self.starts)
        self.words = span_hashes(self.data, self.starts, self.ends)
        stop = np.isin(self.data[self.ends - 1], _ENDS) if n else np.zeros(0, bool)
        if n:
            stop |= least_of_each(self.words, stop, PIECE)
            stop[-1] = True
        self.cuts = np.flatnonzero(stop) + 1  # ends that depend on the words alone: one past the last word
        if n:
            lines = np.flatnonzero(self.data == 10)
            before = np.searchsorted(lines, self.starts)
            stop[:-1] |= before[1:] > before[:-1]
        self.last = np.flatnonzero(stop) + 1
        self.first = np.concatenate([[0], self.last[:-1]]).astype(np.int64)[: len(self.last)]  # words of each sentence: first, and one past the last

    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """First word of each span and one past its last."""
        starts = np.concatenate([[0], self.cuts[:-1]]).astype(np.int64)[: len(self.cuts)]
        end = np.searchsorted(self.cuts, starts + LEAST_WORDS)
        start = np.searchsorted(starts, self.cuts - LEAST_WORDS, side="right") - 1
        begins, stops = np.flatnonzero(end < len(self.cuts)), np.flatnonzero(start >= 0)
        new = stops[end[start[stops]] != stops]  # the others are there already
        return np.concatenate([starts[begins], starts[start[new]]]), np.concatenate([self.cuts[end[begins]], self.cuts[new]])

    def hashes(self, first: np.ndarray, last: np.ndarray, salt: np.uint64 = np.uint64(0)) -> np.ndarray:
        """A 64-bit hash of the words of each span."""
        power, inverse = prefix_powers(len(self.words) + 1)
        words = mixed(self.words ^ salt) if salt else self.words
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * power[: len(words)])])
        return mixed((sums[last] - sums[first]) * inverse[first] + (last - first).astype(np.uint64))


def _offsets(lists: list[np.ndarray]) -> pa.Array:
    return pa.array(np.cumsum([0, *map(len, lists)]), pa.int32())


def span_hashes_column(text: Column) -> Column:
    @F.arrow_udf(ArrayType(LongType()))
    def hashes(texts: pa.Array) -> pa.Array:
        found = []
        for t in texts:
            own = Text(t.as_py() or b"")
            found.append(own.hashes(*own.spans()).view(np.int64))
        return pa.ListArray.from_arrays(_offsets(found), pa.array(np.concatenate([*found, np.zeros(0, np.int64)])))

    return hashes(text)


PLACE = pa.struct([("hash", pa.int64()), ("also", pa.int32()), ("a", pa.int32()), ("z", pa.int32())])


def candidate_column(text: Column, bitmap: np.ndarray, bits: int) -> Column:
    """Spans whose hash may be a repeated one."""
    shared = SparkContext.getOrCreate().broadcast(bitmap)

    @F.arrow_udf("array<struct<hash: long, also: int, a: int, z: int>>")
    def places(texts: pa.Array) -> pa.Array:
        found = []
        for t in texts:
            own = Text(t.as_py() or b"")
            a, z = own.spans()
            hashes = own.hashes(a, z)
            kept = in_bitmap(shared.value, bits, hashes)
            a, z, hashes = a[kept], z[kept], hashes[kept]
            also = own.hashes(a, z, _SECOND).view(np.int64) >> 32
            found.append((hashes.view(np.int64), also.astype(np.int32), a.astype(np.int32), z.astype(np.int32)))
        columns = [np.concatenate([*(f[i] for f in found), np.zeros(0, kind)]) for i, kind in enumerate((np.int64, *[np.int32] * 3))]
        values = pa.StructArray.from_arrays([pa.array(c) for c in columns], fields=list(PLACE))
        return pa.ListArray.from_arrays(_offsets([f[0] for f in found]), values)

    return places(text)


KEPT = pa.struct([("text", pa.string()), ("n_sentences", pa.int64()), ("n_removed", pa.int64()), ("words_removed", pa.int64())])


def cut_column(text: Column, spans: Column) -> Column:
    """The text without the sentences of the given spans, and counts."""

    @F.arrow_udf("struct<text: string, n_sentences: long, n_removed: long, words_removed: long>")
    def cuts(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for t, gone in zip(texts, spans.to_pylist()):
            raw = t.as_py()
            own = Text(raw or b"")
            n = len(own.first)
            marks = np.zeros(len(own.words) + 1, np.int64)
            for g in gone or []:
                marks[g["a"]] += 1
                marks[g["z"]] -= 1
            lost = (np.cumsum(marks) > 0)[own.first]  # spans are whole sentences
            if lost.any():
                begins = own.starts[own.first]
                stops = np.concatenate([begins[1:], [len(raw)]])
                head = raw[: begins[0]]
                raw = head + b"".join([raw[a:z] for a, z, x in zip(begins.tolist(), stops.tolist(), lost.tolist()) if not x])
            out.append({"text": raw, "n_sentences": n, "n_removed": int(lost.sum()), "words_removed": int((own.last - own.first)[lost].sum())})
        return pa.array([{**o, "text": None if o["text"] is None else o["text"].decode()} for o in out], KEPT)

    return cuts(text, spans)


def repeated_spans(rows: DataFrame) -> DataFrame:
    """(doc_id, mark, a, z): the words of every place but the first of each repeated span. `rows` has doc_id, mark (the text's hash) and text."""
    data = F.col("text").cast("binary")
    hashes = rows.select(F.explode_outer(span_hashes_column(data)).alias("hash")).filter("hash IS NOT NULL")
    repeated = cut(hashes.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash"))
    bits, bitmap = bitmap_of(repeated, "hash")
    found = rows.select("doc_id", "mark", F.explode_outer(candidate_column(data, bitmap, bits)).alias("s")).filter("s IS NOT NULL")
    places = cut(found.select("doc_id", "mark", F.struct("s.hash", "s.also").alias("key"), "s.a", "s.z"))
    first = places.groupBy("key").agg(F.min(F.struct("doc_id", "mark", "a")).alias("first"), F.count("*").alias("n"))
    met = join_on_counted_key(places, cut(first.filter("n > 1")), "key", "n", "mark")  # a passage may be in most documents
    return met.filter(F.struct("doc_id", "mark", "a") > F.col("first")).select("doc_id", "mark", "a", "z")


def without_repeats(docs: DataFrame) -> DataFrame:
    """One row per document of (doc_id, text): doc_id, the text that stays, n_sentences, n_removed, words_removed."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("mark"), F.col("text").cast("string").alias("text"))
    gone = repeated_spans(rows).groupBy("doc_id", "mark").agg(F.collect_list(F.struct("a", "z")).alias("gone"))
    of = cut(gone.select(F.col("doc_id").alias("_doc_id"), F.col("mark").alias("_mark"), "gone"))
    joined = rows.join(of, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("mark") == F.col("_mark")), "left")
    return joined.select("doc_id", cut_column(F.col("text").cast("binary"), F.col("gone")).alias("r")).select("doc_id", "r.*")
