"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document is the set of its hashed features: words, beginnings of words, pairs of
neighbours and pairs with one word between. Weights are learned online, each with its
own learning rate, and L1 keeps most at zero, so the model is a short list of weights:
at most 2^DIMENSION_BITS of them, however large the corpus.

The model is fitted on at most SAMPLE_ROWS labelled rows, in hash order of doc_id; rows
whose crc32(doc_id as text) mod 5 is 0 are held out. Every document is scored whole.

Words are lower-cased (A-Z) runs of ASCII letters, digits and non-ASCII characters. Null
and empty texts have the score of the constant alone. Labels that repeat a doc_id count
as toxic if one of them says so; null labels and null doc_ids are not learned from, and
a null doc_id counts as held out. Without rows to learn from every score is 0. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from formlake.llm.common import mixed, span_hashes
from formlake.llm.decontaminate import word_spans
from formlake.session import cut

SAMPLE_ROWS = 12000
DIMENSION_BITS = 20
EPOCHS = 10
ALPHA, BETA, L1, L2 = 2.0, 1.0, 8.0, 0.1
HELD_OUT = 5
BEGINNINGS = (4, 5)
_SALTS = [np.uint64(s) for s in (0x9AE16A3B2F90404F, 0xC949C7DEFE4BC3A1, 0xB492B66FBE98F273, 0xD6D018F5A2B1C3E7)]


def features(text: bytes) -> np.ndarray:
    """Indices of a text's features, with repeats."""
    low, starts, ends = word_spans(text)
    if not len(starts):
        return np.zeros(0, np.int64)
    data = np.frombuffer(low, np.uint8)
    words = span_hashes(data, starts, ends)
    found = [words]
    for n, salt in zip(BEGINNINGS, _SALTS):
        found.append(mixed(span_hashes(data, starts, np.minimum(ends, starts + n)) ^ salt))
    for gap, salt in zip((1, 2), _SALTS[2:]):
        found.append(mixed(words[:-gap] * salt + words[gap:]))
    return (np.concatenate(found) >> np.uint64(64 - DIMENSION_BITS)).astype(np.int64)


class Model:
    """Weights by index; the constant is apart."""

    def __init__(self, weights: dict[int, float], constant: float):
        self.weights = np.zeros(1 << DIMENSION_BITS, np.float32)
        self.weights[list(weights)] = list(weights.values())
        self.constant = constant

    def score(self, text: bytes) -> float:
        found = features(text)
        present = np.unique(found[self.weights[found] != 0])
        return float(1 / (1 + np.exp(-np.clip(self.constant + self.weights[present].sum(dtype=np.float64), -500, 500))))


def ftrl(rows: list[np.ndarray], labels: list[int]) -> tuple[np.ndarray, float]:
    """Weights and constant after EPOCHS passes over rows of distinct feature indices, in the given order."""
    z, n = np.zeros(1 << DIMENSION_BITS), np.zeros(1 << DIMENSION_BITS)
    z0 = n0 = w0 = 0.0

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for found, label in zip(rows, labels):
            zs, ns = z[found], n[found]
            w = weights(zs, ns)
            g = 1 / (1 + np.exp(-np.clip(w0 + w.sum(), -500, 500))) - label
            z[found] = zs + g - (np.sqrt(ns + g * g) - np.sqrt(ns)) / ALPHA * w
            n[found] = ns + g * g
            z0 += g - (np.sqrt(n0 + g * g) - np.sqrt(n0)) / ALPHA * w0
            n0 += g * g
            w0 = -z0 / ((BETA + np.sqrt(n0)) / ALPHA + L2)
    return weights(z, n), w0


def held_out(doc_id: str) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % HELD_OUT == 0


def sampled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(place, doc_id, label, found): at most SAMPLE_ROWS labelled rows that aren't held out, also where rows repeat a doc_id."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out("doc_id"))
    named = known.groupBy("doc_id").agg(F.max("toxic").alias("label"))
    sample = cut(named.withColumn("place", F.xxhash64("doc_id")).orderBy("place", "doc_id").limit(SAMPLE_ROWS))

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(features(t.as_py() or b"")).astype(np.int32).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_pydict(
                {"place": batch.column("place"), "doc_id": batch.column("doc_id"), "label": batch.column("label"), "found": pa.array(found, pa.binary())}
            )

    text = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(sample, "doc_id")
    rows = text.select("place", F.col("doc_id").cast("long"), F.col("label").cast("int"), "text")
    cases = cut(rows.mapInArrow(described, "place long, doc_id long, label int, found binary"))
    return cases.orderBy(F.xxhash64("doc_id", "found"), "doc_id", "found").limit(SAMPLE_ROWS)


def fitted(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The model of a bounded sample of the labelled documents that aren't held out."""

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((p, d, y, f) for b in batches for p, d, y, f in zip(*(b.column(c).to_pylist() for c in ("place", "doc_id", "label", "found"))))
        if rows:
            weights, constant = ftrl([np.frombuffer(r[3], np.int32) for r in rows], [r[2] for r in rows])
            index = np.flatnonzero(weights)
            yield pa.RecordBatch.from_pydict(
                {"index": pa.array([-1, *index.tolist()], pa.int64()), "weight": pa.array([constant, *weights[index].tolist()], pa.float64())}
            )

    found = {r["index"]: r["weight"] for r in sampled(docs, labels).coalesce(1).mapInArrow(learned, "index long, weight double").collect()}
    return Model({i: w for i, w in found.items() if i >= 0}, found[-1]) if found else None


def score_column(model: Model | None, text: Column) -> Column:
    if model is None:
        return F.lit(0.0)
    shared = SparkContext.getOrCreate().broadcast(model)

    @F.arrow_udf(DoubleType())
    def scores(texts: pa.Array) -> pa.Array:
        return pa.array([shared.value.score(t.as_py() or b"") for t in texts], pa.float64())

    return scores(text.cast("binary"))


def scored_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    rows = docs.select("doc_id", score_column(fitted(docs, labels), F.col("text")).alias("score"))
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents of `docs` that the model does not take for toxic."""
    score = score_column(fitted(docs, labels), F.col("text"))
    return docs.filter(score < 0.5)
