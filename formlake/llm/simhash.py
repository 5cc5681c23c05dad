"""Near-duplicate documents by SimHash fingerprints and a Gray-order hierarchical index.

Two fingerprints of 64 bits that differ in at most four agree in at least one of five
blocks of bits (or in j of j + 4 blocks; j grows with the logarithm of the number of
fingerprints, so groups stay small). Fingerprints meet in groups that agree in such
blocks. Inside a group they are sorted by Gray rank, so neighbours share many bits:
64 neighbours form a leaf, eight nodes an upper node, and every node keeps the bits all
its members share. The join walks pairs of nodes from the top and drops a pair when the
shared bits alone differ more than the limit; only what is left is compared in full.

A group returns each member's smallest linked member, not its pairs, so a large group of
near copies costs its size in rows. Groups beyond GROUP_LIMIT are cut along their Gray
order and every two parts meet in one task, so no task holds more than two parts.

Null and empty texts have no words and the fingerprint 0. Texts of one to three words have
one shingle. Rows that repeat a doc_id and rows with a null one are separate documents; a
component's id is its smallest doc_id that isn't null. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from formlake.llm.common import components, packed, unpacked
from formlake.operators.skew import group_rank
from formlake.session import cut

SHINGLE = 4
SEED = 42
MOST_BITS = 4
GROUP_MEAN = 256
GROUP_LIMIT = 8192
LEAF = 64
FAN = 8
SHINGLES_AT_ONCE = 1 << 16
NODE_PAIRS_AT_ONCE = 1024


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of the word shingles of a UTF-8 text, A-Z lower-cased."""
    words = text.lower().split()
    n = max(1, len(words) - size + 1)
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n]
    ends = ends[min(size, len(words)) - 1 :]
    digest, ones = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, n, SHINGLES_AT_ONCE):
        some = zip(starts[at : at + SHINGLES_AT_ONCE].tolist(), ends[at : at + SHINGLES_AT_ONCE].tolist())
        hashes = np.frombuffer(b"".join([digest(joined[a:z], SEED) for a, z in some]), np.uint8)
        ones += np.unpackbits(hashes).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


@F.arrow_udf(LongType())
def fingerprints(texts: pa.Array) -> pa.Array:
    return pa.array([fingerprint(t.as_py() or b"") for t in texts], pa.int64())


# ---- linked members of one group ------------------------------------------------------


def _merge(roots: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the classes of a[i] and b[i]; `roots` gives every member's smallest known member."""
    while True:
        left, right = roots[a], roots[b]
        apart = left != right
        if not apart.any():
            return roots
        a, b, left, right = a[apart], b[apart], left[apart], right[apart]
        np.minimum.at(roots, np.maximum(left, right), np.minimum(left, right))
        while (further := roots[roots]).tobytes() != roots.tobytes():
            roots = further


def group_roots(codes: np.ndarray, most: int = MOST_BITS) -> np.ndarray:
    """Index of the smallest member that each of `codes` (uint64, in Gray order) reaches."""
    n = len(codes)
    roots = np.arange(n)
    if n <= 2 * LEAF:
        a, b = np.nonzero(np.bitwise_count(codes[:, None] ^ codes[None, :]) <= most)
        return _merge(roots, a[a > b], b[a > b])
    leaves = -(-n // LEAF)
    rows = np.concatenate([codes, np.repeat(codes[-1:], leaves * LEAF - n)]).reshape(leaves, LEAF)
    levels = [(np.bitwise_and.reduce(rows, axis=1), np.bitwise_or.reduce(rows, axis=1))]
    while len(levels[-1][0]) > FAN:
        cuts = np.arange(0, len(levels[-1][0]), FAN)
        levels.append((np.bitwise_and.reduceat(levels[-1][0], cuts), np.bitwise_or.reduceat(levels[-1][1], cuts)))

    def near(level: int, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of nodes, p before q or the same, whose shared bits differ in `most` at most."""
        every, some = levels[level]
        shared = every | ~some
        kept = (p <= q) & (np.bitwise_count((every[p] ^ every[q]) & shared[p] & shared[q]) <= most)
        return p[kept], q[kept]

    def down(level: int, p: np.ndarray, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of leaves below pairs of nodes, a bounded number of pairs at a time."""
        if level == 0:
            yield p, q
            return
        nodes, step = len(levels[level - 1][0]), np.arange(FAN)
        for at in range(0, len(p), NODE_PAIRS_AT_ONCE):
            left = np.repeat(p[at : at + NODE_PAIRS_AT_ONCE, None] * FAN + step, FAN, axis=1).ravel()
            right = np.tile(q[at : at + NODE_PAIRS_AT_ONCE, None] * FAN + step, (1, FAN)).ravel()
            inside = (left < nodes) & (right < nodes)
            yield from down(level - 1, *near(level - 1, left[inside], right[inside]))

    top = len(levels) - 1
    every = np.arange(len(levels[top][0]))
    for p, q in down(top, *near(top, np.repeat(every, len(every)), np.tile(every, len(every)))):
        for at in range(0, len(p), NODE_PAIRS_AT_ONCE):
            left, right = p[at : at + NODE_PAIRS_AT_ONCE], q[at : at + NODE_PAIRS_AT_ONCE]
            pair, i, j = np.nonzero(np.bitwise_count(rows[left][:, :, None] ^ rows[right][:, None, :]) <= most)
            a = np.minimum(left[pair] * LEAF + i, n - 1)
            b = np.minimum(right[pair] * LEAF + j, n - 1)
            roots = _merge(roots, a[a != b], b[a != b])
    return roots


def _group_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): linked codes of each group; rows arrive sorted by group."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    keys = ("pattern", "bits", "low", "high")
    rest: list[np.ndarray] | None = None

    def edges(columns: list[np.ndarray], upto: int, cuts: np.ndarray) -> pa.RecordBatch:
        codes, left, right = columns[-1], [], []
        bounds = np.concatenate([[0], cuts[cuts <= upto], [upto]])
        for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if z - a < 2:
                continue
            group = codes[a:z]
            roots = group_roots(group.view(np.uint64))
            moved = np.flatnonzero(roots != np.arange(z - a))
            if len(moved):
                left.append(group[moved])
                right.append(group[roots[moved]])
        empty = [np.zeros(0, np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(left or empty)), pa.array(np.concatenate(right or empty))], schema=schema)

    for batch in batches:
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in (*keys, "code")]
        if rest is not None:
            columns = [np.concatenate(c) for c in zip(rest, columns)]
        new = np.zeros(max(0, len(columns[0]) - 1), bool)
        for c in columns[:-1]:
            new |= c[1:] != c[:-1]
        cuts = np.flatnonzero(new) + 1
        upto = int(cuts[-1]) if len(cuts) else 0
        if upto:
            yield edges(columns, upto, cuts)
        rest = [c[upto:] for c in columns]
    if rest is not None and len(rest[0]):
        yield edges(rest, len(rest[0]), np.zeros(0, np.int64))


# ---- jobs -----------------------------------------------------------------------------


def masks(n: int, most: int = MOST_BITS) -> list[int]:
    """Signed bit masks: any two codes within `most` bits agree on all bits of at least one."""
    j = 1
    while j < 8 and n >> (64 * j // (most + j)) > GROUP_MEAN:
        j += 1
    edges = [64 * i // (most + j) for i in range(most + j + 1)]
    blocks = [sum(1 << b for b in range(a, z)) for a, z in zip(edges, edges[1:])]
    chosen = [sum(c) for c in combinations(blocks, j)]
    return [m - (1 << 64) if m >> 63 else m for m in chosen]


def gray_rank(code: str):
    """Place of a 64-bit code in Gray order, as a signed number."""
    rank = F.col(code)
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    return rank


def linked_codes(codes: DataFrame) -> DataFrame:
    """(code, root): the smallest code that each distinct code reaches over links."""
    codes = cut(codes.select("code").distinct())
    patterns = F.array(*(F.lit(m) for m in masks(codes.count())))
    keyed = codes.select("code", gray_rank("code").alias("gray"), F.posexplode(patterns).alias("pattern", "mask"))
    keyed = keyed.select("code", "gray", "pattern", F.col("code").bitwiseAND(F.col("mask")).alias("bits"))
    large = cut(keyed.groupBy("pattern", "bits").agg(F.count("*").alias("n")).filter(F.col("n") > GROUP_LIMIT))
    none = F.lit(0).cast("long")
    plain = keyed.join(large, ["pattern", "bits"], "left_anti").withColumns({"low": none, "high": none})
    ranked = group_rank(keyed.join(large, ["pattern", "bits"]), ["pattern", "bits"], [F.col("gray"), F.col("code")], "rank")
    part, last = F.floor((F.col("rank") - 1) / GROUP_LIMIT), F.floor((F.col("n") - 1) / GROUP_LIMIT)
    others = ranked.select(*keyed.columns, part.alias("own"), F.explode(F.sequence(none, last)).alias("other")).filter("own != other")
    split = others.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}).drop("own", "other")
    groups = plain.unionByName(split).repartition("pattern", "bits", "low", "high")
    ordered = groups.sortWithinPartitions("pattern", "bits", "low", "high", "gray").select("pattern", "bits", "low", "high", "code")
    roots = cut(components(ordered.mapInArrow(_group_edges, "a long, b long")))
    return codes.join(roots, codes["code"] == roots["node"], "left").select("code", F.coalesce("root", "code").alias("root"))


def component_of(rows: DataFrame, least) -> DataFrame:
    """(code, component): `least`, an aggregate over the rows of all codes linked to a code."""
    roots = cut(linked_codes(rows))
    best = cut(rows.groupBy("code").agg(least.alias("least")).join(roots, "code").select("root", "least"))
    whole = cut(best.groupBy("root").agg(F.min("least").alias("component")))
    return cut(roots.join(whole, "root").select("code", "component"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document of (doc_id, text): fingerprint and component_id."""
    rows = cut(docs.select("doc_id", fingerprints(F.col("text").cast("binary")).alias("code")))
    found = component_of(rows, F.min("doc_id"))
    hexed = F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint")
    return rows.join(found, "code").select("doc_id", hexed, F.col("component").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents of `docs`, of every component the one with the smallest doc_id (nulls last)."""
    rows = cut(packed(docs).select(
        "_doc", F.monotonically_increasing_id().alias("row"), fingerprints(F.col("_doc.text").cast("binary")).alias("code")
    ))
    own = F.struct(F.col("_doc.doc_id").isNull().alias("unnamed"), F.col("_doc.doc_id"), "row")
    kept = component_of(rows, F.min(own)).select(F.col("component.row").alias("row")).distinct()
    return unpacked(rows.join(kept, "row", "left_semi"), docs)
