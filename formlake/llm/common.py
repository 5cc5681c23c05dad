"""Helpers the operators share: words, hashes, running sums and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formlake.session import cut

BLANK_BYTES = b"\t\n\x0b\x0c\r "
SEGMENT = 1 << 20
_PRIME = 0x9E3779B97F4A7C15
_tables: dict[str, np.ndarray] = {}


# ---- words --------------------------------------------------------------------------


def word_total(text: str) -> Column:
    """Number of runs of bytes other than blank and U+0009 to U+000D; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def byte_table(characters: bytes) -> np.ndarray:
    marked = np.zeros(256, bool)
    marked[np.frombuffer(characters, np.uint8)] = True
    return marked


BLANKS = byte_table(BLANK_BYTES)


def prefix_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd constant and of its inverse modulo 2^64, at least n of each."""
    if "power" not in _tables or len(_tables["power"]) < n:
        size = max(n, SEGMENT)
        for name, base in (("power", _PRIME), ("inverse", pow(_PRIME, -1, 1 << 64))):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _tables[name] = np.multiply.accumulate(factors)
    return _tables["power"], _tables["inverse"]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def spans_of(data: np.ndarray, separates: np.ndarray = BLANKS) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that `separates` does not mark."""
    inside = np.zeros(len(data) + 2, np.int8)
    np.logical_not(separates[data], out=inside[1:-1].view(bool))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def _segments(starts: np.ndarray, ends: np.ndarray) -> Iterator[slice]:
    """Consecutive spans that cover at most SEGMENT bytes, or one longer span."""
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + SEGMENT, side="right")))
        yield slice(at, to)
        at = to


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of `data`, equal for equal bytes wherever they stand.

    The spans are in order and don't overlap. Polynomials come from one running sum
    over each segment, so memory follows the segment, not the text.
    """
    out = np.empty(len(starts), np.uint64)
    for part in _segments(starts, ends):
        low, high = int(starts[part.start]), int(ends[part.stop - 1])
        power, inverse = prefix_powers(high - low + 1)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * power[: high - low], out=sums[1:])
        first = starts[part] - low
        out[part] = (sums[ends[part] - low] - sums[first]) * inverse[first]
    return mixed(out ^ ((ends - starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))


def packed(docs: DataFrame) -> DataFrame:
    """All columns in one struct `_doc`, so that no name of theirs can clash with an operator's own."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"))


def unpacked(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of `docs` from `_doc`."""
    return df.select(*(F.col(f"_doc.`{c}`").alias(c) for c in docs.columns))


# ---- bitmaps ------------------------------------------------------------------------

LEAST_BITS, MOST_BITS = 16, 27
ROW_BITS = 15  # of a row of Spark's bitmap aggregate


def bitmap_of(df: DataFrame, column: str) -> tuple[int, np.ndarray]:
    """(bits, packed bitmap) of 64-bit hashes, addressed by their first `bits` bits.

    The bitmap follows the number of hashes up to 2^27 bits (16 MB), so its size is
    bounded; beyond that it only lets more through.
    """
    n = df.agg(F.approx_count_distinct(column)).first()[0]
    bits = min(MOST_BITS, max(LEAST_BITS, (32 * n).bit_length()))
    bit = F.shiftrightunsigned(column, 64 - bits)
    rows = df.select(F.shiftright(bit, ROW_BITS).alias("row"), bit.bitwiseAND(F.lit((1 << ROW_BITS) - 1)).alias("bit"))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in rows.groupBy("row").agg(F.bitmap_construct_agg("bit").alias("bitmap")).collect():  # at most 2^12 rows of 4 KB
        at = r["row"] << (ROW_BITS - 3)
        out[at : at + 4096] = np.frombuffer(r["bitmap"], np.uint8)
    return bits, out


def in_bitmap(bitmap: np.ndarray, bits: int, hashes: np.ndarray) -> np.ndarray:
    bit = hashes >> np.uint64(64 - bits)
    return (bitmap[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


# ---- order --------------------------------------------------------------------------


def prefix_sum(df: DataFrame, by: list[str], order: list[Column], value: str, name: str) -> DataFrame:
    """Sum of `value` over the rows before each row in a total order within each group.

    Rows are range-partitioned by group and order and written once, so a large group
    lies in many partitions; only one total per partition and group goes further.
    """
    ranged = cut(df.repartitionByRange(*(F.col(c) for c in by), *order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy(*by, "_part").agg(F.sum(value).alias("_n"))
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*by, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    inside = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn(name, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    at = offsets.select(*(F.col(c).alias(f"_{c}_of") for c in [*by, "_part"]), "_o")
    same = [summed[c].eqNullSafe(at[f"_{c}_of"]) for c in [*by, "_part"]]
    return summed.join(at, same).withColumn(name, F.col(name) + F.col("_o")).drop("_part", "_o", *at.columns)


# ---- connected components -----------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of `edges` (a, b) reaches.

    Alternating large-star and small-star rounds. Each round takes one minimum per
    node, combined before the shuffle, and joins it to the edges, so a node with a
    third of all edges is only a skewed join. Every round is written to the shared
    folder; the rounds end when no edge changes.
    """
    pairs = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct())
    before = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = both.filter("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut(large.filter("a != b").distinct())
        lowest = cut(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(lowest, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        pairs = cut(small.unionByName(lowest.select("a", F.col("m").alias("b"))).distinct())
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count_distinct("a")).first()
        if state == before or state[0] == 0:
            break
        before = state
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
