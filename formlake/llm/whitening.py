"""Whitening of vectors by shifted Cholesky QR.

The vectors become whole numbers x. Their centred rows A are factored as A = Q R in passes
over the data: a pass sums the Gram matrix of the rows as they are so far (A times the
inverse of R by triangular solves), its Cholesky factor multiplies R from the left, until
the Gram matrix is the identity. The first pass adds the shift that keeps the factor real
whatever the condition of A; later passes need it only where rows span fewer dimensions.
The singular vectors of R are the components, its squared singular values over the
number of rows their variances. Rows stay where they lie: each task sends the Gram matrix of
its rows, the sums of these are the only shuffle, and width squared numbers, whatever the
rows, reach the driver.

Centred values are taken from (n*x - S), whole numbers, so the mean costs no digits however far it
is from zero. Where they could leave 62 bits they are computed as unbounded integers;
numbers beyond 2^62 are held there, deviations beyond a long at its end.

Vectors that are null or hold a null or non-finite component take no part; a shorter vector
counts as filled with zeros (an empty one is all zeros). Rows that repeat count as often as
they stand there; null ids stay. Components without variance (beside the largest, to the
digits of a double) are left out, so vectors that are all equal, or a single one, give no
rows, as does an empty table. Further columns don't matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formlake.llm.nearest import valid

MOST_PASSES = 8
ORTHOGONAL = 1e-11  # largest entry of Gram minus identity at which passes end
NO_VARIANCE = 1e-11  # of the largest singular value
ROUND = np.finfo(np.float64).eps / 2
LONG = (1 << 63) - 1
FAR = float(1 << 62)


class Whitening(NamedTuple):
    """What whitens a row: n, the sums S, components as columns, their variances, and the trace of the covariance."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    trace: float
    passes: int


def whole_numbers(batch: pa.RecordBatch, width: int, scale: int, offset: int) -> np.ndarray:
    """floor(scale * component) + offset as rows of whole numbers: 64-bit, or unbounded where these could overflow."""
    lists = batch.column("embedding")
    sizes = np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    flat = np.clip(np.floor(scale * np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.float64)), -FAR, FAR)
    wide = np.abs(flat).max(initial=0) > 1 << 53
    out = np.full((len(sizes), width), offset, object if wide else np.int64)
    at = np.arange(width)[None, :] < sizes[:, None]
    out[at] = [int(v) + offset for v in flat] if wide else flat.astype(np.int64) + offset
    return out


def times_n(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n*x - S, exact."""
    most = max(int(np.abs(x).max(initial=0)) * n, max(map(abs, sums), default=0))
    if x.dtype != object and most < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def deviations(nx: np.ndarray) -> np.ndarray:
    """Sum of squares of each row, exact, held at the ends of a long."""
    if nx.dtype != object and float(np.abs(nx).max(initial=0)) ** 2 * nx.shape[1] < 1 << 62:
        return (nx * nx).sum(axis=1)
    exact = nx.astype(object)
    return np.array([min(LONG, int(v)) for v in (exact * exact).sum(axis=1)], np.int64)


def moments(rows: DataFrame, width: int, scale: int, offset: int) -> tuple[int, list[int]]:
    """Number of rows and the exact sum of each dimension."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * width
        for batch in batches:
            x = whole_numbers(batch, width, scale, offset)
            n += len(x)
            most = int(np.abs(x).max(initial=0)) * max(1, len(x))
            part = x.sum(axis=0) if x.dtype == object or most < 1 << 62 else x.astype(object).sum(axis=0)
            sums = [a + int(b) for a, b in zip(sums, part)]
        # in two halves of 60 bits, so that sums of sums stay exact decimals
        at = pa.array(range(-1, width), pa.int32())
        values = [n, *sums]
        yield pa.RecordBatch.from_pydict({"i": at, "high": pa.array([v >> 60 for v in values], pa.float64()), "low": pa.array([v & ((1 << 60) - 1) for v in values], pa.int64())})

    parts = rows.select("embedding").mapInArrow(partial, "i int, high double, low long")
    total = parts.groupBy("i").agg(F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low")).collect()
    found = {r["i"]: (int(r["high"]) << 60) + int(r["low"]) for r in total}
    return found.get(-1, 0), [found.get(i, 0) for i in range(width)]


def gram(rows: DataFrame, size: int, rows_of: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """Sum of outer products of the rows that `rows_of` makes of each batch.

    A task holds one matrix; of the tasks' matrices the upper halves are added up by entry.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            a = rows_of(batch)
            total += a.T @ a
        for i in range(size):
            yield pa.RecordBatch.from_pydict({"i": pa.array(np.full(size - i, i, np.int32)), "j": pa.array(np.arange(i, size, dtype=np.int32)), "v": pa.array(total[i, i:])})

    entries = rows.select("embedding").mapInArrow(partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((size, size))
    for r in entries.collect():  # width squared numbers
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"]
    return out


def factor(matrix: np.ndarray, shift: float) -> np.ndarray:
    """Upper Cholesky factor of matrix + shift; the shift grows until there is one."""
    while True:
        try:
            return np.linalg.cholesky(matrix + shift * np.eye(len(matrix))).T
        except np.linalg.LinAlgError:
            shift = max(100 * shift, len(matrix) * ROUND * float(np.trace(matrix)) + np.finfo(np.float64).tiny)


def solve_right(a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """a times the inverse of an upper triangular r, column by column."""
    out = np.array(a, np.float64)
    for j in range(out.shape[1]):
        if j:
            out[:, j] -= out[:, :j] @ r[:j, j]
        out[:, j] /= r[j, j]
    return out


def fit(rows: DataFrame, width: int, most: int, scale: int, offset: int) -> Whitening | None:
    """Components of the covariance of all rows, by falling variance; None where nothing varies."""
    n, sums = moments(rows, width, scale, offset)
    if not n:
        return None

    def centred(batch: pa.RecordBatch) -> np.ndarray:
        return times_n(whole_numbers(batch, width, scale, offset), n, sums).astype(np.float64) / n

    first = gram(rows, width, centred)
    norm = float(np.trace(first))
    if not norm > 0:
        return None
    # dimensions on one scale, so that small ones keep their digits
    scales = np.sqrt(np.where(np.diag(first) > 0, np.diag(first), 1.0))
    g = first / scales[:, None] / scales[None, :]
    shift = 11 * (n * width + width * (width + 1)) * ROUND * float(np.linalg.eigvalsh(g)[-1])
    chain: list[np.ndarray] = []
    total = np.eye(width)
    while True:
        chain.append(factor(g, 0.0 if chain else shift))
        total = chain[-1] @ total

        def orthogonal(batch: pa.RecordBatch, chain: tuple[np.ndarray, ...] = tuple(chain)) -> np.ndarray:
            q = centred(batch) / scales
            for r in chain:
                q = solve_right(q, r)
            return q

        g = gram(rows, width, orthogonal)
        # where the rows span fewer dimensions, the last Gram matrix still tells what is missing
        values, vectors = np.linalg.eigh(g)
        root = (vectors * np.sqrt(np.maximum(values, 0))) @ vectors.T
        _, singular, right = np.linalg.svd(root @ total * scales)
        kept = int((singular > NO_VARIANCE * singular[0]).sum())
        if (np.abs(values - 1) < ORTHOGONAL).sum() >= kept or len(chain) == MOST_PASSES:
            break
    kept = min(most, kept)
    return Whitening(n, sums, right[:kept].T, singular[:kept] ** 2 / n, norm / n, len(chain) + 1)


def whitened(vectors: DataFrame, most: int = 32, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) from (vec_id, embedding)."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = vectors.filter(valid("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    width = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    model = fit(rows, width, most, scale, offset) if width else None
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    n, sums, size = model.n, model.sums, len(model.variances)
    turn = model.components / np.sqrt(model.variances)

    def projected(batch: pa.RecordBatch) -> np.ndarray:
        return (times_n(whole_numbers(batch, width, scale, offset), n, sums).astype(np.float64) / n) @ turn

    error = float(np.abs(gram(rows, size, projected) / n - np.eye(size)).max())
    explained = model.variances / model.trace

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nx = times_n(whole_numbers(batch, width, scale, offset), n, sums)
            white = (nx.astype(np.float64) / n) @ turn
            each = np.repeat(np.arange(len(nx)), size)
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch.column("vec_id").take(pa.array(each)), "component": pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), len(nx))),
                "n": pa.array(np.full(len(each), n, np.int64)), "deviation": pa.array(deviations(nx)[each]), "whitened": pa.array(white.ravel()),
                "explained": pa.array(np.tile(explained, len(nx))), "identity_error": pa.array(np.full(len(each), error)),
            })

    return rows.mapInArrow(out, schema)
