"""Exact top-k by inner product: a Voronoi join of queries and data.

A bounded sample of vectors serves as pivots; every vector belongs to the cell of its
nearest pivot. Summaries of the cells (counts, radii, the smallest distances to the
pivot) go to the driver: their size follows the number of pivots alone. For the queries
of a cell they give a score that the k-th best must reach; a data vector whose distance
to its pivot keeps it below that for all queries of a chunk is not sent there. Chunks of
queries and blocks of data have bounded sizes, so a cell that holds a third of all rows
is many blocks; each meeting of a chunk and a block returns k rows for each query, and a
window merges them.

Vectors that are null or hold a null or non-finite component take no part, nor do rows
without vec_id. A shorter vector counts as filled with zeros. Rows that repeat a vec_id
are separate candidates and separate queries; none is its own id's candidate. Equal
scores go to the smaller vec_id. Scores outside the range of a long are held at its
ends. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formlake.session import cut

PIVOTS = 128
BLOCK_ROWS = 16384
CHUNK_QUERIES = 4096
MOST_REPEATS = 32
SCORES_AT_ONCE = 1 << 22
SMALL = np.iinfo(np.int64).min


def valid(vector: str) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.col(vector).isNotNull() & F.coalesce(fine, F.lit(False))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Packed vectors as rows: 16-bit integers where they fit, else doubles."""
    out = np.zeros((len(column), width))
    for i, value in enumerate(column):
        raw = value.as_py()
        out[i] = np.frombuffer(raw, np.int16 if len(raw) == 2 * width else np.float64)
    return out


def _packed(rows: np.ndarray) -> list[bytes]:
    small = np.abs(rows).max(initial=0) < 1 << 15
    return [r.tobytes() for r in (rows.astype(np.int16) if small else rows)]


def prepared(vectors: DataFrame, scale: int, is_query: Column) -> tuple[DataFrame, int]:
    """(row, vec_id, is_query, v): packed vectors of whole numbers, floor(scale * component); and their width."""
    rows = vectors.filter(valid("embedding") & F.col("vec_id").isNotNull())
    width = max(1, rows.agg(F.max(F.size("embedding"))).first()[0] or 1)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            sizes = np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64)
            flat = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.float64)
            out = np.zeros((len(sizes), width))
            out[np.arange(width)[None, :] < sizes[:, None]] = np.floor(scale * flat)
            yield pa.RecordBatch.from_pydict({
                "row": batch.column("row"), "vec_id": batch.column("vec_id"), "is_query": batch.column("is_query"), "v": pa.array(_packed(out), pa.binary())
            })

    own = rows.select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"),
        F.coalesce(is_query, F.lit(False)).alias("is_query"), F.col("embedding").cast("array<double>").alias("embedding"),
    )
    return cut(own.mapInArrow(whole, "row long, vec_id long, is_query boolean, v binary")), width


def in_cells(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Rows with `cell`, the nearest pivot, `dist`, the distance to it, and `norm`."""
    width, squares = pivots.shape[1], (pivots**2).sum(axis=1)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"), width)
            cell = (squares - 2 * (x @ pivots.T)).argmin(axis=1)
            more = {"cell": pa.array(cell.astype(np.int32)), "dist": pa.array(np.linalg.norm(x - pivots[cell], axis=1)), "norm": pa.array(np.linalg.norm(x, axis=1))}
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in batch.schema.names} | more)

    return rows.mapInArrow(assign, "row long, vec_id long, is_query boolean, v binary, cell int, dist double, norm double")


def _packs(counts: np.ndarray, most: int) -> list[tuple[int, int]]:
    """(first, number) of packs for each cell: small cells share one, large ones own several."""
    out, at, room = [], -1, 0
    for n in counts.tolist():
        if n <= room:
            out.append((at, 1))
            room -= n
        else:
            number = max(1, ceil(n / most))
            out.append((at + 1, number))
            at, room = at + number, (most - n if number == 1 else 0)
    return out


def _least_distances(pivots: np.ndarray, data: dict, queries: dict, k: int, chunks: list[tuple[int, int]]) -> list[tuple[int, int, float]]:
    """(cell, chunk, dist): data of the cell farther than dist from its pivot may matter to the chunk's queries."""
    products, norms = pivots @ pivots.T, np.linalg.norm(pivots, axis=1)
    least: dict[tuple[int, int], float] = {}
    for q, (n, radius, norm) in queries.items():
        if not n:
            continue
        slack = 1e-9 * (1 + norm * (norms.max() + max((d[1] for d in data.values()), default=0.0)))
        low = np.sort(np.concatenate([products[q, c] - radius * norms[c] - norm * np.array(d[2]) for c, d in data.items()]))[::-1]
        bar = low[k - 1] if len(low) >= k else -np.inf
        first, number = chunks[q]
        for c, d in data.items():
            reach = products[q, c] + radius * norms[c] + slack
            dist = -1.0 if reach >= bar else ((bar - reach) / norm if norm else np.inf)
            if dist <= d[1]:
                for chunk in range(first, first + number):
                    least[c, chunk] = min(dist, least.get((c, chunk), np.inf))
    return [(c, chunk, float(dist)) for (c, chunk), dist in least.items()]


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers as longs: in doubles where these are exact."""
    if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1] < 2**53:
        return (q @ x.T).astype(np.int64)
    exact = np.frompyfunc(int, 1, 1)
    sums = np.frompyfunc(lambda s: max(SMALL + 1, min(-SMALL - 1, s)), 1, 1)(exact(q) @ exact(x).T)
    return sums.astype(np.int64)


def _best(q: pa.Table, x: pa.Table, width: int, k: int) -> pa.Table:
    """The k best rows of a block for each query of a chunk."""
    x = x.sort_by([("vec_id", "ascending"), ("row", "ascending")])
    ids, data = x.column("vec_id").to_numpy(), _matrix(x.column("v").combine_chunks(), width)
    q_row, q_id, vectors = q.column("row").to_numpy(), q.column("vec_id").to_numpy(), _matrix(q.column("v").combine_chunks(), width)
    out: list[list[np.ndarray]] = [[], [], [], []]
    n, step = len(ids), max(1, SCORES_AT_ONCE // max(1, len(ids)))
    for at in range(0, len(q_id), step):
        some = slice(at, at + step)
        scores = _scores(vectors[some], data)
        own = q_id[some][:, None] == ids[None, :]
        if np.abs(scores).max(initial=0) < (1 << 62) // max(1, n):  # one number orders by score, then by place
            order = np.where(own, SMALL, scores * n - np.arange(n))
            top = np.argpartition(order, n - k, axis=1)[:, n - k :] if n > k else np.tile(np.arange(n), (len(order), 1))
        else:
            top = np.argsort(np.where(own, np.iinfo(np.int64).max, -scores), axis=1, kind="stable")[:, :k]
        kept = ~np.take_along_axis(own, top, axis=1)
        who = np.broadcast_to(np.arange(len(scores))[:, None], top.shape)[kept]
        out[0].append(q_row[some][who])
        out[1].append(q_id[some][who])
        out[2].append(ids[top[kept]])
        out[3].append(scores[who, top[kept]])
    names = ("row", "query_id", "vec_id", "score")
    return pa.table({c: pa.array(np.concatenate(v or [np.zeros(0, np.int64)]), pa.int64()) for c, v in zip(names, out)})


def _frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def top_k(vectors: DataFrame, is_query: Column, k: int, scale: int) -> DataFrame:
    """(query_id, rank, vec_id, score) from (vec_id, embedding); queries are the rows where `is_query` holds."""
    spark = vectors.sparkSession
    rows, width = prepared(vectors, scale, is_query)
    sample = rows.select("v", F.xxhash64("vec_id").alias("h"), "vec_id", "row").orderBy("h", "vec_id", "row").limit(PIVOTS).collect()
    if not sample:
        return _frame(spark, [], "query_id long, rank int, vec_id long, score long")
    pivots = np.unique(_matrix(pa.array([bytes(r["v"]) for r in sample], pa.binary()), width), axis=0)
    placed = cut(in_cells(rows, pivots))
    repeats = placed.groupBy("vec_id").count().agg(F.max("count")).first()[0]
    near = k + min(repeats, MOST_REPEATS)
    closest = Window.partitionBy("cell").orderBy("dist")
    short = placed.select("cell", "dist").withColumn("n", F.row_number().over(closest)).filter(F.col("n") <= near)
    nearest = {r["cell"]: r["d"] for r in short.groupBy("cell").agg(F.collect_list("dist").alias("d")).collect()}
    figures = placed.groupBy("cell").agg(
        F.count("*").alias("n"), F.max("dist").alias("radius"), F.count_if("is_query").alias("nq"),
        F.max(F.when(F.col("is_query"), F.col("dist"))).alias("rq"), F.max(F.when(F.col("is_query"), F.col("norm"))).alias("norm"),
    ).collect()
    counts, asked = np.zeros(len(pivots), np.int64), np.zeros(len(pivots), np.int64)
    data, queries = {}, {}
    for r in figures:
        counts[r["cell"]], asked[r["cell"]] = r["n"], r["nq"]
        data[r["cell"]] = (r["n"], r["radius"], nearest[r["cell"]])
        queries[r["cell"]] = (r["nq"], r["rq"] or 0.0, r["norm"] or 0.0)
    blocks, chunks = _packs(counts, BLOCK_ROWS), _packs(asked, CHUNK_QUERIES)
    wanted = near if repeats <= MOST_REPEATS else int(counts.sum()) + 1
    needs = _least_distances(pivots, data, queries, wanted, chunks)
    meetings = sorted({(chunk, b) for c, chunk, _ in needs for b in range(blocks[c][0], blocks[c][0] + blocks[c][1])})
    deal = lambda packs: _frame(spark, [(c, *p) for c, p in enumerate(packs)], "cell int, first int, number int")
    spread = (F.col("first") + F.pmod(F.xxhash64("row"), F.col("number"))).cast("int")

    x = placed.join(deal(blocks), "cell").select("row", "vec_id", "v", "cell", "dist", spread.alias("block"))
    x = x.join(_frame(spark, needs, "cell int, chunk int, least double"), "cell").filter("dist >= least")
    q = placed.filter("is_query").join(deal(chunks), "cell").select("row", "vec_id", "v", spread.alias("chunk"))
    q = q.join(_frame(spark, meetings, "chunk int, block int"), "chunk")
    keys, own = ["chunk", "block"], ["row", "vec_id", "v"]

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        return _best(left, right, width, k)

    q = q.select(*(F.col(c).alias(c) for c in [*keys, *own]))  # new names: both sides come from one table
    met = q.groupBy(*keys).cogroup(x.select(*keys, *own).groupBy(*keys)).applyInArrow(
        task, "row long, query_id long, vec_id long, score long"
    )
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id")
    ranked = met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
