"""Scoring every query against a whole gallery without emitting query-gallery pairs.

Queries and gallery are both cut into hash blocks of bounded size. Each task gets
one query block and one gallery block, scores them with numpy, and returns only
what the caller keeps: k rows, or one row of counts, per query and gallery block.
Partial results are merged by an ordinary aggregate or window.

A block is bounded by the targets below whatever the data size, so no task grows
with the data; the gallery is copied once per query block and the reverse, which
is why the number of blocks follows the checked sizes of both sides, and why blocks
are as large as a task's memory allows. Scores are held for a few queries at a time, so
memory follows the blocks and not their product.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

IDS_PER_BLOCK = 32_768
ITEMS_PER_BLOCK = 2_000_000
SCORES_AT_ONCE = 1 << 22  # doubles of one matrix of scores
LEAST_QUERIES, MOST_QUERIES = 64, 4096  # scored together, as the gallery block is prepared for them
PAIRS_PER_CHUNK = 4_000_000
DENSE_SHARE = 0.001
DENSE_DIGITS = 9
FIRST_ROWS = 2048  # scored together in single precision; the first of them set the bars
PRODUCTS_AT_ONCE = 1 << 16  # in full
SINGLE_STEP = 2.0**-23  # of a sum in single precision, twice its rounding
ARROW_TYPES = {
    "long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(),
}


def block_count(sizes: DataFrame, ids_per_block: int = IDS_PER_BLOCK) -> int:
    """Blocks needed for a frame of one row (`ids`, `items`): number of ids, total of their items."""
    ids, items = sizes.select("ids", "items").first()
    return max(1, ceil((ids or 0) / ids_per_block), ceil((items or 0) / ITEMS_PER_BLOCK))


def spread(spark: SparkSession, n_query: int, n_gallery: int) -> int:
    """More query blocks when there are fewer block pairs than task slots."""
    slots = 2 * spark.sparkContext.defaultParallelism
    return max(n_query, ceil(slots / n_gallery))


def fresh(df: DataFrame) -> DataFrame:
    """The frame with its columns renamed onto themselves, for sides that may come from one frame."""
    return df.select(*(F.col(c).alias(c) for c in df.columns))


def score_blocks(
    queries: DataFrame,
    gallery: DataFrame,
    n_query: int,
    n_gallery: int,
    score: Callable[[pa.Table, pa.Table], pa.Table],
    schema: str,
    query_id: str = "query_id",
    gallery_id: str = "doc_id",
) -> DataFrame:
    """Run `score(queries, gallery block)` on every pair of blocks, rows in id order, a query block in parts.

    Both frames have one row per id. `score` returns rows of each query apart from the others.
    """
    n_query = spread(queries.sparkSession, n_query, n_gallery)

    def block(column: str, n: int):
        return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")

    def copies(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    tasks = n_query * n_gallery
    q = queries.withColumn("qb", block(query_id, n_query)).withColumn("gb", copies(n_gallery))
    g = fresh(gallery).withColumn("gb", block(gallery_id, n_gallery)).withColumn("qb", copies(n_query))
    fields = pa.schema([(n, ARROW_TYPES[t]) for n, t in (c.split() for c in schema.split(", "))])

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return fields.empty_table()
        return in_parts(score, *with_codes(ordered(left, query_id), ordered(right, gallery_id)), fields)

    return (
        q.repartition(tasks, "qb", "gb")
        .groupBy("qb", "gb")
        .cogroup(g.repartition(tasks, "qb", "gb").groupBy("qb", "gb"))
        .applyInArrow(task, schema)
    )


# ---- kernels: numpy on one block pair -------------------------------------------------


def in_parts(score: Callable[[pa.Table, pa.Table], pa.Table], q: pa.Table, g: pa.Table, fields: pa.Schema) -> pa.Table:
    """`score` of a few queries at a time with the whole gallery block."""
    step = min(MOST_QUERIES, max(LEAST_QUERIES, SCORES_AT_ONCE // g.num_rows))
    return pa.concat_tables([score(q.slice(at, step), g).cast(fields) for at in range(0, q.num_rows, step)])


def column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def ordered(table: pa.Table, id_col: str) -> pa.Table:
    """Rows of a block in id order; a block has one row per id."""
    return table.take(np.argsort(column(table, id_col), kind="stable"))


def with_codes(q: pa.Table, g: pa.Table, name: str = "tokens") -> tuple[pa.Table, pa.Table]:
    """Both tables with their tokens, if they have any, as numbers of one dictionary: text is compared once for a pair of blocks."""
    if name not in q.column_names or name not in g.column_names:
        return q, g
    lists = [t.column(name).combine_chunks() for t in (q, g)]
    codes = pa.concat_arrays([a.flatten() for a in lists]).dictionary_encode().indices
    out, at = [], 0
    for table, a in zip((q, g), lists):
        counts = np.asarray(a.value_lengths().to_numpy(zero_copy_only=False), np.int64)
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int64())
        own = pa.LargeListArray.from_arrays(offsets, codes.slice(at, int(counts.sum())))
        out.append(table.set_column(table.column_names.index(name), name, own))
        at += int(counts.sum())
    return out[0], out[1]


def sparse_scores(q: pa.Table, g: pa.Table) -> np.ndarray:
    """Sum over shared tokens of query weight x gallery weight, for all rows of both blocks.

    Each row holds the arrays `tokens` and `weights`. Tokens present in many rows go
    through a matrix product, rare ones through expanded index pairs, in chunks of
    bounded size.
    """
    (q_row, q_tok, q_w), (g_row, g_tok, g_w) = (_entries(t) for t in (q, g))
    codes = pa.concat_arrays([q_tok, g_tok]).dictionary_encode()
    n_q, n_g, n_tokens = q.num_rows, g.num_rows, max(1, len(codes.dictionary))
    code = codes.indices.to_numpy().astype(np.int64)
    q_code, g_code = code[: len(q_row)], code[len(q_row) :]
    pairs = np.bincount(q_code, minlength=n_tokens) * np.bincount(g_code, minlength=n_tokens)
    scores = np.zeros((n_q, n_g))

    common = np.flatnonzero(pairs > DENSE_SHARE * n_q * n_g)
    slot = np.full(n_tokens, -1)
    for start in range(0, len(common), 512):
        chosen = common[start : start + 512]
        slot[:] = -1
        slot[chosen] = np.arange(len(chosen))
        left, right = np.zeros((n_q, len(chosen))), np.zeros((n_g, len(chosen)))
        for cells, rows, tokens, weights in ((left, q_row, q_code, q_w), (right, g_row, g_code, g_w)):
            at = slot[tokens]
            hit = at >= 0
            cells[rows[hit], at[hit]] = weights[hit]
        scores += left @ right.T

    rare = pairs > 0
    rare[common] = False
    theirs = np.flatnonzero(rare[g_code])
    theirs = theirs[np.argsort(g_code[theirs], kind="stable")]
    first = np.searchsorted(g_code[theirs], np.arange(n_tokens + 1))
    mine = np.flatnonzero(rare[q_code])
    fan = first[q_code[mine] + 1] - first[q_code[mine]]
    ends = np.cumsum(fan)
    begin = 0
    while begin < len(mine):
        base = ends[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(ends, base + PAIRS_PER_CHUNK, side="right")))
        part, n = mine[begin:stop], fan[begin:stop]
        owner = np.repeat(np.arange(len(part)), n)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        target = theirs[first[q_code[part]][owner] + inside]
        low, high = q_row[part[0]], q_row[part[-1]] + 1
        flat = (q_row[part][owner] - low) * n_g + g_row[target]
        scores[low:high] += np.bincount(flat, q_w[part][owner] * g_w[target], (high - low) * n_g).reshape(high - low, n_g)
        begin = stop
    return scores


def _entries(table: pa.Table) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Row number, token and weight of every array element of a block, in row order."""
    tokens, weights = (table.column(c).combine_chunks() for c in ("tokens", "weights"))
    counts = np.asarray(tokens.value_lengths().to_numpy(zero_copy_only=False))
    flat = np.asarray(weights.flatten().to_numpy(zero_copy_only=False), dtype=float)
    return np.repeat(np.arange(len(tokens)), counts), tokens.flatten(), flat


def matrix(table: pa.Table, name: str) -> np.ndarray:
    """Array column of equal lengths as a matrix."""
    values = table.column(name).combine_chunks()
    flat = np.asarray(values.flatten().to_numpy(zero_copy_only=False), dtype=float)
    return flat.reshape(len(values), -1)


def dense_scores(q: pa.Table, g: pa.Table, vector: str = "vector") -> np.ndarray:
    """Inner products of two vector blocks, rounded so that equal vectors tie."""
    return np.round(matrix(q, vector) @ matrix(g, vector).T, DENSE_DIGITS)


def top_rows(q_ids: np.ndarray, g_ids: np.ndarray, scores: np.ndarray, k: int, query_id: str, gallery_id: str) -> pa.Table:
    """Best k of the block per query; equal scores in gallery order. Only scores that reach the k-th are sorted."""
    n, known = scores.shape[1], np.where(np.isnan(scores), -np.inf, scores)
    bars = np.partition(known, n - k, axis=1)[:, n - k] if k < n else known.min(axis=1, initial=np.inf)
    row, place = np.nonzero(known >= bars[:, None])
    order = np.lexsort((place, -known[row, place], row))
    first = np.searchsorted(row, np.arange(len(scores)))
    best = order[np.arange(len(row)) - first[row] < k]
    return pa.table({query_id: q_ids[row[best]], gallery_id: g_ids[place[best]], "score": scores[row[best], place[best]]})


def dense_top_rows(q: pa.Table, g: pa.Table, k: int, query_id: str, gallery_id: str, vector: str = "vector") -> pa.Table:
    """`top_rows` of `dense_scores`. All products are made in single precision; in full only those that their error and the k-th best of the
    first rows leave open."""
    ids, asked, held = (column(q, query_id), column(g, gallery_id)), matrix(q, vector), matrix(g, vector)
    n = len(held)
    lengths = [np.linalg.norm(x, axis=1).max(initial=0) for x in (asked, held)]
    error = lengths[0] * lengths[1] * (asked.shape[1] + 4) * SINGLE_STEP + 10.0**-DENSE_DIGITS
    if n <= k or not len(asked) or not 0 < error < 1e30:  # else too long for single precision, or not numbers
        return top_rows(*ids, dense_scores(q, g, vector), k, query_id, gallery_id)
    single, short = asked.astype(np.float32), held.astype(np.float32)
    step, open_ = max(FIRST_ROWS, k), []
    for at in range(0, n, step):
        near = single @ short[at : at + step].T
        if not at:
            width = near.shape[1]
            bars = (np.partition(near, width - k, axis=1)[:, width - k].astype(np.float64) - 2 * error).astype(np.float32)
            bars = np.nextafter(bars, np.float32(-np.inf))[:, None]
        open_.append(np.add(np.divmod(np.flatnonzero(near >= bars), near.shape[1]), [[0], [at]]))
    row, place = np.concatenate(open_, axis=1)
    scores = np.empty(len(row))
    for at in range(0, len(row), PRODUCTS_AT_ONCE):
        some = slice(at, at + PRODUCTS_AT_ONCE)
        scores[some] = np.einsum("ij,ij->i", asked[row[some]], held[place[some]])
    scores = np.round(scores, DENSE_DIGITS)
    order = np.lexsort((place, -scores, row))
    row, place, scores = row[order], place[order], scores[order]
    best = np.arange(len(row)) - np.searchsorted(row, row) < k
    return pa.table({query_id: ids[0][row[best]], gallery_id: ids[1][place[best]], "score": scores[best]})


def rank_rows(q: pa.Table, g_ids: np.ndarray, scores: np.ndarray, truth_score: np.ndarray, query_id: str) -> pa.Table:
    """Per query: documents above the truth score, ties before the truth, and the block's best."""
    bar = truth_score[:, None]
    place = np.searchsorted(g_ids, column(q, "truth_id"))[:, None]
    first = scores.argmax(axis=1)
    return pa.table(
        {
            query_id: column(q, query_id),
            "truth_id": column(q, "truth_id"),
            "above": (scores > bar).sum(axis=1),
            "ties_before": ((scores == bar) & (np.arange(len(g_ids))[None, :] < place)).sum(axis=1),
            "best_id": g_ids[first],
            "best_score": scores[np.arange(len(scores)), first],
        }
    )


def margin_rows(q_ids: np.ndarray, scores: np.ndarray, q_labels: np.ndarray, g_labels: np.ndarray, query_id: str) -> pa.Table:
    """Per query: best score of the block with its own label, and with any other."""
    same = q_labels[:, None] == g_labels[None, :]
    worst = -np.inf
    return pa.table(
        {
            query_id: q_ids,
            "positive": np.where(same, scores, worst).max(axis=1),
            "negative": np.where(same, worst, scores).max(axis=1),
        }
    )
