"""Template retrieval: BM25, dense cosine, hybrid, fusion, multi-vector and label vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formlake.functions import arrays
from formlake.functions.text import blank_to_null, tokenize
from formlake.operators import blockmax, blocks
from formlake.operators.skew import join_on_counted_key
from formlake.session import cut

# fixed values of the ranking function
K1, B = 1.5, 0.75
TINY = 1e-12

# Weights sit on a 1e-6 grid, as whole numbers. Their sums are exact in any order,
# so equal documents tie exactly and a re-run task returns the same ranking.
GRID = 1_000_000
DENSE_DIGITS = blocks.DENSE_DIGITS
SINGLE_ERROR = 2.0**-22  # of a product in single precision, more than its rounding
LABEL_GRID = 10_000_000
VECTORS_AT_ONCE, SETS_AT_ONCE = 256, 256  # query vectors and documents whose products are made together
FEW_VECTORS = 64
SET_BLOCK = 8_192  # documents of a block of sets
SIGNED_IDS, SIGNED_ITEMS = 131_072, 8_000_000  # vectors of a signature in a block, and their numbers


# ---- BM25 -----------------------------------------------------------------------------


def term_arrays(docs: DataFrame, id_col: str = "doc_id", words: str = "words") -> DataFrame:
    """(id, doc_len, tokens, weights): distinct tokens of each document with their counts.

    Counted inside the row, as run lengths of the sorted tokens: no shuffle.
    """

    def counted(s: Column) -> Column:
        starts = F.filter(arrays.indexes(F.size(s)), lambda i: F.coalesce(F.get(s, i) != F.get(s, i - 1), F.lit(True)))

        def runs(at: Column) -> Column:
            lengths = F.transform(at, lambda i, j: (F.coalesce(F.get(at, j + 1), F.size(s)) - i).cast("long"))
            return F.struct(F.size(s).alias("doc_len"), F.transform(at, lambda i: F.get(s, i)).alias("tokens"), lengths.alias("weights"))

        return arrays.bind(starts, runs)

    found = arrays.bind(F.sort_array(tokenize(F.col(words))), counted)
    return docs.select(id_col, found.alias("t")).select(id_col, "t.*")


def term_rows(terms: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The arrays of `term_arrays` as rows (id, doc_len, token, tf)."""
    rows = arrays.each(terms, [id_col, "doc_len"], F.arrays_zip("tokens", "weights"), "t")
    return rows.select(id_col, "doc_len", F.col("t.tokens").alias("token"), F.col("t.weights").alias("tf"))


def term_counts(docs: DataFrame, id_col: str = "doc_id", words: str = "words") -> DataFrame:
    """(id, doc_len, token, tf)."""
    return term_rows(term_arrays(docs, id_col, words), id_col)


def gallery_sizes(docs: DataFrame, words: str = "words") -> DataFrame:
    """One row: number of documents and of their words."""
    return docs.agg(F.count("*").alias("ids"), F.sum(F.size(words)).alias("items"))


def bm25_postings(docs: DataFrame, id_col: str = "doc_id", words: str = "words") -> DataFrame:
    """(id, token, weight): BM25 weights as whole millionths."""
    return weighted_terms(cut(term_arrays(docs, id_col, words)), id_col)


def weighted_terms(terms: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, token, weight) of written term arrays: document frequencies are written once too, as both are read several times."""
    tf = term_rows(terms, id_col)
    df = cut(tf.groupBy("token").agg(F.count("*").alias("df")))
    n, total = terms.agg(F.count("*"), F.sum("doc_len")).first()
    mean_len = max((total or 0) / max(n, 1), TINY)
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf_part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / mean_len))
    joined = join_on_counted_key(tf, df, "token", "df", id_col)
    return joined.select(id_col, "token", F.round(idf * tf_part * GRID).cast("long").alias("weight"))


def score_pairs(pairs: DataFrame, queries: DataFrame, postings: DataFrame, query_id: str = "query_id", doc_id: str = "doc_id") -> DataFrame:
    """BM25 score of given (query, document) pairs; 0 when nothing is shared. `queries` are term arrays."""
    hits = (
        pairs.join(term_rows(queries, query_id).select(query_id, "token", "tf"), query_id)
        .join(postings, [doc_id, "token"])
        .groupBy(query_id, doc_id)
        .agg(F.sum(F.col("tf") * F.col("weight")).alias("units"))
    )
    return pairs.join(hits, [query_id, doc_id], "left").withColumn("units", F.coalesce("units", F.lit(0)))


def pack(weights: DataFrame, id_col: str, weight: str = "weight") -> DataFrame:
    """One row per id with aligned arrays `tokens` and `weights`.

    The terms of a document fit a row because its words came in one.
    """
    return weights.groupBy(id_col).agg(F.collect_list("token").alias("tokens"), F.collect_list(weight).alias("weights"))


def bm25_topk(queries: DataFrame, postings: DataFrame, k: int, n_query: int, n_gallery: int, query_id: str = "query_id", doc_id: str = "doc_id") -> DataFrame:
    """(query, document, units, position) of the k best; documents sharing no token fill up with 0."""

    def score(q: pa.Table, g: pa.Table) -> pa.Table:
        ids = (blocks.column(q, query_id), blocks.column(g, doc_id))
        return blocks.top_rows(*ids, blocks.sparse_scores(q, g), k, query_id, doc_id)

    kinds = (_type(queries, query_id), _type(postings, doc_id))
    partial = blocks.score_blocks(
        queries.select(query_id, "tokens", "weights"), pack(postings, doc_id), n_query, n_gallery, score,
        f"{query_id} {kinds[0]}, {doc_id} {kinds[1]}, score double", query_id, doc_id,
    )
    return keep_top(partial, k, query_id, doc_id).withColumn("units", F.col("score").cast("long")).drop("score")


def bm25_ranks(queries: DataFrame, postings: DataFrame, truth: DataFrame, n_query: int, query_id: str = "query_id", doc_id: str = "doc_id") -> DataFrame:
    """Rank of the true document per query, ordinal and optimistic, and the best match.

    `truth`: (query, document). The truth scores come from an equi-join first; only blocks of documents
    that can reach them are scored (`blockmax`) and count what beats them.
    """
    index = blockmax.indexed(postings, doc_id)
    known = cut(blockmax.with_bars(queries.select(query_id, "tokens", "weights"), truth, index, query_id, doc_id))
    return merge_ranks(blockmax.ranked(known, index, query_id, _type(postings, doc_id)), query_id)


# ---- dense ----------------------------------------------------------------------------


def normalize(vector: Column, guard: str = "floor") -> Column:
    """Unit vector. `floor` divides by max(norm, 1e-12); `skip` leaves zero vectors as they are."""
    doubles = F.transform(vector, lambda v: v.cast("double"))

    def scaled(length: Column) -> Column:
        size = F.greatest(length, F.lit(TINY)) if guard == "floor" else F.when(length > 0, length).otherwise(F.lit(1.0))
        return F.transform(doubles, lambda v: v / size)

    return arrays.bind(arrays.norm(doubles), scaled)


def pool_and_fit(token_vectors: Column, dim: int = 128) -> Column:
    """Mean of token vectors, cut or zero-padded to `dim`, then normalised."""
    n = F.size(token_vectors)
    width = F.size(F.get(token_vectors, F.lit(0)))
    mean = F.transform(
        arrays.indexes(width),
        lambda i: F.aggregate(token_vectors, F.lit(0.0), lambda acc, v: acc + F.get(v, i).cast("double")) / n,
    )
    padded = F.slice(F.concat(mean, F.array_repeat(F.lit(0.0), dim)), 1, dim)
    return normalize(padded, guard="skip")


def dense_topk(queries: DataFrame, gallery: DataFrame, k: int, n_query: int, n_gallery: int, query_id: str = "query_id", doc_id: str = "doc_id") -> DataFrame:
    """Exact cosine top-k of unit vectors (column `vector` on both sides)."""

    def score(q: pa.Table, g: pa.Table) -> pa.Table:
        return blocks.dense_top_rows(q, g, k, query_id, doc_id)

    schema = f"{query_id} {_type(queries, query_id)}, {doc_id} {_type(gallery, doc_id)}, score double"
    partial = blocks.score_blocks(queries, gallery, n_query, n_gallery, score, schema, query_id, doc_id)
    return keep_top(partial, k, query_id, doc_id)


def dense_ranks(queries: DataFrame, gallery: DataFrame, n_query: int, n_gallery: int) -> DataFrame:
    """Rank of `truth_id` per query (query_id, truth_id, vector) in a gallery (doc_id, vector)."""
    target = gallery.select(F.col("doc_id").alias("truth_id"), F.col("vector").alias("gv"))
    bar = F.round(arrays.dot(F.col("vector"), F.col("gv")), DENSE_DIGITS)
    known = queries.join(target, "truth_id").withColumn("truth_score", bar).drop("gv")

    def score(q: pa.Table, g: pa.Table) -> pa.Table:
        return blocks.rank_rows(q, blocks.column(g, "doc_id"), blocks.dense_scores(q, g), blocks.column(q, "truth_score"), "query_id")

    schema = rank_schema(queries, gallery, "query_id", "doc_id")
    return merge_ranks(blocks.score_blocks(known, gallery, n_query, n_gallery, score, schema), "query_id")


def dense_margins(queries: DataFrame, gallery: DataFrame, n_query: int, n_gallery: int) -> DataFrame:
    """Best score with the query's label and best score with another (column `label` on both sides)."""

    def score(q: pa.Table, g: pa.Table) -> pa.Table:
        labels = (blocks.column(q, "label"), blocks.column(g, "label"))
        return blocks.margin_rows(blocks.column(q, "query_id"), blocks.dense_scores(q, g), *labels, "query_id")

    schema = f"query_id {_type(queries, 'query_id')}, positive double, negative double"

    def best(c: str) -> Column:
        top = F.max(c)
        return F.when(top > float("-inf"), top)

    return (
        blocks.score_blocks(queries, gallery, n_query, n_gallery, score, schema)
        .groupBy("query_id")
        .agg(best("positive").alias("positive_score"), best("negative").alias("negative_score"))
    )


def lsh_topk(queries: DataFrame, gallery: DataFrame, k: int, tables: int = 8, bits: int = 6, seed: int = 7) -> DataFrame:
    """Approximate cosine top-k: queries meet only gallery vectors of an equal signature.

    A signature is the sides of `bits` random planes a vector lies on, one per table.
    The vectors of a signature are scored in blocks, more blocks the more there are,
    so a crowded signature is spread over tasks and no pairs are emitted. Signature
    counts are at most tables * 2**bits rows, which bounds what is broadcast.
    """
    planes = BucketedRandomProjectionLSH(
        inputCol="features", outputCol="hashes", bucketLength=4.0, numHashTables=tables * bits, seed=seed
    ).fit(gallery.select(array_to_vector(F.col("vector")).alias("features")))

    def signed(df: DataFrame, id_col: str) -> DataFrame:
        hashed = planes.transform(df.withColumn("features", array_to_vector(F.col("vector"))))
        # on unit vectors and buckets of length 4 a hash is 0 or -1: the side of its plane
        sides = F.transform("hashes", lambda h: vector_to_array(h)[0].cast("string"))
        parts = F.transform(
            arrays.indexes(F.lit(tables)), lambda t: F.concat(t.cast("string"), F.lit("|"), F.array_join(F.slice("sides", t * bits + 1, bits), ""))
        )
        return arrays.each(hashed.withColumn("sides", sides), [id_col, "vector"], parts, "bucket")

    q, g = signed(queries, "query_id"), signed(blocks.fresh(gallery), "doc_id")

    def counts(df: DataFrame, name: str) -> DataFrame:
        # a vector is copied for every table and every block of the other side, so blocks are large
        n = F.ceil(F.greatest(F.count("*") / SIGNED_IDS, F.sum(F.size("vector")) / SIGNED_ITEMS)).cast("int")
        return df.groupBy("bucket").agg(n.alias(name))

    sizes = F.broadcast(counts(q, "n_q").join(counts(g, "n_g"), "bucket"))

    def dealt(df: DataFrame, id_col: str, own: str, other: str, n_own: str, n_other: str) -> DataFrame:
        placed = df.join(sizes, "bucket").withColumn(own, F.pmod(F.xxhash64(id_col), F.col(n_own)).cast("int"))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(n_other) - 1))).drop("n_q", "n_g")

    fields = pa.schema([
        ("query_id", blocks.ARROW_TYPES[_type(queries, "query_id")]), ("doc_id", blocks.ARROW_TYPES[_type(gallery, "doc_id")]), ("score", pa.float64()),
    ])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return fields.empty_table()
        return blocks.in_parts(best, blocks.ordered(left, "query_id"), blocks.ordered(right, "doc_id"), fields)

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        return blocks.dense_top_rows(left, right, k, "query_id", "doc_id")

    keys = ["bucket", "qb", "gb"]
    near = (
        dealt(q, "query_id", "qb", "gb", "n_q", "n_g").groupBy(*keys)
        .cogroup(dealt(g, "doc_id", "gb", "qb", "n_g", "n_q").groupBy(*keys))
        .applyInArrow(score, f"query_id {_type(queries, 'query_id')}, doc_id {_type(gallery, 'doc_id')}, score double")
    )
    return keep_top(near.groupBy("query_id", "doc_id").agg(F.max("score").alias("score")), k)


def coded(vectors: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, code, scale, off): vectors as 8-bit codes, an eighth of their doubles; `off` is the norm of what scale * code leaves out."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = blocks.matrix(pa.table(batch), "vector")
            scale = np.maximum(np.abs(x).max(axis=1, initial=0), TINY) / 127
            codes = np.rint(x / scale[:, None]).astype(np.int8)
            off = np.linalg.norm(x - codes * scale[:, None], axis=1)
            rows = pa.array([c.tobytes() for c in codes], pa.binary())
            yield pa.RecordBatch.from_pydict({id_col: batch.column(id_col), "code": rows, "scale": pa.array(scale), "off": pa.array(off)})

    return vectors.select(id_col, "vector").mapInArrow(code, f"{id_col} {_type(vectors, id_col)}, code binary, scale double, off double")


def coded_candidates(queries: DataFrame, codes: DataFrame, k: int, n_query: int, n_gallery: int) -> DataFrame:
    """(query_id, doc_id): the documents that can be among the k best by what the codes tell, all k best among them.

    The inner product with a code is off by at most the query's norm times `off`. A block of codes
    keeps what its k-th best lower bound leaves open, and so does the merge over all blocks.
    """

    def score(q: pa.Table, g: pa.Table) -> pa.Table:
        asked = blocks.matrix(q, "vector")
        stored = np.frombuffer(b"".join(g.column("code").to_pylist()), np.int8).reshape(g.num_rows, -1)
        near = (asked.astype(np.float32) @ stored.astype(np.float32).T) * blocks.column(g, "scale")[None, :]
        norms = np.linalg.norm(asked, axis=1)[:, None]
        spread = norms * (blocks.column(g, "off") + SINGLE_ERROR * blocks.column(g, "scale") * 127 * stored.shape[1])[None, :] + 10.0**-DENSE_DIGITS
        low = near - spread
        bar = np.partition(low, -k, axis=1)[:, -k] if g.num_rows > k else np.full(q.num_rows, -np.inf)
        i, j = np.nonzero(near + spread >= bar[:, None])
        return pa.table({"query_id": blocks.column(q, "query_id")[i], "doc_id": blocks.column(g, "doc_id")[j], "low": low[i, j], "high": (near + spread)[i, j]})

    schema = f"query_id {_type(queries, 'query_id')}, doc_id {_type(codes, 'doc_id')}, low double, high double"
    return _open_pairs(cut(blocks.score_blocks(queries.select("query_id", "vector"), codes, n_query, n_gallery, score, schema)), k)


def _open_pairs(found: DataFrame, k: int) -> DataFrame:
    """Of (query_id, doc_id, low, high) the pairs that can reach the query's k-th best lower bound."""
    best = Window.partitionBy("query_id").orderBy(F.desc("low"))
    bars = found.withColumn("n", F.row_number().over(best)).filter(F.col("n") == k).select("query_id", F.col("low").alias("bar"))
    return found.join(bars, "query_id", "left").filter(F.coalesce(F.col("high") >= F.col("bar"), F.lit(True))).select("query_id", "doc_id")


def coded_topk(queries: DataFrame, gallery: DataFrame, k: int, n_query: int, n_gallery: int) -> DataFrame:
    """Exact cosine top-k of unit vectors: codes are scanned instead of doubles, and only what they leave open is scored."""
    open_ = coded_candidates(queries, cut(coded(gallery)), k, n_query, n_gallery)
    scored = (
        open_.join(queries.select("query_id", F.col("vector").alias("qv")), "query_id")
        .join(blocks.fresh(gallery).select("doc_id", F.col("vector").alias("gv")), "doc_id")
        .select("query_id", "doc_id", F.round(arrays.dot(F.col("qv"), F.col("gv")), DENSE_DIGITS).alias("score"))
    )
    return keep_top(scored, k)


def _unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(first vector of each row and one past the last, all vectors) of the arrays of arrays in `vectors`."""
    lists = table.column("vectors").combine_chunks()
    counts = np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False))
    inner = lists.flatten()
    flat = np.asarray(inner.flatten().to_numpy(zero_copy_only=False), dtype=float).reshape(len(inner), -1 if len(inner) else 1)
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64), flat


def coded_sets(gallery: DataFrame) -> DataFrame:
    """(doc_id, n, code, scale, off): each document's vectors as 8-bit codes of one scale; `off` is the largest norm that a vector loses."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, flat = _unpacked(pa.table(batch))
            codes, scales, offs = [], np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for i, (first, last) in enumerate(zip(at, at[1:])):
                x = flat[first:last]
                scales[i] = max(np.abs(x).max(initial=0), TINY) / 127
                c = np.rint(x / scales[i]).astype(np.int8)
                offs[i] = np.linalg.norm(x - c * scales[i], axis=1).max(initial=0)
                codes.append(c.tobytes())
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n": pa.array(np.diff(at)), "code": pa.array(codes, pa.binary()), "scale": pa.array(scales), "off": pa.array(offs)
            })

    return gallery.select("doc_id", "vectors").mapInArrow(code, f"doc_id {_type(gallery, 'doc_id')}, n long, code binary, scale double, off double")


def _best_sums(q_at: np.ndarray, q_flat: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Sum over a query's vectors of the best inner product with the codes of a document, for all queries and documents; 0 without vectors.

    The documents' first, second, .. vectors are a matrix each, so the best one is an element-wise maximum of products that stay in the cache.
    """
    order = np.argsort(-sizes, kind="stable")
    first = (np.cumsum(sizes) - sizes)[order]
    stored = codes.reshape(int(sizes.sum()), -1 if len(codes) else q_flat.shape[1])
    held = [np.count_nonzero(sizes > s) for s in range(int(sizes.max(initial=0)))]  # documents with more than s vectors come first
    slots = [np.ascontiguousarray(stored[first[:m] + s].T, np.float32) for s, m in enumerate(held)]
    single, out = q_flat.astype(np.float32), np.zeros((len(q_at) - 1, len(sizes)))
    filled = np.flatnonzero(np.diff(q_at))
    ends, begin = np.cumsum(np.diff(q_at)[filled]), 0
    while begin < len(filled) and slots:
        to = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + VECTORS_AT_ONCE, side="right")))
        rows = filled[begin:to]
        own, starts = single[q_at[rows[0]] : q_at[rows[-1] + 1]], q_at[rows] - q_at[rows[0]]
        few = np.diff(np.r_[starts, len(own)]).max() <= FEW_VECTORS  # their sum in single precision is within what `late_candidates` allows for
        member = (np.arange(len(rows))[:, None] == np.searchsorted(starts, np.arange(len(own)), side="right") - 1).astype(np.float32) if few else None
        room = np.empty((2, len(own) * SETS_AT_ONCE), np.float32)
        for at in range(0, held[0], SETS_AT_ONCE):
            best = None
            for slot in slots:
                part = slot[:, at : at + SETS_AT_ONCE]
                if not part.shape[1]:
                    break
                near = np.matmul(own, part, out=room[int(best is not None), : len(own) * part.shape[1]].reshape(len(own), -1))
                if best is None:
                    best = near
                else:
                    np.maximum(best[:, : part.shape[1]], near, out=best[:, : part.shape[1]])
            out[rows, at : at + best.shape[1]] = member @ best if few else np.add.reduceat(best, starts, axis=0, dtype=np.float64)
        begin = to
    return out[:, np.argsort(order, kind="stable")]


def late_candidates(queries: DataFrame, codes: DataFrame, k: int, n_query: int, n_gallery: int) -> DataFrame:
    """(query_id, doc_id): the documents that can be among the k best late-interaction scores by what the codes tell.

    Every best inner product is off by at most the query vector's norm times the document's `off`.
    """

    def score(q: pa.Table, g: pa.Table) -> pa.Table:
        q_at, q_flat = _unpacked(q)
        sizes, scale, off = (blocks.column(g, c) for c in ("n", "scale", "off"))
        width, norms = q_flat.shape[1], np.linalg.norm(q_flat, axis=1)
        totals = _best_sums(q_at, q_flat, sizes, np.frombuffer(b"".join(g.column("code").to_pylist()), np.int8))
        lost = np.where(sizes > 0, off + SINGLE_ERROR * scale * 127 * width * 8, 0.0)
        least = np.where(sizes > 0, 10.0**-DENSE_DIGITS, 0.0)
        found: list[tuple[np.ndarray, ...]] = []
        for i in range(q.num_rows):
            own = slice(q_at[i], q_at[i + 1])
            near, spread = totals[i] * scale, norms[own].sum() * lost + (least if own.stop > own.start else 0.0)
            low, high = near - spread, near + spread
            bar = np.partition(low, -k)[-k] if len(low) > k else -np.inf
            kept = np.flatnonzero(high >= bar) if own.stop > own.start else np.arange(min(k, len(low)))  # without vectors all tie at 0, in id order
            found.append((np.full(len(kept), i), kept, low[kept], high[kept]))
        who, row, low, high = (np.concatenate(c) for c in zip(*found))
        return pa.table({"query_id": blocks.column(q, "query_id")[who], "doc_id": blocks.column(g, "doc_id")[row], "low": low, "high": high})

    schema = f"query_id {_type(queries, 'query_id')}, doc_id {_type(codes, 'doc_id')}, low double, high double"
    return _open_pairs(cut(blocks.score_blocks(queries.select("query_id", "vectors"), codes, n_query, n_gallery, score, schema)), k)


def multi_vector_topk(queries: DataFrame, gallery: DataFrame, k: int, n_query: int, n_gallery: int) -> DataFrame:
    """Late interaction: sum over query vectors of the best inner product with a document vector.

    `vectors` is an array of equally long arrays; documents may differ in count, and one without vectors scores 0.
    The scan reads 8-bit codes; only pairs that these leave open are scored in full.
    """
    open_ = late_candidates(queries, cut(coded_sets(gallery)), k, n_query, n_gallery)
    pairs = open_.join(queries.select("query_id", F.col("vectors").alias("qv")), "query_id").join(blocks.fresh(gallery).select("doc_id", F.col("vectors").alias("gv")), "doc_id")

    def total(qs: Column, gs: Column) -> Column:
        best = F.transform(qs, lambda a: F.coalesce(F.array_max(F.transform(gs, lambda b: arrays.dot(a, b))), F.lit(0.0)))
        return F.round(F.aggregate(best, F.lit(0.0), lambda acc, x: acc + x), DENSE_DIGITS)

    return keep_top(pairs.select("query_id", "doc_id", total(F.col("qv"), F.col("gv")).alias("score")), k)


# ---- hybrid and fusion ------------------------------------------------------------------


def rerank(shortlist: DataFrame, query_vectors: DataFrame, gallery_vectors: DataFrame) -> DataFrame:
    """Order a shortlist (query_id, doc_id, ..) by cosine; adds `dense` and `rank`."""
    scored = (
        shortlist.join(query_vectors.select("query_id", F.col("vector").alias("qv")), "query_id")
        .join(gallery_vectors.select("doc_id", F.col("vector").alias("gv")), "doc_id")
        .withColumn("dense", F.round(arrays.dot(F.col("qv"), F.col("gv")), DENSE_DIGITS))
        .drop("qv", "gv")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("dense"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order))


def fusion_ranks(queries: DataFrame, postings: DataFrame, query_vectors: DataFrame, gallery_vectors: DataFrame, truth: DataFrame, alphas: tuple[float, ...], n_query: int, n_gallery: int) -> DataFrame:
    """Rank of the truth under alpha*minmax(bm25) + (1-alpha)*minmax(dense), one row per query and alpha.

    Two passes over the same blocks: the first finds each query's score range over
    the whole gallery, the second counts the documents that beat the truth.
    """
    gallery = pack(postings, "doc_id").join(gallery_vectors, "doc_id")
    truth_scores = (
        score_pairs(truth, queries, postings)
        .join(query_vectors.select("query_id", F.col("vector").alias("qv")), "query_id")
        .join(gallery_vectors.select("doc_id", F.col("vector").alias("gv")), "doc_id")
        .select(
            "query_id", F.col("doc_id").alias("truth_id"), F.col("units").cast("double").alias("truth_sparse"),
            F.round(arrays.dot(F.col("qv"), F.col("gv")), DENSE_DIGITS).alias("truth_dense"),
        )
    )
    queries = queries.select("query_id", "tokens", "weights").join(query_vectors, "query_id")

    def ranges(q: pa.Table, g: pa.Table) -> pa.Table:
        sparse, dense = blocks.sparse_scores(q, g), blocks.dense_scores(q, g)
        return pa.table(
            {
                "query_id": blocks.column(q, "query_id"), "s_min": sparse.min(axis=1), "s_max": sparse.max(axis=1),
                "d_min": dense.min(axis=1), "d_max": dense.max(axis=1),
            }
        )

    kind = _type(queries, "query_id")
    spans = (
        blocks.score_blocks(queries, gallery, n_query, n_gallery, ranges, f"query_id {kind}, s_min double, s_max double, d_min double, d_max double")
        .groupBy("query_id")
        .agg(F.min("s_min").alias("s_min"), F.max("s_max").alias("s_max"), F.min("d_min").alias("d_min"), F.max("d_max").alias("d_max"))
    )
    bars = cut(truth_scores.join(spans, "query_id"))

    def fused(sparse, dense, t, alpha: float):
        s = (sparse - t["s_min"]) / np.maximum(t["s_max"] - t["s_min"], TINY)
        d = (dense - t["d_min"]) / np.maximum(t["d_max"] - t["d_min"], TINY)
        return np.round(alpha * s + (1 - alpha) * d, DENSE_DIGITS)

    def ranks(q: pa.Table, g: pa.Table) -> pa.Table:
        sparse, dense = blocks.sparse_scores(q, g), blocks.dense_scores(q, g)
        wide = {c: blocks.column(q, c)[:, None] for c in ("truth_sparse", "truth_dense", "s_min", "s_max", "d_min", "d_max")}
        parts = []
        for alpha in alphas:
            bar = fused(wide["truth_sparse"], wide["truth_dense"], wide, alpha)[:, 0]
            part = blocks.rank_rows(q, blocks.column(g, "doc_id"), fused(sparse, dense, wide, alpha), bar, "query_id")
            parts.append(part.append_column("alpha", pa.array(np.full(len(bar), alpha))))
        return pa.concat_tables(parts)

    schema = rank_schema(queries, postings, "query_id", "doc_id") + ", alpha double"
    partial = blocks.score_blocks(queries.join(bars, "query_id"), gallery, n_query, n_gallery, ranks, schema)
    return merge_ranks(partial, "query_id", ["alpha"])


# ---- sparse label vectors ---------------------------------------------------------------


def label_vector(response: Column) -> Column:
    """Array of (label, conf) from a parsed classifier response, unmerged."""

    def entity(e: Column) -> Column:
        label = F.coalesce(
            blank_to_null(e["type"]), blank_to_null(e["mentionText"]), blank_to_null(e["normalizedValue"]["text"]), F.lit("UNKNOWN")
        )
        return F.struct(label.alias("label"), F.coalesce(e["confidence"], F.lit(0.0)).alias("conf"))

    def language(d: Column) -> Column:
        code = F.coalesce(d["languageCode"], F.lit("unknown"))
        return F.struct(F.concat(F.lit("lang:"), code).alias("label"), F.coalesce(d["confidence"], F.lit(0.0)).alias("conf"))

    empty = F.array().cast("array<struct<label:string,conf:double>>")
    entities = F.coalesce(F.transform(response["entities"], entity), empty)
    pages = F.coalesce(F.flatten(F.transform(response["pages"], lambda p: F.coalesce(F.transform(p["detectedLanguages"], language), empty))), empty)
    return F.concat(entities, pages)


def label_vectors(responses: DataFrame, id_col: str = "doc_id", response: str = "response") -> DataFrame:
    """(id, label, conf) with the highest confidence per label."""
    rows = arrays.each(responses, [id_col], label_vector(F.col(response)), "e")
    return rows.groupBy(id_col, F.col("e.label").alias("label")).agg(F.greatest(F.max("e.conf"), F.lit(0.0)).alias("conf"))


def unit_labels(vectors: DataFrame, id_col: str) -> DataFrame:
    """Label weights divided by the vector's norm; zero vectors keep weight 0."""
    norms = vectors.groupBy(id_col).agg(F.sqrt(F.sum(F.col("conf") * F.col("conf"))).alias("norm"))
    weight = F.when(F.col("norm") > 0, F.col("conf") / F.col("norm")).otherwise(F.lit(0.0))
    return vectors.join(norms, id_col).select(id_col, F.col("label").alias("token"), weight.alias("weight"))


def label_topk(queries: DataFrame, gallery: DataFrame, ids: DataFrame, gallery_ids: DataFrame, k: int, n_query: int, n_gallery: int) -> DataFrame:
    """Sparse cosine top-k of label vectors; documents sharing no label score 0.

    `ids` (query_id) and `gallery_ids` (doc_id) name all queries and documents, those without labels too.
    Weights are whole numbers on a grid, so their sums do not depend on any order.
    """

    def packed(vectors: DataFrame, names: DataFrame, id_col: str) -> DataFrame:
        weighted = unit_labels(vectors, id_col).withColumn("weight", F.round(F.col("weight") * LABEL_GRID).cast("long"))
        rows = names.select(id_col).distinct().join(pack(weighted, id_col), id_col, "left")
        return rows.select(
            id_col, F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"), F.coalesce("weights", F.array().cast("array<bigint>")).alias("weights")
        )

    def score(q: pa.Table, g: pa.Table) -> pa.Table:
        ids = (blocks.column(q, "query_id"), blocks.column(g, "doc_id"))
        return blocks.top_rows(*ids, np.round(blocks.sparse_scores(q, g) / LABEL_GRID**2, DENSE_DIGITS), k, "query_id", "doc_id")

    schema = f"query_id {_type(queries, 'query_id')}, doc_id {_type(gallery, 'doc_id')}, score double"
    partial = blocks.score_blocks(packed(queries, ids, "query_id"), packed(gallery, gallery_ids, "doc_id"), n_query, n_gallery, score, schema)
    return keep_top(partial, k)


def top_labels(vectors: DataFrame, n: int = 5, id_col: str = "doc_id") -> DataFrame:
    """The n most confident labels per id, ties by label."""
    order = Window.partitionBy(id_col).orderBy(F.desc("conf"), "label")
    return vectors.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= n)


# ---- merging block results ----------------------------------------------------------------


def keep_top(partial: DataFrame, k: int, query_id: str = "query_id", doc_id: str = "doc_id") -> DataFrame:
    """Best k rows per query; the rank filter is applied before and after the shuffle."""
    order = Window.partitionBy(query_id).orderBy(F.desc("score"), doc_id)
    return partial.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= k)


def rank_schema(queries: DataFrame, gallery: DataFrame, query_id: str, doc_id: str) -> str:
    kind = _type(gallery, doc_id)
    return f"{query_id} {_type(queries, query_id)}, truth_id {kind}, above long, ties_before long, best_id {kind}, best_score double"


def merge_ranks(partial: DataFrame, query_id: str, extra: list[str] | None = None) -> DataFrame:
    """Sum the counts of all gallery blocks; best match is the highest score, then the first document."""
    keys = [query_id, "truth_id", *(extra or [])]
    best = F.min(F.struct((-F.col("best_score")).alias("s"), "best_id"))
    merged = partial.groupBy(*keys).agg(F.sum("above").alias("above"), F.sum("ties_before").alias("ties"), best.alias("best"))
    return merged.select(
        *keys,
        (F.col("above") + F.col("ties") + 1).alias("rank"),
        (F.col("above") + 1).alias("optimistic_rank"),
        F.col("best.best_id").alias("best_id"),
        (-F.col("best.s")).alias("best_score"),
    )


def _type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()
