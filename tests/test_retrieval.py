import numpy as np
import pytest
from pyspark.sql import functions as F

from formlake.operators import blockmax, blocks, ranking, retrieval

DOCS = [(1, ["a", "a", "b"]), (2, ["b", "c"]), (3, ["d"])]


@pytest.fixture()
def gallery(spark):
    return spark.createDataFrame(DOCS, "doc_id long, words array<string>")


def queries(spark, *texts):
    return spark.createDataFrame([(i, t.split()) for i, t in enumerate(texts)], "query_id long, words array<string>")


def test_bm25_scores_of_small_gallery(spark, gallery):
    terms = retrieval.term_arrays(queries(spark, "a b", "b b zz", "zz"), "query_id")
    top = retrieval.bm25_topk(terms, retrieval.bm25_postings(gallery), 3, 1, 1).collect()
    scores = {(r["query_id"], r["doc_id"]): r["units"] / retrieval.GRID for r in top}
    assert scores[0, 1] == pytest.approx(1.590851, abs=2e-6)
    assert scores[0, 2] == pytest.approx(0.470004, abs=2e-6)
    assert scores[1, 1] == pytest.approx(0.767353, abs=2e-6)
    assert scores[1, 2] == pytest.approx(0.940007, abs=2e-6)
    assert [r["doc_id"] for r in sorted(top, key=lambda r: r["position"]) if r["query_id"] == 2] == [1, 2, 3]


def test_ranks_of_a_query_that_matches_nothing(spark, gallery):
    terms = retrieval.term_arrays(queries(spark, "zz"), "query_id")
    truth = spark.createDataFrame([(0, 3)], "query_id long, doc_id long")
    row = retrieval.bm25_ranks(terms, retrieval.bm25_postings(gallery), truth, 1).first()
    assert (row["rank"], row["optimistic_rank"], row["best_id"]) == (3, 1, 1)


def test_blocks_do_not_change_the_result(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame(
        [(i, [words[j] for j in rng.zipf(1.5, 30) % 40]) for i in range(90)], "doc_id long, words array<string>"
    )
    terms = retrieval.term_arrays(docs.withColumnRenamed("doc_id", "query_id"), "query_id")
    postings = retrieval.bm25_postings(docs)
    truth = terms.select("query_id", F.col("query_id").alias("doc_id"))
    one = retrieval.bm25_topk(terms, postings, 90, 1, 1).orderBy("query_id", "position").collect()
    many = retrieval.bm25_topk(terms, postings, 90, 3, 4).orderBy("query_id", "position").collect()
    assert one == many
    # the counts find the ranks that the full lists show
    place = {(r["query_id"], r["doc_id"]): (r["position"], r["units"]) for r in one}
    best = {r["query_id"]: (r["doc_id"], r["units"]) for r in one if r["position"] == 1}
    shifted = truth.withColumn("doc_id", (F.col("doc_id") * 7 + 3) % 90)
    for wanted in (truth, shifted):
        for r in retrieval.bm25_ranks(terms, postings, wanted, 3).collect():
            rank, units = place[r["query_id"], r["truth_id"]]
            above = sum(1 for (q, _), (_, u) in place.items() if q == r["query_id"] and u > units)
            assert (r["rank"], r["optimistic_rank"]) == (rank, above + 1)
            assert (r["best_id"], r["best_score"]) == best[r["query_id"]]


def test_sparse_kernel_equals_dense_product(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(2)
    left, right = (rng.integers(0, 4, (17, 50)) * (rng.random((17, 50)) < 0.3) for _ in range(2))

    def table(m):
        return pa.table({
            "tokens": [[f"t{j}" for j in np.flatnonzero(r)] for r in m], "weights": [[int(v) for v in r[np.flatnonzero(r)]] for r in m],
        }, schema=pa.schema([("tokens", pa.list_(pa.string())), ("weights", pa.list_(pa.int64()))]))

    for share in (0.0, 0.02, 1.0):
        monkeypatch.setattr(blocks, "DENSE_SHARE", share)
        monkeypatch.setattr(blocks, "PAIRS_PER_CHUNK", 13)
        assert (blocks.sparse_scores(table(left), table(right)) == left @ right.T).all()


def test_dense_topk_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 8))
    v[10] = v[20]  # a tie
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    g = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "doc_id long, vector array<double>")
    got = retrieval.dense_topk(g.withColumnRenamed("doc_id", "query_id"), g, 5, 2, 3).orderBy("query_id", "position").collect()
    scores = np.round(v @ v.T, 9)
    want = [(q, int(d)) for q in range(60) for d in np.argsort(-scores[q], kind="stable")[:5]]
    assert [(r["query_id"], r["doc_id"]) for r in got] == want


def test_approximate_topk_finds_most(spark):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(8, 16))
    v = np.repeat(centers, 20, axis=0) + rng.normal(scale=0.1, size=(160, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    g = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "doc_id long, vector array<double>")
    q = g.withColumnRenamed("doc_id", "query_id")
    exact = {(r["query_id"], r["doc_id"]) for r in retrieval.dense_topk(q, g, 5, 1, 1).collect()}
    near = {(r["query_id"], r["doc_id"]) for r in retrieval.lsh_topk(q, g, 5, tables=8, bits=4).collect()}
    assert len(exact & near) / len(exact) > 0.9


def test_label_vectors_prefer_type_then_mention(spark):
    from formlake.operators.layout import OCR_RESPONSE

    json = """{"document":{"entities":[{"type":"a","confidence":0.2},{"type":"a","confidence":0.7},{"mentionText":"m","confidence":0.1},
      {"normalizedValue":{"text":"n"}},{"confidence":0.3}],"pages":[{"detectedLanguages":[{"languageCode":"en","confidence":0.9},{"confidence":0.4}]}]}}"""
    rows = spark.createDataFrame([(1, json)], "doc_id long, json string").select("doc_id", F.from_json("json", OCR_RESPONSE)["document"].alias("response"))
    got = {r["label"]: r["conf"] for r in retrieval.label_vectors(rows).collect()}
    assert got == {"a": 0.7, "m": 0.1, "n": 0.0, "UNKNOWN": 0.3, "lang:en": 0.9, "lang:unknown": 0.4}


def test_missing_truth_policies(spark):
    rows = spark.createDataFrame([(None,), (2,)], "rank long")
    for policy, want in (("after", 0.2), ("zero", 0.0)):
        rank, reciprocal = ranking.missing_truth(F.col("rank"), F.lit(4), policy)
        got = rows.select(rank.alias("r"), reciprocal.alias("rr")).collect()
        assert [tuple(r) for r in got] == [(5, want), (2, 0.5)]
    rank, _ = ranking.missing_truth(F.col("rank"), F.lit(4), "error")
    with pytest.raises(Exception, match="not in the gallery"):
        rows.select(rank).collect()


def test_zero_vectors_stay_zero(spark):
    row = spark.range(1).select(
        retrieval.normalize(F.array(F.lit(0.0), F.lit(0.0))).alias("a"), retrieval.normalize(F.array(F.lit(3.0), F.lit(4.0)), "skip").alias("b"),
        retrieval.pool_and_fit(F.array(F.array(F.lit(3.0), F.lit(4.0))), 4).alias("c"),
    ).first()
    assert row["a"] == [0.0, 0.0] and row["b"] == [0.6, 0.8] and row["c"] == [0.6, 0.8, 0.0, 0.0]


def test_documents_without_labels_rank_last_with_zero(spark):
    vectors = spark.createDataFrame([(1, "a", 1.0), (2, "a", 0.5), (2, "b", 0.5)], "doc_id long, label string, conf double")
    ids = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    of = lambda df: df.withColumnRenamed("doc_id", "query_id")
    got = retrieval.label_topk(of(vectors), vectors, of(ids), ids, 3, 1, 1).collect()
    rows = {(r["query_id"], r["position"]): (r["doc_id"], round(r["score"], 4)) for r in got}
    assert [rows[1, p] for p in (1, 2, 3)] == [(1, 1.0), (2, 0.7071), (3, 0.0)]
    assert [rows[3, p] for p in (1, 2, 3)] == [(1, 0.0), (2, 0.0), (3, 0.0)]


def test_documents_without_vectors_score_zero(spark):
    q = spark.createDataFrame([(1, [[1.0, 0.0]]), (2, [])], "query_id long, vectors array<array<double>>")
    g = spark.createDataFrame([(1, []), (2, [[0.5, 0.0]]), (3, [])], "doc_id long, vectors array<array<double>>")
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in retrieval.multi_vector_topk(q, g, 3, 1, 1).collect()}
    assert got == {(1, 2): 0.5, (1, 1): 0.0, (1, 3): 0.0, (2, 1): 0.0, (2, 2): 0.0, (2, 3): 0.0}


def test_codes_find_the_exact_best_and_leave_little_open(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(400, 24))
    base[50:60] = base[40]  # equal vectors tie
    base[60:70] = base[40] * 3
    base[70] = 0
    rows = [(int(i), [float(v) for v in x]) for i, x in enumerate(base)]
    gallery = spark.createDataFrame(rows, "doc_id long, v array<double>").select("doc_id", retrieval.normalize(F.col("v")).alias("vector"))
    queries = gallery.select(F.col("doc_id").alias("query_id"), "vector")
    want = retrieval.dense_topk(queries, gallery, 7, 2, 3).orderBy("query_id", "position").collect()
    got = retrieval.coded_topk(queries, gallery, 7, 2, 3).select("query_id", "doc_id", "score", "position").orderBy("query_id", "position").collect()
    assert [tuple(r) for r in got] == [(r["query_id"], r["doc_id"], r["score"], r["position"]) for r in want]
    sent = retrieval.coded_candidates(queries, retrieval.coded(gallery), 7, 2, 3).count()
    assert 7 * 400 <= sent < 0.05 * 400 * 400 + 20 * 400
    few = gallery.filter("doc_id < 3")
    assert retrieval.coded_topk(queries, few, 7, 2, 2).count() == 1200


def test_late_interaction_scores_few_pairs_in_full(spark):
    rng = np.random.default_rng(9)
    sets = [(int(i), [[float(v) for v in rng.normal(size=12)] for _ in range(int(rng.integers(0, 6)))]) for i in range(250)]
    sets += [(250 + i, sets[30][1]) for i in range(12)]  # copies tie
    gallery = spark.createDataFrame(sets, "doc_id long, vectors array<array<double>>")
    queries = gallery.withColumnRenamed("doc_id", "query_id")
    got = {}
    for r in retrieval.multi_vector_topk(queries, gallery, 5, 2, 3).collect():
        got.setdefault(r["query_id"], {})[r["position"]] = (r["doc_id"], r["score"])
    for query, own in sets:
        scores = sorted(((-round(sum(max((np.dot(a, b) for b in vs), default=0.0) for a in own), 9), i) for i, vs in sets))[:5]
        assert [got[query][p][0] for p in range(1, 6)] == [i for _, i in scores]
        assert np.allclose([got[query][p][1] for p in range(1, 6)], [-s for s, _ in scores], atol=2e-9)
    share = retrieval.late_candidates(queries, retrieval.coded_sets(gallery), 5, 2, 3).count() / len(sets) ** 2
    assert share < 0.1


def test_a_block_pair_is_scored_a_few_queries_at_a_time(spark, monkeypatch):
    import pyarrow as pa

    # ten thousand vectors of 64 are one block: a side is not copied once for every thousand rows of the other
    assert blocks.block_count(spark.createDataFrame([(10_000, 640_000)], "ids long, items long")) == 1
    monkeypatch.setattr(blocks, "SCORES_AT_ONCE", 600)
    v = np.arange(200.0).reshape(100, 2)
    q = pa.table({"query_id": np.arange(100), "vector": v.tolist(), "tokens": [["a", "b"][: i % 3] for i in range(100)], "weights": [[1, 2][: i % 3] for i in range(100)]})
    g = q.rename_columns(["doc_id", *q.column_names[1:]])
    fields, seen = pa.schema([("query_id", pa.int64()), ("total", pa.float64())]), []

    def score(some, gallery):
        scores = blocks.dense_scores(some, gallery) + blocks.sparse_scores(some, gallery)
        seen.append(scores.size)
        return pa.table({"query_id": blocks.column(some, "query_id"), "total": scores.sum(axis=1)})

    got = blocks.in_parts(score, *blocks.with_codes(q, g), fields)
    want = score(q, g)
    assert got.column("query_id") == want.column("query_id") and got.column("total") == want.column("total")
    assert max(seen[:-1]) == blocks.LEAST_QUERIES * 100 and sum(seen[:-1]) == 100 * 100


def test_best_rows_of_a_block_keep_ties_in_order():
    scores = np.array([[1.0, 3.0, 3.0, np.nan, 3.0], [0.0, 0.0, 0.0, 0.0, 0.0]])
    ids = np.array([10, 20, 30, 40, 50])
    for k, want in ((2, [20, 30, 10, 20]), (9, [20, 30, 50, 10, 40, 10, 20, 30, 40, 50])):
        assert blocks.top_rows(np.array([1, 2]), ids, scores, k, "q", "g").column("g").to_pylist() == want


def test_rows_travel_in_packs(spark):
    """no row for every query and group; a pack holds 1024 rows and 262,144 tokens at most."""
    rows = spark.range(0, 2500, 1, 1).select(
        F.col("id").alias("query_id"), F.transform(F.sequence(F.lit(1), F.when(F.col("id") == 7, 300_000).otherwise(2)), lambda i: F.concat(F.lit("t"), i % 5)).alias("tokens"),
    ).withColumn("weights", F.transform("tokens", lambda t: F.lit(3).cast("long")))
    tables = [blockmax.opened(r["pack"]) for r in blockmax.packed(rows).collect()]
    assert sorted(i for t in tables for i in t.column("query_id").to_pylist()) == list(range(2500))
    for t in tables:
        sizes = [len(x) for x in t.column("tokens").to_pylist()]
        assert t.num_rows <= 1024 and (sum(sizes) <= 1 << 18 or t.num_rows == 1)
    assert [t.column("tokens").to_pylist()[0] for t in tables][0] == ["t1", "t2"]


def test_many_packs_rank_as_the_whole_list(spark, monkeypatch):
    rng = np.random.default_rng(5)
    docs = spark.createDataFrame([(i, [f"w{j}" for j in rng.zipf(1.5, 20) % 60]) for i in range(1500)], "doc_id long, words array<string>")
    terms = retrieval.term_arrays(docs.filter("doc_id % 25 = 0").withColumnRenamed("doc_id", "query_id"), "query_id")
    truth = terms.select("query_id", F.col("query_id").alias("doc_id"))
    postings = retrieval.bm25_postings(docs)
    place = {(r["query_id"], r["doc_id"]): r["position"] for r in retrieval.bm25_topk(terms, postings, 1500, 1, 1).collect()}
    monkeypatch.setattr(blockmax, "PACKS_PER_TASK", 1)
    ranks = retrieval.bm25_ranks(terms, postings, truth, 1).collect()
    assert len(ranks) == 60 and all(r["rank"] == place[r["query_id"], r["query_id"]] for r in ranks)


def test_dense_best_rows_are_those_of_all_scores(monkeypatch):
    """only what single precision leaves open is scored in full."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[300:320], x[777] = x[5], 0.0  # equal vectors tie, in order of their ids
    g = pa.table({"doc_id": np.arange(900) * 2, "vector": list(x)})
    q = pa.table({"query_id": np.arange(300), "vector": list(x[:300])})
    monkeypatch.setattr(blocks, "FIRST_ROWS", 64)
    monkeypatch.setattr(blocks, "PRODUCTS_AT_ONCE", 1 << 30)
    full, real = [], np.einsum
    monkeypatch.setattr(blocks.np, "einsum", lambda how, a, b: (full.append(len(a)), real(how, a, b))[1])
    for k in (1, 10, 100, 900):
        got = blocks.dense_top_rows(q, g, k, "query_id", "doc_id")
        want = blocks.top_rows(*(blocks.column(t, c) for t, c in ((q, "query_id"), (g, "doc_id"))), blocks.dense_scores(q, g), k, "query_id", "doc_id")
        assert got.column("query_id") == want.column("query_id") and got.column("doc_id") == want.column("doc_id")
        assert np.abs(blocks.column(got, "score") - blocks.column(want, "score")).max() < 2e-9
    assert len(full) == 3 and full[1] < 0.4 * 300 * 900  # for 10 of 900, by the best of the first 64
    nan = g.set_column(1, "vector", pa.array([[float("nan")] * 16, *x[1:].tolist()]))
    assert blocks.dense_top_rows(q, nan, 5, "query_id", "doc_id").num_rows == 1500


def test_best_sums_of_sets_in_parts(monkeypatch):
    """F8: sets of any size, in parts of queries and documents; blocks hold thousands of sets, so a side is copied for few of the other."""
    rng = np.random.default_rng(4)
    sizes, asked = rng.integers(0, 5, 70), rng.integers(0, 4, 30)
    codes, vectors = rng.integers(-9, 9, (sizes.sum(), 6)).astype(np.int8), rng.integers(-5, 5, (asked.sum(), 6)).astype(float)
    at, own = np.concatenate([[0], np.cumsum(asked)]), np.split(codes.astype(float), np.cumsum(sizes)[:-1])
    monkeypatch.setattr(retrieval, "VECTORS_AT_ONCE", 7)
    monkeypatch.setattr(retrieval, "SETS_AT_ONCE", 16)
    want = [[sum(max(c @ v for c in s) for v in vectors[a:b]) if len(s) else 0.0 for s in own] for a, b in zip(at, at[1:])]
    for few in (64, 1):
        monkeypatch.setattr(retrieval, "FEW_VECTORS", few)
        assert np.array_equal(retrieval._best_sums(at, vectors, sizes, codes.ravel()), np.array(want))
    assert np.array_equal(retrieval._best_sums(at, vectors, np.zeros(3, np.int64), np.zeros(0, np.int8)), np.zeros((30, 3)))
    assert retrieval.SET_BLOCK >= 8_192


def test_packs_are_not_shuffled_for_every_part_of_the_other_side(spark, monkeypatch):
    """groups go out in rounds; every pair of packs is counted once."""
    monkeypatch.setattr(blockmax, "PACKS_PER_TASK", 2)
    sides = [blockmax.cut(spark.createDataFrame([(bytes([i]) * 3,) for i in range(n)], "pack binary").repartition(2)) for n in (7, 5)]

    def task(asked, held):
        import pyarrow as pa

        return pa.table({"pair": [a.as_py()[0] * 10 + b[0] for a in asked for b in held]})

    pairs = blockmax.on_packs(*sides, task, "pair long")
    assert sorted(r["pair"] for r in pairs.collect()) == sorted(a * 10 + b for a in range(7) for b in range(5))
    assert "Exchange" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert blockmax.on_packs(sides[0], sides[1].limit(0), task, "pair long").count() == 0
