"""Whitened vectors against numpy's eigenvectors."""

import numpy as np
import pytest

from formlake.llm import whitening


def vectors(spark, rows):
    frame = spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v]) for i, v in rows], "vec_id long, embedding array<double>")
    return frame.selectExpr("*", "vec_id AS n", "vec_id AS component", "embedding AS whitened")


def expected(x, most):
    n = len(x)
    nx = [[n * int(a) - s for a, s in zip(row, map(int, x.sum(axis=0)))] for row in x.astype(object)]
    c = np.array(nx, object).astype(float) / n
    values, parts = np.linalg.eigh(c.T @ c / n)
    values, parts = values[::-1][:most], parts[:, ::-1][:, :most]
    return [min(whitening.LONG, sum(v * v for v in row)) for row in nx], c @ parts / np.sqrt(values), values / np.trace(c.T @ c / n)


def compare(got, ids, x, most):
    deviation, white, explained = expected(x, most)
    size = white.shape[1]
    assert len(got) == len(ids) * size
    table = {(r["vec_id"], r["component"]): r for r in got}
    found = np.array([[table[i, j + 1]["whitened"] for j in range(size)] for i in ids])
    sign = np.sign((found * white).sum(axis=0))
    assert np.abs(found * sign - white).max() < 1e-8
    assert [table[i, 1]["deviation"] for i in ids] == deviation
    assert np.allclose([table[ids[0], j + 1]["explained"] for j in range(size)], explained, rtol=1e-8)
    assert {r["n"] for r in got} == {len(x)}
    error = {r["identity_error"] for r in got}
    assert len(error) == 1 and error.pop() < 1e-9


def whole(rows, scale=64, offset=1_000_000):
    return np.floor(scale * np.array(rows, float)).astype(np.int64) + offset


def test_table_matches_numpy(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = frame.collect()
    compare(whitening.whitened(frame).collect(), [r["vec_id"] for r in rows], whole([r["embedding"] for r in rows]), 32)


def test_dimensions_of_very_different_size(spark):
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(300, 6)) * [1e7, 1e3, 1, 1, 50, 0.2] + [1e9, -5e6, 0, 3, 0, 0]
    rows[:, 3] = rows[:, 2] + rng.normal(size=300) * 0.3  # nearly the same
    compare(whitening.whitened(vectors(spark, enumerate(rows))).collect(), list(range(300)), whole(rows), 6)


def test_components_without_variance_are_left_out(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(-900, 900, size=(120, 3)) / 64
    rows = np.c_[base, base[:, 0] + base[:, 1], np.full(120, 7.0)]
    got = whitening.whitened(vectors(spark, enumerate(rows))).collect()
    deviation, white, explained = expected(whole(rows), 3)
    assert {r["component"] for r in got} == {1, 2, 3}
    assert np.isclose(sum(r["explained"] for r in got if r["vec_id"] == 0), 1.0, rtol=1e-9)
    assert max(r["identity_error"] for r in got) < 1e-9
    assert {r["vec_id"]: r["deviation"] for r in got} == dict(enumerate(deviation))


def test_fewer_rows_than_dimensions(spark):
    rows = np.random.default_rng(5).normal(size=(4, 9))
    got = whitening.whitened(vectors(spark, enumerate(rows))).collect()
    assert {r["component"] for r in got} == {1, 2, 3} and max(r["identity_error"] for r in got) < 1e-9


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1, 2]), (1, [1, 2]), (None, [3, -1]), (2, None), (3, [1, None]), (4, [nan, 1]), (5, [1, -inf]), (6, [5]), (7, []), (8, [0.5, 0.25])]
    got = whitening.whitened(vectors(spark, rows)).collect()
    assert sorted((r["vec_id"] or 0) for r in got) == sorted([1, 1, 0, 6, 7, 8] * 2)
    filled = [[1, 2], [1, 2], [3, -1], [5, 0], [0, 0], [0.5, 0.25]]
    deviation, white, explained = expected(whole(filled), 2)
    assert sorted(r["deviation"] for r in got if r["component"] == 1) == sorted(deviation)
    assert {round(r["explained"], 9) for r in got} == {round(e, 9) for e in explained}
    assert max(r["identity_error"] for r in got) < 1e-9


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [4.0]), (2, [4.0])], [(1, [])]])
def test_nothing_varies(spark, rows):
    assert whitening.whitened(vectors(spark, rows)).collect() == []


def test_numbers_beyond_a_double_of_whole_numbers(spark):
    rows = [(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [0.0, 5.0]), (4, [1e16, 0.0])]
    got = whitening.whitened(vectors(spark, rows)).collect()
    assert {r["vec_id"] for r in got} == {1, 2, 3, 4} and all(np.isfinite(r["whitened"]) for r in got)
    assert {r["deviation"] for r in got if r["vec_id"] == 1} == {whitening.LONG}


def test_ill_conditioned_rows_take_more_passes(spark):
    rng = np.random.default_rng(6)
    rows = rng.normal(size=(500, 8)) * 1000
    rows[:, 4:] = rows[:, :4] + np.round(rng.normal(size=(500, 4)) * 2) / 64
    frame = vectors(spark, enumerate(rows)).select("embedding")
    model = whitening.fit(frame, 8, 8, 64, 1_000_000)
    assert len(model.variances) == 8 and model.passes >= 3
    x = whole(rows)
    n = len(x)
    c = (n * x - x.sum(axis=0)) / n
    assert np.allclose(model.variances, np.linalg.svd(c, compute_uv=False) ** 2 / n, rtol=1e-6)
