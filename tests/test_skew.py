"""First rows without one task, lookups with hot and null keys, and a set of paths that is never forgotten."""

import hashlib

import pytest
from pyspark.sql import functions as F

from formlake.operators import curation, skew
from formlake.streaming import jobs


@pytest.mark.parametrize("n", [0, 1, 37, 200, 500])
def test_first_rows_over_many_tasks(spark, monkeypatch, n):
    rows = spark.range(200).select("id", F.md5(F.col("id").cast("string")).alias("h"))
    want = [r["id"] for r in skew.first_rows(rows, [F.col("h")], n).orderBy("id").collect()]
    monkeypatch.setattr(skew, "ONE_TASK_ROWS", -1)
    many = skew.first_rows(rows, [F.col("h")], n)
    assert [r["id"] for r in many.orderBy("id").collect()] == want and len(want) == min(n, 200)
    assert "Limit" not in many._jdf.queryExecution().executedPlan().toString()


def test_sample_does_not_depend_on_the_way(spark, monkeypatch):
    rows = spark.range(300).withColumnRenamed("id", "doc_id")
    want = curation.sample(rows, "doc_id", 40).collect()
    monkeypatch.setattr(skew, "ONE_TASK_ROWS", 10)
    assert curation.sample(rows, "doc_id", 40).collect() == want


@pytest.mark.parametrize("rows", [100, 100_000])
def test_hash_rank_of_large_and_small_groups(spark, monkeypatch, rows):
    monkeypatch.setattr(skew, "WINDOW_ROWS", rows)
    frame = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, "big").when(F.col("id") % 2 == 0, F.concat(F.lit("g"), F.col("id") % 50)).alias("g"))
    got = {}
    for r in skew.hash_rank(frame, F.col("id").cast("string"), "place", ["g"]).collect():
        got.setdefault(r["g"], []).append((hashlib.md5(str(r["id"]).encode()).hexdigest(), r["place"]))
    assert sum(map(len, got.values())) == 3000 and len(got["big"]) == 2000
    assert all([p for _, p in sorted(of)] == list(range(1, len(of) + 1)) for of in got.values())


def test_lookup_with_a_hot_key_and_null_keys(spark):
    facts = spark.range(9000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("k"), F.col("id"))).alias("stem"))
    lookup = spark.createDataFrame([("hot", "a"), ("hot", "b"), ("k1", "c"), ("other", "d"), (None, "e")], "stem string, path string")
    got = skew.lookup_on_counted_key(facts, lookup, "stem", "id")
    plain = facts.join(lookup, "stem", "left")
    assert sorted(map(str, got.select(*plain.columns).collect())) == sorted(map(str, plain.collect())) and got.count() == 12000


def test_preferred_paths_keeps_rows_without_anything(spark):
    items = spark.createDataFrame([("s", "p1"), ("s", "gone"), ("t", None), (None, None), (None, "p2")], "stem string, listed_path string")
    files, index = spark.createDataFrame([("p1",), ("p2",), ("p2",)], "path string"), spark.createDataFrame([("s", "i")], "stem string, path string")
    got = sorted((r["stem"] or "", r["listed_path"] or "", r["path"]) for r in curation.preferred_paths(items, files, index).collect())
    assert got == [("", "", None), ("", "p2", "p2"), ("s", "gone", "i"), ("s", "p1", "p1"), ("t", "", None)]


def test_a_path_counts_once_however_late(spark, tmp_path):
    source, state = str(tmp_path / "in"), str(tmp_path / "state")

    def arrive(day, *paths):
        rows = spark.createDataFrame([(p, 2) for p in paths], "path string, n_words long").withColumn("at", F.lit(f"2024-01-{day:02d}").cast("timestamp"))
        rows.coalesce(1).write.mode("append").parquet(source)
        jobs.cache_totals(spark, source, state, f"seen{day}").awaitTermination()
        return tuple(spark.table(f"seen{day}").first())

    assert arrive(1, "a", "b", "a") == (2, 4)
    assert arrive(9, "c") == (3, 6)
    assert arrive(20, "a", "d", "c") == (4, 8)
