"""The keyed store: newest versions, empty runs, repeated and broken commits, compaction."""

import os

from pyspark.sql import functions as F

from formlake.operators import medallion
from formlake.sources import store, writers
from formlake.streaming import jobs


def runs(spark, *rows):
    return spark.createDataFrame(rows, "template_id string, run_id string, v int")


def seen(spark, root, table="t"):
    return sorted((r["template_id"], r["run_id"], r["v"]) for r in store.read(spark, root, table).collect())


def silver_object(template, run, values, created="2024", name=None):
    pairs = ",".join(f'{{"key":"k","value":"{v}","score":0.5}}' for v in values)
    return (name or f"silver/kvp-json/{template}/{run}.json", f'{{"run_id":"{run}","template_id":"{template}","created_at":"{created}","key_values":[{pairs}]}}')


def objects(spark, *rows):
    return spark.createDataFrame(rows, "name string, payload string")


def gold(spark, root):
    fields = sorted((r["run_id"], r["field_value"]) for r in store.read(spark, root, "extracted-fields").collect())
    counts = sorted((r["run_id"], r["field_count"]) for r in store.read(spark, root, "form-runs").collect())
    return counts, fields


def test_newest_version_of_each_run(spark, tmp_path):
    root = str(tmp_path)
    first = runs(spark, ("a", "1", 1), ("a", "1", 10), ("a", "2", 1), ("007", "1", 1))
    assert store.commit(root, {"t": first}, first, "x")
    second = runs(spark, ("a", "1", 2), ("c", "9", 2))
    assert store.commit(root, {"t": second}, second, "y")
    want = [("007", "1", 1), ("a", "1", 2), ("a", "2", 1), ("c", "9", 2)]
    assert seen(spark, root) == want
    # a commit of a known name does nothing; a run without rows is gone; other tables keep their rows
    assert not store.commit(root, {"t": first}, first, "y")
    assert store.commit(root, {"t": second.limit(0), "u": second}, second.limit(1), "z")
    assert [r for r in want if r not in seen(spark, root)] == [("a", "1", 2)]
    assert seen(spark, root, "u") == [("a", "1", 2)]


def test_broken_commits_do_not_count_and_can_be_repeated(spark, tmp_path):
    root = str(tmp_path)
    one = runs(spark, ("a", "1", 1))
    store.commit(root, {"t": one}, one, "x")
    two = runs(spark, ("a", "1", 2), ("a", "2", 2))
    two.write.partitionBy("template_id").parquet(f"{root}/t/commit=y")
    assert seen(spark, root) == [("a", "1", 1)]
    store.commit(root, {"t": two}, two, "y")
    assert seen(spark, root) == [("a", "1", 2), ("a", "2", 2)]


def test_a_commit_writes_its_own_runs_alone(spark, tmp_path):
    root = str(tmp_path)
    many = spark.range(3000).select(F.lit("a").alias("template_id"), F.col("id").cast("string").alias("run_id"), F.col("id").cast("int").alias("v"))
    store.commit(root, {"t": many}, many, "x")
    one = runs(spark, ("a", "5", -1))
    store.commit(root, {"t": one}, one, "y")
    files = [f for _, _, names in os.walk(f"{root}/t/commit=y") for f in names if f.endswith(".parquet")]
    assert len(files) == 1 and spark.read.parquet(f"{root}/t/commit=y").count() == 1
    assert store.read(spark, root, "t").agg(F.count("*"), F.min("v")).first() == (3000, -1)


def test_compaction_keeps_what_is_seen(spark, tmp_path):
    root = str(tmp_path)
    for i in range(3):
        rows = runs(spark, ("a", "1", i), ("b", str(i), i))
        store.commit(root, {"t": rows}, rows)
    before = seen(spark, root)
    store.compact(spark, root)
    assert seen(spark, root) == before and len(store.history(spark, root)) == 1
    later = runs(spark, ("b", "1", 7))
    store.commit(root, {"t": later}, later)
    assert seen(spark, root) == sorted([r for r in before if r[:2] != ("b", "1")] + [("b", "1", 7)])


def test_gold_of_a_run_without_fields(spark, tmp_path):
    root = str(tmp_path)
    stamp = F.lit("now")
    parse = lambda *rows: medallion.parse_silver(objects(spark, *rows))
    writers.write_gold(parse(silver_object("t", "a", [1, 2]), silver_object("t", "b", [3]), ("silver/kvp-json/t/c.json", "{bad")), root, stamp)
    assert gold(spark, root) == ([("a", 2), ("b", 1)], [("a", "1"), ("a", "2"), ("b", "3")])
    writers.write_gold(parse(silver_object("t", "a", [])), root, stamp)
    assert gold(spark, root) == ([("a", 0), ("b", 1)], [("b", "3")])
    writers.write_gold(parse(silver_object("t", "a", [8], "2025"), silver_object("t", "a", [9], "2024", "silver/kvp-json/t/z.json")), root, stamp)
    assert gold(spark, root) == ([("a", 1), ("b", 1)], [("a", "8"), ("b", "3")])


def test_two_uploads_of_a_run_in_one_call(spark, tmp_path):
    root = str(tmp_path)
    frame = lambda *rows: spark.createDataFrame([(*r[:2], "f.png", "image/png", r[2], r[3], r[4]) for r in rows], (
        "run_id string, template_id string, file_name string, content_type string, image binary, kvp string, created_at string"
    ))
    writers.ingest(frame(("r", "t", b"new", '{"n":1}', "2024-02"), ("r", "t", b"old", '{"n":2}', "2024-01"), ("r", "t", b"none", '{"n":3}', None), ("s", "t", b"s", "{}", None)), root, "one")
    read = lambda: {r["run_id"]: bytes(r["image"]) for r in store.read(spark, root, "bronze").collect()}
    assert read() == {"r": b"new", "s": b"s"} and store.read(spark, root, "silver").count() == 2
    writers.ingest(frame(("r", "t", b"newer", "{}", "2024-03")), root, "two")
    writers.ingest(frame(("s", "t", b"again", "{}", "2024-03")), root, "two")
    assert read() == {"r": b"newer", "s": b"s"}


def test_stream_keeps_the_later_version_of_a_run(spark, tmp_path):
    source, out, state = (str(tmp_path / p) for p in ("in", "out", "state"))
    objects(spark, silver_object("t", "a", [1, 2]), silver_object("t", "b", [5])).write.parquet(source)
    jobs.transform_silver(spark, source, out, state).awaitTermination()
    objects(spark, silver_object("t", "a", [3])).write.mode("append").parquet(source)
    jobs.transform_silver(spark, source, out, state).awaitTermination()
    assert gold(spark, out) == ([("a", 1), ("b", 1)], [("a", "3"), ("b", "5")])
    # another query over the same folder counts its own batches
    jobs.transform_silver(spark, source, out, f"{state}2").awaitTermination()
    assert len(store.history(spark, out)) == 3
