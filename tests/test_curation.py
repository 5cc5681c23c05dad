import pytest
from pyspark.sql import functions as F

from formlake.functions import text
from formlake.operators import augment, curation, gates, medallion
from formlake.operators.skew import global_rank, group_rank, hash_rank, join_on_counted_key
from formlake.sources import readers, writers


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def test_number_parsing(spark):
    texts = ["0.9", " 0.5 ", "nan", "x", None, "1d", "1e3"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(text.parse_number(F.col("t")).alias("v")).collect()
    assert [r["v"] for r in rows] == [0.9, 0.5, None, None, None, None, 1000.0]


def test_key_cleaning(spark):
    row = one(spark, a=text.clean_key_part(F.lit(" a b/c "), F.lit("f")), b=text.clean_key_part(F.lit("--"), F.lit("f")))
    assert (row["a"], row["b"]) == ("a-b-c", "f")


def words_of(spark, n, mask, corrupt, min_one=True):
    ws = F.array(*(F.lit(f"word{i}") for i in range(n)))
    return one(spark, m=augment.mask_and_corrupt(ws, F.lit("k"), mask, corrupt, "letters", min_one))["m"]


def test_masking_counts(spark):
    assert len(words_of(spark, 10, 0.25, 0.0)["masked"]) == 2
    both = words_of(spark, 10, 0.20, 0.10)
    assert (len(both["masked"]), len(both["corrupted"])) == (2, 1)
    assert not set(both["masked"]) & set(both["corrupted"])
    assert [w for i, w in enumerate(both["words"]) if i in both["masked"]] == ["[MASK]"] * 2
    assert len(words_of(spark, 1, 0.25, 0.0)["masked"]) == 1
    assert len(words_of(spark, 1, 0.25, 0.0, min_one=False)["masked"]) == 0


def test_empty_documents_are_not_masked(spark):
    row = one(spark, m=augment.mask_and_corrupt(F.array(F.lit("[EMPTY]")), F.lit("k"), 0.25, 0.10, "letters"))
    assert row["m"]["words"] == ["[EMPTY]"] and row["m"]["masked"] == []


def test_noisy_words_are_one_edit_away(spark):
    rows = spark.range(300).select(augment.noisy_word(F.lit("Abc"), F.col("id").cast("string"), F.lit(0)).alias("w")).collect()
    lengths = {len(r["w"]) for r in rows}
    assert lengths == {2, 3, 4}


def test_apportion_gives_the_rest_to_the_largest_remainder(spark):
    sizes = curation.apportion(F.lit(10), {"train": 92, "val": 4, "test": 4})
    assert tuple(one(spark, **sizes)) == (9, 1, 0)


def test_splits_are_disjoint_and_whole(spark):
    names = spark.range(100).withColumnRenamed("id", "name")
    split = curation.weighted_splits(names, "name", {"train": 92, "val": 4, "test": 4})
    assert {r["split"]: r["count"] for r in split.groupBy("split").count().collect()} == {"train": 92, "val": 4, "test": 4}
    with pytest.raises(Exception, match="too few names"):
        curation.fixed_splits(names, "name", {"train": 90, "val": 20}).collect()


def test_ranks_hold_for_a_hot_group(spark):
    rows = spark.range(3000).withColumn("g", F.when(F.col("id") % 3 == 0, F.col("id") % 50).otherwise(F.lit(-1)))
    for ranked in (group_rank(rows, ["g"], [F.desc("id")], "r"), hash_rank(rows, F.col("id").cast("string"), "r", ["g"])):
        per = ranked.groupBy("g").agg(F.count("*").alias("n"), F.min("r").alias("a"), F.max("r").alias("b"), F.count_distinct("r").alias("d")).collect()
        assert all(r["a"] == 1 and r["b"] == r["n"] == r["d"] for r in per)
    first = group_rank(rows, ["g"], [F.desc("id")], "r").filter("r = 1 and g = -1").first()
    assert first["id"] == 2999
    ranked = global_rank(rows, [F.col("id")], "r")
    assert ranked.filter("r <> id + 1").count() == 0


def test_salted_join_is_whole(spark):
    facts = spark.range(10000).withColumn("k", F.when(F.col("id") < 4000, F.lit(0)).otherwise(F.col("id")))
    keys = facts.groupBy("k").agg(F.count("*").alias("n"))
    joined = join_on_counted_key(facts, keys, "k", "n", "id")
    assert joined.count() == 10000 and joined.filter("k = 0 and n <> 4000").count() == 0


def test_balanced_batches_have_distinct_classes(spark):
    rows = spark.range(50).withColumn("label", (F.col("id") % 5).cast("int")).filter("id < 41")
    got = curation.balanced_batches(rows, "label", "id", 3, 2).collect()
    batches = {}
    for r in got:
        batches.setdefault(r["batch"], []).append((r["label"], r["id"]))
    assert len(batches) == 7
    for members in batches.values():
        assert len(members) == 6 and len({label for label, _ in members}) == 3 and len(set(members)) == 6


def test_missing_regions_are_counted(spark):
    schema = "source_parquet string, row_id long, qualifying_objects array<struct<object_id:long,area:double>>"
    metadata = spark.createDataFrame([("p", 1, [(1, 5.0), (2, 6.0)]), ("p", 9, [(1, 5.0)])], schema)
    source = spark.createDataFrame([("p", 1, ([1, 3], [[0.0, 0.0, 2.0, 2.0], [1.0, 1.0, 2.0, 2.0]]))], "source_parquet string, id long, objects struct<id:array<long>,bbox:array<array<double>>>")
    row = curation.region_summary(curation.region_boxes(metadata, source)).first()
    assert (row["regions_written"], row["missing_boxes"], row["failures"]) == (1, 1, 1)


SILVER = """{"run_id":" r 1 ","kvp":{"template_id":"t/1","key_values":[{"key":"k","value":0,"score":"0.9","key_bbox":[1,"2",null,4]},
 {"key":"0","value":false,"score":"x"},{"key":null,"value":"v","score":"nan","value_bbox":[1,2]},"no object",{"key":true,"value":1.5}]}}"""


def test_silver_values_are_coerced(spark):
    objects = spark.createDataFrame([("silver/kvp-json/t/a.json", SILVER), ("silver/kvp-json/t/b.json", "{bad"), ("other/x", "{}")], "name string, payload string")
    silver = medallion.parse_silver(objects)
    rows = medallion.gold_fields(silver).orderBy("field_index").collect()
    assert [(r["field_key"], r["field_value"], r["confidence"]) for r in rows] == [("k", "", 0.9), ("0", "", None), ("", "v", None), ("True", "1.5", None)]
    assert (rows[0]["key_bbox_x0"], rows[0]["key_bbox_y0"], rows[0]["key_bbox_x1"], rows[0]["value_bbox_x0"]) == (1.0, 2.0, None, None)
    assert rows[2]["value_bbox_x0"] is None
    run = medallion.gold_runs(silver).collect()
    assert [(r["run_id"], r["template_id"], r["field_count"], r["avg_confidence"]) for r in run] == [("r-1", "t-1", 4, 0.9)]
    assert silver.filter(~F.col("valid")).first()["run_id"] == "b"


def test_upload_reasons(spark):
    rows = [("a.PNG", 1, None), ("a.pdf", 1, "image/png"), ("a.pdf", 1, "x"), ("a.png", 0, None), ("a.png", 60_000_000, None), (None, 1, None)]
    df = spark.createDataFrame(rows, "name string, size long, kind string")
    got = [r["r"] for r in df.select(gates.upload_reason(F.col("name"), F.col("size"), F.col("kind")).alias("r")).collect()]
    assert got[0] is None and got[1] is None
    assert [g.split()[0] for g in got[2:]] == ["Unsupported", "Uploaded", "Uploaded", "Missing"]


def test_ocr_files_one_per_document(spark, tmp_path):
    folder = tmp_path / "train" / "form_a"
    folder.mkdir(parents=True)
    (folder / "p1.ocr.json").write_text('{\n "image_size": {"width": 10, "height": 20},\n "words": ["x"],\n "bboxes": [[0, 0, 1000, 1000]]\n}')
    row = readers.read_ocr(spark, str(tmp_path)).first()
    assert (row["split"], row["template"], row["file"], row["box_format"]) == ("train", "form_a", "p1.ocr.json", "thousand")


def test_history_types(spark, tmp_path):
    (tmp_path / "h.csv").write_text("epoch,loss,note\n1,0.5,ok\n2,,bad\n")
    rows = readers.read_history(spark, str(tmp_path / "h.csv")).orderBy("epoch").collect()
    assert [tuple(r) for r in rows] == [(1, 0.5, "ok"), (2, None, "bad")]


def test_embedding_runs_resume(spark, tmp_path):
    path, calls = str(tmp_path / "vectors"), []
    todo = spark.range(10).withColumn("v", F.array(F.col("id") * 1.0))
    assert writers.append_missing(todo.filter("id < 4"), path, "id", lambda df: df) == 4
    assert writers.append_missing(todo, path, "id", lambda df: calls.append(df.count()) or df) == 6
    assert calls == [6]


def test_short_selection_is_an_error(spark):
    names = spark.createDataFrame([(f"n{i}",) for i in range(5)], "name string")
    none = names.limit(0)
    for frame, skip in ((names, 20), (none, 1)):
        with pytest.raises(Exception, match="too few"):
            curation.select_beyond(frame, [none], "name", [F.col("name")], skip, 10).collect()
    assert curation.select_beyond(names, [none], "name", [F.col("name")], 1, 2).count() == 2
    with pytest.raises(Exception, match="too few"):
        curation.fixed_splits(none, "name", {"train": 1}).collect()


def test_white_space_of_all_kinds_is_stripped(spark):
    from formlake.functions.text import clean_email, stripped

    row = spark.createDataFrame([(" \tA@b.c\n ",)], "v string").select(clean_email(F.col("v")).alias("e"), stripped(F.col("v")).alias("s")).first()
    assert (row["e"], row["s"]) == ("a@b.c", "A@b.c")


def test_class_weights_follow_the_given_list(spark):
    from formlake.operators import evaluation

    labels = spark.createDataFrame([("a",), ("a",), ("b",), ("x",)], "label string")
    got = {r["label"]: (r["n"], r["weight"]) for r in evaluation.class_weights(labels, ["a", "b", "c"]).collect()}
    assert got == {"a": (2, 0.5), "b": (1, 1.0), "c": (0, 1.0)}


def test_bad_uploads_are_refused(spark, tmp_path):
    from formlake.sources import store, writers

    rows = [("r", "t", "f.png", "image/png", b"x", '{"key_values": []}'), ("", "t", "f.png", "image/png", b"x", "{}"),
            ("q", "t", "f.png", "image/png", b"", "{}"), ("s", "t", "f.png", "image/png", b"x", "{bad"), ("u", "t", "f.png", "image/png", b"x", None)]
    frame = spark.createDataFrame([(*r, "2024") for r in rows], "run_id string, template_id string, file_name string, content_type string, image binary, kvp string, created_at string")
    refused = {r["run_id"]: r["refused"] for r in writers.ingest(frame, str(tmp_path)).collect()}
    assert refused == {"q": "empty image", "s": "kvp is no JSON object", "u": "kvp is no JSON object"}
    stored = {r["run_id"] for r in store.read(spark, str(tmp_path), "bronze").collect()}
    assert len(stored) == 2 and "r" in stored and "run" not in stored


def test_corrupted_words_are_counted(spark):
    from formlake.operators import augment

    bank, size = augment.fixed_bank()
    rows = spark.createDataFrame([(["w"] * 10,), (["w"],), ([],)], "words array<string>")
    got = rows.select(augment.corrupted_with_count(F.col("words"), F.lit("k"), bank, size).alias("c")).select("c.*").collect()
    assert [(len(r["words"]), r["n_corrupted"], sum(w != "w" for w in r["words"])) for r in got] == [(10, 2, 2), (1, 1, 1), (0, 0, 0)]


def test_kernel_edits_words_as_the_expression_does(spark):
    """the words of a document are edited by an Arrow kernel, in the plan a Python step."""
    texts = ["Abc", "a", "", " xy\u3000", "[MASK]", "Äß", "Ωmega", "1-2", "ЖЗ", None]
    rows = spark.range(400).select(F.col("id").cast("string").alias("k"), F.element_at(F.array(*map(F.lit, texts)), (F.col("id") % len(texts) + 1).cast("int")).alias("w"))
    for r in rows.select("k", "w", augment.noisy_word(F.col("w"), F.col("k"), F.lit(3)).alias("want")).collect():
        assert augment.edited_letters(r["k"], 3, r["w"]) == r["want"]


def test_edits_of_rows_with_nulls(spark):
    rows = spark.createDataFrame([(1, "a", ["x", "y", "z", "v"]), (2, "a", None), (3, None, ["x", "y"]), (4, "b", []), (5, "c", ["[EMPTY]"]), (6, "d", ["q"])], "id int, k string, ws array<string>")
    edited = rows.select("id", augment.mask_and_corrupt(F.col("ws"), F.col("k"), 0.25, F.lit(0.25), "letters").alias("m")).select("id", "m.*")
    assert "ArrowEvalPython" in edited._jdf.queryExecution().toString()
    got = {r["id"]: r for r in edited.collect()}
    assert len(got[1]["masked"]) == len(got[1]["corrupted"]) == 1 and got[1]["words"][got[1]["masked"][0]] == "[MASK]"
    assert got[2]["words"] is None and got[2]["masked"] == []
    assert (got[3]["words"], got[4]["words"], got[5]["words"], got[6]["words"]) == (["x", "y"], [], ["[EMPTY]"], ["[MASK]"])


def test_arriving_texts_are_more_files_the_more_there_are(spark, tmp_path, monkeypatch):
    """F16, F23: a task that writes or reads arrivals does not grow with the documents."""
    from formlake.plans import streams

    spark.createDataFrame([(i, "ab " * 400) for i in range(20)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert streams.text_files(spark, str(tmp_path)) == 4
    monkeypatch.setattr(streams, "CHARS_PER_FILE", 2400)
    assert streams.text_files(spark, str(tmp_path)) == 10
