"""Arrow kernels of pages against the array expressions of the same rules."""

import random

from pyspark.sql import functions as F

from formlake.functions import boxes
from formlake.functions.arrays import each
from formlake.operators import evaluation, layout, spatial

SCHEMA = "doc_id long, labels array<string>, words array<string>, boxes array<array<int>>, scores array<double>"
LABELS = ["O", "O", "B-KEY", "I-KEY", "B-VAL", "I-VAL", "I-VAL", "B", "B-"]
WORDS = ["Name:", "x", "été ", " ", "\t", "ABC", " ", "", "a b"]


def random_pages(spark, n=60):
    rng = random.Random(5)
    rows = []
    for d in range(n):
        size = rng.choice([0, 1, 2, 9, 40])
        box_list = []
        for _ in range(size):
            x, y = rng.randrange(0, 300), rng.randrange(0, 120)
            box_list.append([x, y, x + rng.randrange(0, 40), y + rng.randrange(0, 25)])
        rows.append((d // 2, [rng.choice(LABELS) for _ in range(size)], [rng.choice(WORDS) for _ in range(size)], box_list, [rng.randrange(100) / 100 for _ in range(size)]))
    rows.append((900, None, None, None, None))
    rows.append((901, [], [], [], []))
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def rows_of(df):
    return sorted(map(repr, df.collect()))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_spans_are_those_of_the_arrays(spark):
    pages = random_pages(spark)
    for strict in (False, True):
        found = layout.span_array(*(F.col(c) for c in ("labels", "words", "boxes", "scores")))
        if strict:
            found = F.filter(found, lambda s: s["starts_b"] & (F.length(s["text"]) > 0))
        score = F.bround("s.score", 4) if strict else F.col("s.score")
        want = each(pages, ["doc_id"], found, "s", "span_id").select("doc_id", "span_id", "s.type", "s.first", "s.last", "s.text", score.alias("score"), "s.box.*")
        got = layout.spans(pages, strict)
        assert got.columns == want.columns and got.dtypes == want.dtypes
        assert rows_of(got) == rows_of(want)
        assert "MapInArrow" in plan_of(got) and "Exchange hash" not in plan_of(got)


def test_spans_as_one_array_per_document(spark):
    pages = random_pages(spark)
    lists = layout.span_lists(pages)
    assert lists.count() == pages.count()
    assert rows_of(lists.select("doc_id", F.inline("spans"))) == rows_of(layout.spans(pages))


def test_lines_are_those_of_the_arrays(spark):
    pages = random_pages(spark)
    line = each(pages, ["doc_id"], layout.line_array(F.col("words"), F.col("boxes")), "line", "line_no")
    want = line.select("doc_id", "line_no", F.size("line").alias("n_words"), layout.line_text(F.col("line")).alias("text"), layout.line_box(F.col("line")).alias("b")).select("doc_id", "line_no", "n_words", "text", "b.*")
    got = layout.lines(pages)
    assert got.dtypes == want.dtypes
    assert rows_of(got) == rows_of(want)
    assert "MapInArrow" in plan_of(got)


def test_rule_pairs_lay_out_only_short_documents(spark):
    pages = random_pages(spark)
    usable = F.filter(layout.line_array(F.col("words"), F.col("boxes")), lambda line: F.length(layout.line_text(line)) >= 2)
    for most in (0, 2, 15):
        want = pages.filter(F.coalesce(F.size(usable), F.lit(0)) <= most).select("doc_id", "words", "boxes")
        got = layout.few_lines(pages, most)
        held = lambda df: sorted(repr(r) for r in df.collect() if r["words"])
        assert held(got) == held(want)
    assert "MapInArrow" in plan_of(layout.rule_pairs(pages))


def test_nearest_keys_are_those_of_all_pairs(spark):
    rng = random.Random(8)
    side = "array<struct<span_id:int,text:string,x0:int,y0:int,x1:int,y1:int>>"

    def some(n, tall):
        out = []
        for i in range(n):
            x, y = rng.randrange(0, 400, 20), rng.randrange(0, tall, 10)
            out.append((i, f"t{i}", x, y, x + rng.randrange(0, 60), y + rng.randrange(0, 40)))
        return out

    rows = [(d, some(rng.choice([0, 1, 3, 30]), tall), some(rng.choice([0, 1, 30]), tall)) for d, tall in enumerate([60, 900, 9000, 90000] * 6)]
    docs = spark.createDataFrame([*rows, (99, None, some(2, 50)), (98, some(2, 50), None)], f"doc_id long, keys {side}, values {side}")
    box = lambda c: boxes.Box(*(F.col(f"{c}.{x}") for x in boxes.Box._fields))
    pairs = docs.select("doc_id", "keys", F.explode("values").alias("v")).select("doc_id", "v", F.explode("keys").alias("k"))
    best = F.min(F.struct(spatial.key_distance(box("v"), box("k")).alias("distance"), F.col("k.span_id").alias("key_id"), F.col("k").alias("key")))
    want = pairs.groupBy("doc_id", "v").agg(best.alias("b")).select("doc_id", "v.span_id", "b.key_id", "b.distance", "b.key", F.col("v").alias("value"))
    got = spatial.nearest_keys(docs)
    assert rows_of(got) == rows_of(want)
    assert "MapInArrow" in plan_of(got)


def test_hull_of_polygon_reads_every_point(spark):
    point = "array<struct<x:double,y:double>>"
    rows = [
        ([(0.2, 0.9), (None, 0.4)], None), ([(-0.5, 0.5), (None, 0.0)], None), ([(None, None)], None), (None, [(30.0, None), (400.0, 20.0)]),
        ([], [(10.0, 10.0)]), (None, None), ([(float("nan"), 0.1), (0.3, 2.0)], None),
    ]
    frame = spark.createDataFrame(rows, f"n {point}, v {point}")
    hull = boxes.of_polygon(F.col("n"), F.col("v"), F.lit(100), F.lit(50))
    got = [r["h"] and tuple(r["h"]) for r in frame.select(hull.alias("h")).collect()]
    assert got == [(0.0, 0.4, 0.2, 0.9), (0.0, 0.0, 0.0, 0.5), (0.0, 0.0, 0.0, 0.0), (0.3, 0.0, 1.0, 0.4), (0.1, 0.2, 0.1, 0.2), None, (0.3, 0.1, 1.0, 1.0)]
    assert "transform" not in frame.select(hull.alias("h"))._jdf.queryExecution().analyzed().toString()  # no lambda for every point


def test_percent_boxes_are_separate_steps(spark):
    from formlake.plans.layout import percent_boxes

    plan = plan_of(percent_boxes(spark, "/root/testdata/sf0.001"))
    assert plan.count("Generate explode") == 2


def test_overlaps_are_joined_once(spark):
    words = spark.createDataFrame([(1, i, i * 20, 0, i * 20 + 15, 10) for i in range(12)], "doc_id long, word_idx int, x0 int, y0 int, x1 int, y1 int")
    areas = spark.createDataFrame(
        [(1, 0, 0, "KEY", 0, 0, 15, 10), (1, 1, 1, "VAL", 20, 0, 36, 10), (1, 2, 2, "VAL", 40, 0, 56, 10), (1, 3, 3, "VAL", 80, 0, 116, 10)],
        "doc_id long, region_idx int, pair_idx int, role string, x0 int, y0 int, x1 int, y1 int",
    )
    near = spatial.scored_overlaps(words, areas)
    assert rows_of(spatial.best_region(words, areas, near=near)) == rows_of(spatial.best_region(words, areas))
    assert rows_of(spatial.region_roles(words, areas, near=near)) == rows_of(spatial.region_roles(words, areas))
    labels = spatial.bio_of_regions(spatial.best_region(words, areas))
    assert plan_of(labels).count("Join") == 1
    assert [r["label"] for r in labels.orderBy("word_idx").collect()] == ["B-KEY", "B-VAL", "B-VAL", "B-VAL", "I-VAL"]
    assert "r_x0" not in plan_of(spatial.coverage_labels(words, areas))  # the overlaps are written before, and read


def paged_regions(spark, repeated):
    """Pages with words and regions of any place, size, role and number, nulls and boxes without extent among them."""
    rng, rows = random.Random(8), []

    def box(wide, tall):
        x, y = rng.randrange(-200, 600), rng.randrange(-100, 900)
        return [x, y, x + rng.randrange(0, wide), y + rng.randrange(0, tall)]

    for d in range(40):
        words = [rng.choice([box(60, 30), box(60, 30), [1, 2], [None, 1, 2, 3]]) for _ in range(rng.choice([0, 1, 30, 90]))]
        areas = [(rng.choice([None, 0, 1, 2, 3, 4]), rng.choice([None, 0, 1, 2]), rng.choice(["KEY", "VAL", "VAL", None]), *box(*rng.choice([(60, 30), (700, 900)]))) for _ in range(rng.choice([0, 5, 40]))]
        areas += [(i, i // 2, "KEY", *words[i]) for i in range(0, min(9, len(words)), 2) if len(words[i]) == 4]
        rows.append((d // 2 if repeated else d, words, areas))
    rows += [(None, [[0, 0, 9, 9]] * 3, [(0, 0, "KEY", 0, 0, 9, 9)]), (700, None, None), (701, [], []), (702, [[0, 0, 9, 9]], None)]
    schema = "doc_id long, boxes array<array<int>>, regions array<struct<region_idx:int,pair_idx:int,role:string,x0:int,y0:int,x1:int,y1:int>>"
    docs = spark.createDataFrame(rows, schema).repartition(3)
    return spatial.Pages(docs, docs.select("doc_id"))


def test_overlaps_in_the_row_are_those_of_the_join(spark):
    for repeated in (False, True):
        pages = paged_regions(spark, repeated)
        words, areas = spatial.word_rows(pages.docs), spatial.region_rows(pages.docs)
        best = spatial.best_region(words, areas)
        assert best.count() > 50
        found = (
            (spatial.best_region(pages), best), (spatial.bio_of_regions(pages), spatial.bio_of_regions(best)),
            (spatial.coverage_labels(pages), spatial.coverage_labels(words, areas)),
        )
        for got, want in found:
            assert got.columns == want.columns and got.dtypes == want.dtypes
            assert rows_of(got) == rows_of(want)
            assert repeated or ("MapInArrow" in plan_of(got) and "Exchange hash" not in plan_of(got))
        marks, again = spatial.region_marks(pages)
        want = evaluation.label_audit(best, spatial.region_roles(words, areas), words)
        if repeated:
            words, areas = spatial.word_rows(again), spatial.region_rows(again)
            got = evaluation.label_audit(spatial.best_region(words, areas), spatial.region_roles(words, areas), words, marks=marks)
        else:
            got = evaluation.label_audit(marks=marks)
        assert got.dtypes == want.dtypes and rows_of(got) == rows_of(want)


def test_a_huge_box_is_dealt_over_the_cells_of_the_other_side(spark):
    far = 2**40
    rows = [(1, [[5, 5, 20, 20], [50, 50, 60, 60]], [(0, 0, "KEY", 0, 0, 30, 30), (1, 1, "VAL", -far, -far, far, far)])]
    schema = "doc_id long, boxes array<array<long>>, regions array<struct<region_idx:int,pair_idx:int,role:string,x0:long,y0:long,x1:long,y1:long>>"
    docs = spark.createDataFrame(rows, schema)
    got = {r["word_idx"]: r["label"] for r in spatial.coverage_labels(spatial.Pages(docs, docs.select("doc_id"))).collect()}
    assert got == {0: "B-VAL", 1: "I-VAL"}
