"""Label and link quality: class weights, audits, entity and link precision and recall."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TINY_GAP = 1e-3


def class_weights(labels: DataFrame, classes: list[str], label: str = "label") -> DataFrame:
    """Count per class of the given list and its inverse-frequency weight total / (classes x count).

    Labels outside the list don't count; a class that doesn't occur weighs as if it occurred once.
    """
    known = labels.filter(F.col(label).isin(*classes))
    listed = labels.sparkSession.createDataFrame([(c,) for c in classes], f"{label} string")
    counts = listed.join(known.groupBy(label).agg(F.count("*").alias("n")), label, "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    total = known.agg(F.count("*")).scalar()
    return counts.withColumn("weight", total / (F.lit(len(classes)) * F.greatest(F.col("n"), F.lit(1))))


def mislabelled(assigned: DataFrame, expected: DataFrame, words: DataFrame) -> DataFrame:
    """(doc_id, words, mislabelled) of word rows, and the rows of both labels."""
    joined = (
        words.select("doc_id", "word_idx")
        .join(assigned.select("doc_id", "word_idx", "role").hint("merge"), ["doc_id", "word_idx"], "left")
        .join(expected.hint("merge"), ["doc_id", "word_idx"], "left")
    )
    wrong = (F.coalesce("role", F.lit("O")) != F.coalesce("expected", F.lit("O"))).cast("int")
    return joined.groupBy("doc_id").agg(F.count("*").alias("words"), F.sum(wrong).alias("mislabelled"))


def mislabelled_of_marks(marks: DataFrame) -> DataFrame:
    """(doc_id, words, mislabelled) of rows (doc_id, n_words, marked), as `spatial.region_marks` has them; words that are not marked are right."""
    wrong = F.filter("marked", lambda m: F.coalesce(m["role"], F.lit("O")) != F.coalesce(m["expected"], F.lit("O")))
    return marks.filter("n_words > 0").select("doc_id", F.col("n_words").alias("words"), F.size(wrong).cast("long").alias("mislabelled"))


def label_audit(assigned: DataFrame | None = None, expected: DataFrame | None = None, words: DataFrame | None = None, warn_above: float = 0.15, marks: DataFrame | None = None) -> DataFrame:
    """Mislabelled words per document and, in the row with null doc_id, overall.

    The words and labels come as rows, as one row of `marks` per document, or some documents in either way.
    """
    parts = ([] if marks is None else [mislabelled_of_marks(marks)]) + ([] if words is None else [mislabelled(assigned, expected, words)])
    per = reduce(DataFrame.unionByName, parts).rollup("doc_id").agg(F.sum("words").alias("words"), F.sum("mislabelled").alias("mislabelled"))
    rate = F.col("mislabelled") / F.col("words")
    return per.withColumn("rate", F.round(rate, 6)).withColumn("noisy", rate > warn_above)


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def precision_recall(truth: Column, predicted: Column, correct: Column) -> list[Column]:
    p, r = ratio(correct, predicted), ratio(correct, truth)
    return [
        F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(ratio(2 * p * r, p + r), 6).alias("f1"),
    ]


def entity_scores(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Precision, recall and F1 per entity type and overall (type null).

    Both frames: span rows with doc_id, type, first, last.
    """
    keys = ["doc_id", "type", "first", "last"]
    marked = truth.select(*keys, F.lit(1).alias("t"), F.lit(0).alias("p")).unionByName(
        predicted.select(*keys, F.lit(0).alias("t"), F.lit(1).alias("p"))
    )
    merged = marked.groupBy(*keys).agg(F.max("t").alias("t"), F.max("p").alias("p"))
    counts = merged.rollup("type").agg(
        F.sum("t").alias("truth"), F.sum("p").alias("predicted"), F.sum(F.col("t") * F.col("p")).alias("correct")
    )
    return counts.select("type", "truth", "predicted", "correct", *precision_recall(F.col("truth"), F.col("predicted"), F.col("correct")))


def token_accuracy(pairs: DataFrame, truth: str, predicted: str) -> DataFrame:
    return pairs.agg(F.round(F.avg((F.col(truth) == F.col(predicted)).cast("double")), 6).alias("accuracy"))


def select_links(links: DataFrame, least: float = 0.5) -> DataFrame:
    """Father links of each son within 1e-3 of its best probability; both ends must be classed.

    links: doc_id, son, father, prob, son_type, father_type. Probabilities under
    `least` count as no link; a best of exactly `least` keeps every link at it.
    """
    strong = links.filter(F.col("prob") >= least)
    best = F.max("prob").over(Window.partitionBy("doc_id", "son"))
    bar = F.when(best > least, best - TINY_GAP).otherwise(F.lit(0.0))
    return strong.withColumn("bar", bar).filter((F.col("prob") > F.col("bar")) & _classed()).drop("bar")


def one_father(links: DataFrame, weight: str = "weight") -> DataFrame:
    """The father links of each son with the highest weight, ties kept."""
    usable = links.filter((F.col(weight) != 0) & _classed())
    order = Window.partitionBy("doc_id", "son").orderBy(F.desc(weight))
    return usable.withColumn("r", F.rank().over(order)).filter("r = 1").drop("r")


def _classed() -> Column:
    return (F.col("son_type") != "O") & (F.col("father_type") != "O")


LINK = ["doc_id", "father", "son"]


def link_report(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Each link as RIGHT (in both), ERROR (only predicted) or MISS (only true)."""
    t = truth.select(*LINK).distinct().withColumn("t", F.lit(True))
    p = predicted.select(*LINK).distinct().withColumn("p", F.lit(True))
    status = F.when(F.col("t").isNull(), "ERROR").when(F.col("p").isNull(), "MISS").otherwise("RIGHT")
    return t.join(p, LINK, "full").select(*LINK, status.alias("status"))


def link_scores(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Micro precision, recall and F1 of links over all documents."""

    def is_(*names: str) -> Column:
        return F.count_if(F.col("status").isin(*names))

    counts = link_report(truth, predicted).agg(
        is_("RIGHT", "MISS").alias("truth"), is_("RIGHT", "ERROR").alias("predicted"), is_("RIGHT").alias("correct")
    )
    return counts.select("truth", "predicted", "correct", *precision_recall(F.col("truth"), F.col("predicted"), F.col("correct")))


def shared_links(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    return truth.select(*LINK).intersect(predicted.select(*LINK))
