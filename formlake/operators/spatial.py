"""Joins between boxes of one page that never pair all boxes of the page.

The nearest key of a value is searched inside the document's row. For overlaps, boxes are dealt onto a grid, so only boxes that share a cell meet.
Each overlapping pair is kept only in the cell that holds the top-left corner of the overlap, so no de-duplication is needed.
A document whose words and regions come in one row (`Pages`) is searched there and nothing is shuffled; words and regions that
come as rows, and documents whose id comes again, are joined by cell, where one long page spreads over many join keys.

Joins of exploded rows carry the merge hint: their size is estimated from the stored
documents, far below what the explode yields, and must not lead to a broadcast.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formlake.functions import boxes
from formlake.functions.arrays import each
from formlake.operators import pagekernels
from formlake.operators.skew import join_on_counted_key
from formlake.session import cut

CELL = 128
REACHES = (128, 2048)


class Pages(NamedTuple):
    """Documents as rows: doc_id, boxes (of the words, arrays of four) and regions, an array of structs (region_idx, pair_idx, role, x0, y0, x1, y1).

    `ids`: the doc_id of all documents; it is read apart, to find those that come more than once.
    """

    docs: DataFrame
    ids: DataFrame

    def parts(self) -> tuple[DataFrame, DataFrame | None]:
        """Documents that are one row, and those whose id comes in several rows, if any: words of one row meet the regions of the others."""
        again = cut(self.ids.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"))
        if again.isEmpty():
            return self.docs, None
        return self.docs.join(again, "doc_id", "left_anti"), self.docs.join(again, "doc_id", "left_semi")

    def run(self, docs: DataFrame, kernel: Callable[[pa.RecordBatch, float, int], dict[str, pa.Array]], threshold: float, fields: str) -> DataFrame:
        region = self.docs.schema["regions"].dataType.elementType
        kinds = {"doc_id": self.docs.schema["doc_id"].dataType, "region_idx": region["region_idx"].dataType}
        schema = T.StructType([T.StructField(f.name, kinds.get(f.name, f.dataType)) for f in T.StructType.fromDDL(fields)])
        return pagekernels.on_documents(docs.select("doc_id", "boxes", "regions"), lambda batch: kernel(batch, threshold, CELL), schema)


def word_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, word_idx, x0, y0, x1, y1) of the documents' words."""
    rows = each(docs, ["doc_id"], F.col("boxes"), "box", "word_idx")
    return rows.select("doc_id", "word_idx", *(v.alias(c) for c, v in zip(boxes.Box._fields, boxes.of_array(F.col("box")))))


def region_rows(docs: DataFrame) -> DataFrame:
    """The documents' regions as rows."""
    return each(docs, ["doc_id"], F.col("regions"), "r").select("doc_id", "r.*")


def overlap_join(words: DataFrame, regions: DataFrame, doc: str = "doc_id", cell: int = CELL) -> DataFrame:
    """All (word, region) rows of a document whose boxes overlap; region columns get the prefix `r_`."""
    w, r = boxes.columns(), boxes.columns("r_")
    renamed = regions.select(doc, *(F.col(c).alias(f"r_{c}") for c in regions.columns if c != doc))
    left, right = _cells(words, w, cell), _cells(renamed, r, cell)
    inter = boxes.intersection(w, r)
    owner = (F.floor(inter.x0 / cell) == F.col("cx")) & (F.floor(inter.y0 / cell) == F.col("cy"))
    return left.join(right.hint("merge"), [doc, "cx", "cy"]).filter((inter.x0 < inter.x1) & (inter.y0 < inter.y1) & owner).drop("cx", "cy")


def _cells(df: DataFrame, b: boxes.Box, cell: int) -> DataFrame:
    def span(low: Column, high: Column) -> Column:
        return F.explode(F.sequence(F.floor(low / cell), F.floor(high / cell)))

    # a box without extent overlaps nothing
    return df.filter((b.x1 > b.x0) & (b.y1 > b.y0)).withColumn("cx", span(b.x0, b.x1)).withColumn("cy", span(b.y0, b.y1))


def best_region(words: DataFrame | Pages, regions: DataFrame | None = None, threshold: float = 0.3, near: DataFrame | None = None) -> DataFrame:
    """(doc_id, word_idx, region_idx, role, iou): best region per word; the first region wins ties.

    `words`: rows, or `Pages`, which hold their regions. `near`: the `scored_overlaps` of both, where they are at hand.
    """
    if isinstance(words, Pages):
        return _tagged_best(words, threshold).drop("label")
    near = scored_overlaps(words, regions, threshold) if near is None else near
    best = F.max(F.struct("iou", (-F.col("region_idx")).alias("first"), "role"))
    return near.groupBy("doc_id", "word_idx").agg(best.alias("b")).select(
        "doc_id", "word_idx", (-F.col("b.first")).alias("region_idx"), F.col("b.role").alias("role"), F.col("b.iou").alias("iou")
    )


def scored_overlaps(words: DataFrame, regions: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, word_idx, region_idx, role, iou) of all overlapping pairs that reach the threshold."""
    score = boxes.iou(boxes.columns(), boxes.columns("r_"))
    near = overlap_join(words, regions).withColumn("iou", score).filter(F.col("iou") >= threshold)
    return near.select("doc_id", "word_idx", F.col("r_region_idx").alias("region_idx"), F.col("r_role").alias("role"), "iou")


def region_roles(words: DataFrame, regions: DataFrame, threshold: float = 0.3, near: DataFrame | None = None) -> DataFrame:
    """Expected role per matched word: KEY if any key region reaches the threshold, else VAL; `near` as in `best_region`."""
    near = scored_overlaps(words, regions, threshold) if near is None else near
    expected = F.when(F.max((F.col("role") == "KEY").cast("int")) == 1, "KEY").otherwise("VAL")
    return near.groupBy("doc_id", "word_idx").agg(expected.alias("expected"))


def _tagged_best(pages: Pages, threshold: float) -> DataFrame:
    """`best_region` with the `label` of `bio_of_regions`."""
    alone, again = pages.parts()
    rows = pages.run(alone.filter(F.col("doc_id").isNotNull()), pagekernels.best_regions, threshold, "doc_id long, word_idx int, region_idx int, role string, iou double, label string")
    return rows if again is None else rows.unionByName(bio_of_regions(best_region(word_rows(again), region_rows(again), threshold)))


def region_marks(pages: Pages, threshold: float = 0.3) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, n_words, marked) of the documents that are one row, `marked` an array of (role, expected) of the words with a region: that of
    `best_region` and that of `region_roles`; and the documents whose id comes again, if any."""
    alone, again = pages.parts()
    unknown = F.when(F.col("doc_id").isNotNull(), F.col("regions")).otherwise(F.array().cast(pages.docs.schema["regions"].dataType))
    return pages.run(alone.withColumn("regions", unknown), pagekernels.audited, threshold, "doc_id long, n_words long, marked array<struct<role:string,expected:string>>"), again


def coverage_labels(words: DataFrame | Pages, regions: DataFrame | None = None, threshold: float = 0.3) -> DataFrame:
    """BIO label per covered word; a later pair overwrites an earlier one, and its value its key."""
    if isinstance(words, Pages):
        alone, again = words.parts()
        rows = words.run(alone.filter(F.col("doc_id").isNotNull()), pagekernels.covered, threshold, "doc_id long, word_idx int, label string")
        return rows if again is None else rows.unionByName(coverage_labels(word_rows(again), region_rows(again), threshold))
    share = boxes.coverage(boxes.columns(), boxes.columns("r_"))
    near = overlap_join(words, regions).filter(share >= threshold).select(
        "doc_id", "word_idx", F.col("r_pair_idx").alias("pair_idx"), F.col("r_role").alias("role")
    )
    # written once: it is read for the counts and for the labels, and the overlaps are joined only once
    near = cut(near).withColumn("region", F.struct("doc_id", "pair_idx", "role"))
    first = near.groupBy("region").agg(F.min("word_idx").alias("first"), F.count("*").alias("n"))
    tag = F.concat(F.when(F.col("word_idx") == F.col("first"), F.lit("B-")).otherwise(F.lit("I-")), F.col("role"))
    last = F.max(F.struct("pair_idx", (F.col("role") == "VAL").alias("v"), tag.alias("label")))
    return (
        join_on_counted_key(near, first, "region", "n", "word_idx")  # one region may cover most words
        .groupBy("doc_id", "word_idx").agg(last.alias("l")).select("doc_id", "word_idx", F.col("l.label").alias("label"))
    )


def bio_of_regions(matches: DataFrame | Pages, threshold: float = 0.3) -> DataFrame:
    """`I-` when the previous word of the document matched the same region, else `B-`. Of `Pages`: with their `best_region`."""
    if isinstance(matches, Pages):
        return _tagged_best(matches, threshold)
    order = Window.partitionBy("doc_id").orderBy("word_idx")  # matches are rows of one document, one per word
    follows = (F.lag("word_idx").over(order) == F.col("word_idx") - 1) & (F.lag("region_idx").over(order) == F.col("region_idx"))
    tag = F.concat(F.when(F.coalesce(follows, F.lit(False)), F.lit("I-")).otherwise(F.lit("B-")), F.col("role"))
    return matches.withColumn("label", tag)


# ---- nearest key ------------------------------------------------------------------------


def key_distance(value: boxes.Box, key: boxes.Box) -> Column:
    """Distance of a value to a key: gap plus twice the vertical offset on one line, else Euclid;
    250 more when the key is not to the left, 100 more when on another line."""
    dy = F.abs(boxes.center_y(value) - boxes.center_y(key))
    dx = F.abs(boxes.center_x(value) - boxes.center_x(key))
    tall = F.greatest(boxes.height(value), boxes.height(key))
    same_line = (boxes.vertical_overlap(value, key) >= 0.35) | (dy <= F.greatest(F.lit(12.0), tall * 0.75))
    gap = (
        F.when(key.x1 <= value.x0, (value.x0 - key.x1).cast("double"))
        .when(value.x1 <= key.x0, (key.x0 - value.x1).cast("double"))
        .otherwise(F.lit(0.0))
    )
    base = F.when(same_line, gap + dy * 2).otherwise(F.sqrt(dx * dx + dy * dy))
    left = F.when(boxes.center_x(key) <= boxes.center_x(value), 0.0).otherwise(250.0)
    return base + left + F.when(same_line, 0.0).otherwise(100.0)


def distance_score(distance: Column) -> Column:
    return F.bround(1 / (1 + distance / 100), 4)


def nearest_keys(docs: DataFrame) -> DataFrame:
    """(doc_id, span_id, key_id, distance, key, value): nearest key of every value, the spans as structs; the first key wins ties.

    docs: doc_id, keys and values, arrays of structs with span_id and a box. A document is one row and is
    searched there, window by window of its keys: no join, nothing is shuffled.
    """
    key, value = (docs.schema[c].dataType.elementType for c in ("keys", "values"))
    fields = T.StructType([
        docs.schema["doc_id"], T.StructField("span_id", value["span_id"].dataType), T.StructField("key_id", key["span_id"].dataType),
        T.StructField("distance", T.DoubleType()), T.StructField("key", key), T.StructField("value", value),
    ])
    asked = docs.filter(F.size("keys") > 0).select("doc_id", "keys", "values")
    return pagekernels.on_documents(asked, lambda batch: pagekernels.nearest_keys(batch, REACHES), fields)


def pair_rows(found: DataFrame) -> DataFrame:
    """Pairs of `nearest_keys` as rows: texts, score and both boxes."""
    corners = [F.col(f"{side}.{c}").cast("double").alias(f"{side}_{c}") for side in ("key", "value") for c in boxes.Box._fields]
    return found.select("doc_id", "span_id", "key_id", "distance", distance_score(F.col("distance")).alias("score"), F.col("key.text").alias("key"), F.col("value.text").alias("value"), *corners)
