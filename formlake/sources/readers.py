"""Reading source tables, OCR files, manifests, histories and object listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formlake.functions.text import TOKEN_PATTERN, stripped
from formlake.operators.augment import WORD_BANK
from formlake.operators.medallion import object_kind

SOURCE_SCHEMA = (
    "id long, image_id long, file_name string, width int, height int, image struct<bytes:binary>, "
    "objects struct<id:array<long>,area:array<double>,bbox:array<array<double>>>"
)
# a payload names its boxes `boxes` (pixels) or `bboxes` (0-1000)
PAYLOAD_SCHEMA = (
    "image_path string, image_size struct<width:int,height:int>, word_count int, words array<string>, "
    "boxes array<array<double>>, bboxes array<array<double>>, confidences array<double>, engine string"
)
WORD = "struct<text:string,bbox:array<double>>"
BLOCK_WORD = "struct<text:string,box:array<double>>"
LAYOUTS = f"struct<words:array<{WORD}>,pages:array<struct<words:array<{WORD}>>>,form:array<struct<words:array<{BLOCK_WORD}>>>>"


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """Ids and nested objects only; the image bytes are never read."""
    return spark.read.schema(SOURCE_SCHEMA).parquet(path).select("id", "objects")


def read_ocr(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """OCR payloads with the last parts of their path: split, template and file."""
    rows = spark.read.schema(PAYLOAD_SCHEMA).option("multiLine", multi_line).option("recursiveFileLookup", True).json(path)
    parts = F.split(F.col("_metadata.file_path"), "/")
    return rows.select(
        F.get(parts, F.size(parts) - 3).alias("split"), F.get(parts, F.size(parts) - 2).alias("template"), F.element_at(parts, -1).alias("file"),
        "image_size", "words", F.coalesce("boxes", "bboxes").alias("boxes"), F.when(F.col("boxes").isNotNull(), "pixel").otherwise("thousand").alias("box_format"),
        "confidences",
    )


def any_layout_words(text: Column) -> Column:
    """Words (text, bbox) of the three known layouts, null for an unknown one.

    Blank words are dropped where they come from pages or forms.
    """
    parsed = F.from_json(text, LAYOUTS)

    def filled(words: Column) -> Column:
        return F.filter(words, lambda w: F.length(stripped(F.coalesce(w["text"], F.lit("")))) > 0)

    def renamed(words: Column) -> Column:
        return F.transform(words, lambda w: F.struct(w["text"].alias("text"), w["box"].alias("bbox")))

    none = F.array().cast(f"array<{WORD}>")
    pages = F.flatten(F.transform(parsed["pages"], lambda p: F.coalesce(p["words"], none)))
    forms = F.flatten(F.transform(parsed["form"], lambda b: F.coalesce(renamed(b["words"]), none)))
    return F.coalesce(parsed["words"], filled(pages), filled(forms))


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; bad lines are kept in `_corrupt_record` when the schema names it."""
    return spark.read.schema(schema).json(path)


def word_bank(text: Column) -> Column:
    """Words of a bank given as a list, as {words: []} or as keys; without any usable word the fixed bank."""
    v = F.try_parse_json(text)
    as_list = F.coalesce(F.try_variant_get(v, "$", "array<string>"), F.try_variant_get(v, "$.words", "array<string>"))
    words = F.coalesce(as_list, F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")))
    clean = F.filter(F.transform(words, lambda w: stripped(w)), lambda w: w.rlike(TOKEN_PATTERN))
    fallback = F.array(*(F.lit(w) for w in WORD_BANK))
    return F.when(F.size(clean) > 0, clean).otherwise(fallback)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """CSV training history: `epoch` as int, other columns as double where all their values parse, else text.

    Whether a column is numeric is one aggregate over the file.
    """
    raw = spark.read.option("header", True).csv(path)
    names = [c for c in raw.columns if c != "epoch"]
    parses = raw.agg(*(F.bool_and(F.col(c).isNull() | F.col(c).try_cast("double").isNotNull()).alias(c) for c in names)).first()
    return raw.select(
        F.col("epoch").try_cast("int").alias("epoch"), *(F.col(c).try_cast("double").alias(c) if parses[c] else F.col(c) for c in names)
    )


def list_objects(spark: SparkSession, root: str, prefix: str = "") -> DataFrame:
    """Objects under a root: name, kind, size and time, newest first. File contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")
    base = F.lit(root.rstrip("/") + "/")
    name = F.substring("path", F.locate(root.rstrip("/") + "/", F.col("path")) + F.length(base), F.length("path"))
    rows = files.select(name.alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("last_modified"))
    return rows.filter(F.col("name").startswith(prefix)).withColumn("kind", object_kind(F.col("name"))).orderBy(F.desc("last_modified"), "name")
