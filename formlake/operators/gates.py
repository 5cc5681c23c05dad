"""Filters with a reason: uploads, nested objects, languages, payloads, review rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formlake.functions.arrays import bind
from formlake.functions.text import stripped, upload_extension
from formlake.operators.skew import first_rows

# fixed values of the upload gate
MAX_UPLOAD_BYTES = 50 * 1024 * 1024
UPLOAD_EXTENSIONS = (".png", ".jpg", ".jpeg", ".tif", ".tiff")
UPLOAD_TYPES = ("image/jpeg", "image/png", "image/tiff")
# fixed values of the curation filters
MIN_AREA, MIN_OBJECTS = 3.0, 3
MIN_TEXT, MIN_CONFIDENCE, PREVIEW = 40, 0.60, 500


def upload_reason(name: Column, size: Column, content_type: Column) -> Column:
    """Why an upload is rejected; null when it is accepted. Type or extension is enough."""
    allowed = F.coalesce(content_type.isin(*UPLOAD_TYPES), F.lit(False)) | upload_extension(name).isin(*UPLOAD_EXTENSIONS)
    return (
        F.when(name.isNull(), "Missing image file")
        .when(size <= 0, "Uploaded image is empty")
        .when(size > MAX_UPLOAD_BYTES, "Uploaded image is too large. Maximum size is 50MB.")
        .when(~allowed, "Unsupported file type. Upload a PNG, JPG, JPEG, TIF, or TIFF image.")
    )


def qualifying(objects: Column, min_area: float = MIN_AREA) -> Column:
    """Objects (id, area, ..) of the parallel arrays with an id and an area above the limit."""
    return F.filter(objects, lambda o: o["id"].isNotNull() & (o["area"] > min_area))


def fillable(objects: Column, min_area: float = MIN_AREA) -> Column:
    """As `qualifying`, and with a non-empty box."""
    return F.filter(qualifying(objects, min_area), lambda o: F.size(o["bbox"]) > 0)


def keep_templates(rows: DataFrame, kept: Column, least: int = MIN_OBJECTS) -> DataFrame:
    """Rows with at least `least` kept objects, in column `qualifying_objects`."""
    return rows.withColumn("qualifying_objects", kept).filter(F.size("qualifying_objects") >= least)


def is_english(text: Column, lang: Column, confidence: Column, min_text: int = MIN_TEXT, min_confidence: float = MIN_CONFIDENCE) -> Column:
    return F.coalesce((F.length(text) >= min_text) & (lang == "en") & (confidence >= min_confidence), F.lit(False))


def language_records(docs: DataFrame) -> DataFrame:
    """Gate record of every document (columns text, lang, confidence), with a preview of its text.

    Texts under the length limit get no language.
    """
    long = F.length("text") >= MIN_TEXT
    return docs.withColumn("is_english", is_english(F.col("text"), F.col("lang"), F.col("confidence"))).select(
        "doc_id",
        F.when(long, F.col("lang")).alias("language"),
        F.when(long, F.col("confidence")).otherwise(F.lit(0.0)).alias("confidence"),
        "is_english",
        F.length("text").alias("ocr_text_length"),
        F.substring("text", 1, PREVIEW).alias("ocr_preview"),
    )


def language_counts(records: DataFrame) -> DataFrame:
    return records.agg(F.count("*").alias("processed_files"), F.count_if("is_english").alias("english_files"))


def valid_payload(text: Column) -> Column:
    """The cached OCR payload parses and has an image size, words and boxes."""
    parsed = F.from_json(text, "struct<image_size:struct<width:int,height:int>,words:array<string>,boxes:array<array<double>>>")
    return F.coalesce(
        bind(parsed, lambda p: p["image_size"].isNotNull() & p["words"].isNotNull() & p["boxes"].isNotNull()), F.lit(False)
    )


def mismatched(words: Column, boxes: Column) -> Column:
    return (F.size(words) != F.size(boxes)) | words.isNull() | boxes.isNull()


def repaired(words: Column, boxes: Column) -> Column:
    """Struct (words, boxes): an empty or mismatched payload becomes one `[EMPTY]` word."""
    blank = F.struct(F.array(F.lit("[EMPTY]")).alias("words"), F.array(F.array(*map(F.lit, (0, 0, 1, 1)))).alias("boxes"))
    return F.when(mismatched(words, boxes) | (F.size(words) == 0), blank).otherwise(F.struct(words.alias("words"), boxes.alias("boxes")))


def review_pairs(rows: DataFrame) -> DataFrame:
    """Trimmed review rows without the empty ones; custom values lose score and boxes and are marked."""
    custom = F.col("value_mode") == "custom"

    def kept(c: str) -> Column:
        return F.when(~custom, F.col(c)).alias(c)

    trimmed = rows.withColumn("key", stripped(F.coalesce("key", F.lit("")))).withColumn("value", stripped(F.coalesce("value", F.lit(""))))
    others = [c for c in rows.columns if c not in ("key", "value", "value_mode", "score", "key_bbox", "value_bbox")]
    return trimmed.filter((F.length("key") > 0) | (F.length("value") > 0)).select(
        *others, "key", "value", kept("score"), kept("key_bbox"), kept("value_bbox"), F.when(custom, F.lit("custom")).alias("source")
    )


def suggestions(pairs: DataFrame, by: str, column: str, order: str, limit: int | None = 8) -> DataFrame:
    """Case-insensitively distinct values per `by`, first occurrence kept, in order; the first `limit` shown."""
    folded = F.lower(stripped(F.col(column)))
    first = pairs.withColumn("folded", folded).filter(F.length("folded") > 0).groupBy(by, "folded").agg(
        F.min(F.struct(order, column)).alias("f")
    )
    rows = first.select(by, F.col(f"f.{order}").alias(order), F.col(f"f.{column}").alias(column))
    if limit is None:
        return rows
    place = F.row_number().over(Window.partitionBy(by).orderBy(order))
    return rows.withColumn("place", place).filter(F.col("place") <= limit)


def limit_templates(queries: DataFrame, gallery: DataFrame, template: str, order: list[Column], templates: int) -> tuple[DataFrame, DataFrame]:
    """First templates in order, and only their queries."""
    kept = first_rows(gallery, [*order, F.col(template)], templates)
    return queries.join(kept.select(template), template, "left_semi"), kept


def tagged(objects: DataFrame, tag: str, name: str = "name") -> DataFrame:
    """Objects whose name holds the tag: the dry run of a purge."""
    return objects.filter(F.contains(F.col(name), F.lit(tag)))


def without(objects: DataFrame, doomed: DataFrame, name: str = "name") -> DataFrame:
    """The objects that stay after a purge."""
    return objects.join(doomed.select(name), name, "left_anti")
