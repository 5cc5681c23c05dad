"""Bronze image, silver key/value JSON, gold fields and run roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formlake.functions.arrays import each, mean
from formlake.functions.text import blank_to_null, clean_key_part, parse_number, path_stem

BRONZE, SILVER = "bronze/raw-images/", "silver/kvp-json/"
GOLD = {"form_runs": "gold/form-runs/", "extracted_fields": "gold/extracted-fields/", "manifests": "gold/manifests/"}


def object_kind(name: Column) -> Column:
    return F.when(name.startswith(BRONZE), "bronze").when(name.startswith(SILVER), "silver").otherwise("other")


def parse_path(name: Column, prefix: str) -> Column:
    """Struct (template_id, run_id) of an object path, null when it does not fit the prefix."""
    parts = F.split(name, "/")
    fits = (F.size(parts) >= 4) & name.startswith(prefix)
    if prefix == SILVER:
        fits = fits & name.endswith(".json")
    return F.when(fits, F.struct(F.get(parts, F.lit(2)).alias("template_id"), path_stem(name).alias("run_id")))


def object_path(prefix: str, template_id: Column, run_id: Column, extension: Column) -> Column:
    return F.concat(F.lit(prefix), clean_key_part(template_id, F.lit("unknown")), F.lit("/"), clean_key_part(run_id, F.lit("")), F.lit("."), extension)


# ---- silver payloads ------------------------------------------------------------------------


def _text(payload: Column, path: str) -> Column:
    return F.try_variant_get(payload, path, "string")


def _kind(value: Column) -> Column:
    """STRING, BOOLEAN, BIGINT, OBJECT<..>; VOID or null for JSON null and absent fields."""
    return F.schema_of_variant(value)


def _field_text(pair: Column, name: str) -> Column:
    """Text of a JSON field; null, false, 0 and '' become blank, and a quoted "0" stays."""
    value = F.try_variant_get(pair, f"$.{name}", "variant")
    text, kind = F.try_variant_get(value, "$", "string"), _kind(value)
    return (
        F.when(text.isNull(), F.lit(""))
        .when(kind == "STRING", text)
        .when(kind == "BOOLEAN", F.when(text == "true", "True").otherwise(""))
        .when(text.try_cast("double") == 0, F.lit(""))
        .otherwise(text)
    )


def _number(value: Column) -> Column:
    """Double of a JSON number or numeric text; null otherwise."""
    text = F.try_variant_get(value, "$", "string")
    return F.when(_kind(value) == "BOOLEAN", (text == "true").cast("double")).otherwise(parse_number(text))


def _pair(pair: Column) -> Column:
    fields = [_field_text(pair, "key").alias("field_key"), _field_text(pair, "value").alias("field_value")]
    fields.append(_number(F.try_variant_get(pair, "$.score", "variant")).alias("confidence"))
    for side in ("key", "value"):
        box = F.try_variant_get(pair, f"$.{side}_bbox", "array<variant>")
        for i, corner in enumerate(("x0", "y0", "x1", "y1")):
            fields.append(F.when(F.size(box) >= 4, _number(F.get(box, F.lit(i)))).alias(f"{side}_bbox_{corner}"))
    return F.struct(*fields)


def parse_silver(objects: DataFrame) -> DataFrame:
    """Objects (name, payload text) with their parsed metadata and pairs; `valid` is false for bad JSON.

    Values of the envelope go before those of its `kvp` part, and the path comes last.
    """
    parsed = objects.withColumn("path", parse_path(F.col("name"), SILVER)).filter(F.col("path").isNotNull())
    v = F.try_parse_json(F.col("payload"))
    parsed = parsed.withColumn("v", v)

    def first(name: str, fallback: Column | None = None) -> Column:
        choices = [blank_to_null(_text(F.col("v"), f"$.{name}")), blank_to_null(_text(F.col("v"), f"$.kvp.{name}"))]
        return F.coalesce(*choices, *([fallback] if fallback is not None else []))

    inner = F.try_variant_get(F.col("v"), "$.kvp.key_values", "array<variant>")
    outer = F.try_variant_get(F.col("v"), "$.key_values", "array<variant>")
    pairs = F.filter(F.coalesce(inner, outer, F.array().cast("array<variant>")), lambda p: _kind(p).startswith("OBJECT"))
    path = F.col("path")
    return parsed.select(
        F.col("name").alias("silver_path"),
        F.coalesce(_kind(F.col("v")).startswith("OBJECT"), F.lit(False)).alias("valid"),
        clean_key_part(first("run_id", path["run_id"]), path["run_id"]).alias("run_id"),
        clean_key_part(first("template_id", path["template_id"]), path["template_id"]).alias("template_id"),
        first("source_file_name").alias("source_file_name"),
        first("created_at").alias("created_at"),
        F.coalesce(blank_to_null(_text(F.col("v"), "$.image_object")), blank_to_null(_text(F.col("v"), "$.bronze_path"))).alias("bronze_path"),
        F.transform(pairs, _pair).alias("pairs"),
    )


def gold_fields(silver: DataFrame, transformed_at: Column | None = None) -> DataFrame:
    """One row per key/value pair; invalid objects have no pairs."""
    stamp = F.lit(None).cast("string") if transformed_at is None else transformed_at
    keep = ["run_id", "template_id", "source_file_name", "silver_path", "created_at", stamp.alias("transformed_at")]
    rows = each(silver, keep, F.col("pairs"), "p", "field_index")
    return rows.select(*(c for c in rows.columns if c != "p"), "p.*")


def gold_runs(silver: DataFrame, transformed_at: Column | None = None) -> DataFrame:
    """One row per run: field count and confidence range, computed inside the row; runs without fields stay."""
    stamp = F.lit(None).cast("string") if transformed_at is None else transformed_at
    confidences = F.filter(F.transform("pairs", lambda p: p["confidence"]), lambda c: c.isNotNull())

    def path(prefix: str, extension: str) -> Column:
        return F.concat(F.lit(prefix), F.col("template_id"), F.lit("/"), F.col("run_id"), F.lit(extension))

    return silver.filter("valid").withColumn("c", confidences).select(
        "run_id", "template_id", "source_file_name", "bronze_path", "silver_path",
        path(GOLD["form_runs"], ".json").alias("gold_form_run_path"),
        path(GOLD["extracted_fields"], ".jsonl").alias("gold_fields_path"),
        path(GOLD["manifests"], ".json").alias("gold_manifest_path"),
        F.size("pairs").alias("field_count"),
        F.when(F.size("c") > 0, mean(F.col("c"))).alias("avg_confidence"),
        F.array_min("c").alias("min_confidence"), F.array_max("c").alias("max_confidence"),
        "created_at", stamp.alias("transformed_at"), F.lit("gold_ready").alias("status"),
    )


def gold_summary(objects: DataFrame) -> DataFrame:
    """Number of gold objects per kind."""
    return objects.agg(*(F.count_if(F.col("name").startswith(p)).alias(k) for k, p in GOLD.items()))


def in_scope(objects: DataFrame, template_id: str | None = None, run_id: str | None = None) -> DataFrame:
    """Silver objects of a template, of a run, or of one run of a template.

    The conditions are on the path, so a store partitioned by template reads one folder.
    """
    name = F.col("name")
    kept = objects.filter(parse_path(name, SILVER).isNotNull())
    if template_id and run_id:
        return kept.filter(name == object_path(SILVER, F.lit(template_id), F.lit(run_id), F.lit("json")))
    if template_id:
        kept = kept.filter(name.startswith(F.concat(F.lit(SILVER), clean_key_part(F.lit(template_id), F.lit("unknown")), F.lit("/"))))
    if run_id:
        kept = kept.filter(path_stem(name) == clean_key_part(F.lit(run_id), F.lit("")))
    return kept


# ---- form listing -----------------------------------------------------------------------------


def list_forms(bronze: DataFrame, silver: DataFrame) -> DataFrame:
    """Forms by (template, run) from both tiers, newest first.

    bronze: name, last_modified (ISO text). silver: also payload. A form is processed
    once it has a silver object. Each side is aggregated before the join, so the join
    has one row per form on both sides.
    """
    keys = ["template_id", "run_id"]

    def keyed(df: DataFrame, prefix: str) -> DataFrame:
        return df.withColumn("p", parse_path(F.col("name"), prefix)).filter("p is not null").select("*", "p.*").drop("p")

    first = F.min(F.struct("name", "last_modified"))["last_modified"]
    b = keyed(bronze, BRONZE).groupBy(*keys).agg(F.max("name").alias("bronze_path"), first.alias("bronze_time"))
    parsed = keyed(silver, SILVER).withColumn("v", F.try_parse_json(F.col("payload")))
    created = blank_to_null(_text(F.col("v"), "$.created_at"))
    s = (
        parsed.withColumn("created", created).withColumn("file", _text(F.col("v"), "$.source_file_name")).drop("v", "payload")
        .groupBy(*keys).agg(
            F.max("name").alias("silver_path"), first.alias("silver_time"),
            F.max(F.struct("name", "file"))["file"].alias("source_file_name"),
            F.max(F.when(F.col("created").isNotNull(), F.struct("name", "created")))["created"].alias("created"),
        )
    )
    status = F.when(F.col("silver_path").isNotNull(), "processed").otherwise("pending")
    joined = b.join(s, keys, "full").select(
        *keys, status.alias("status"), "bronze_path", "silver_path", "source_file_name",
        F.coalesce("created", "bronze_time", "silver_time").alias("created_at"),
    )
    return joined.orderBy(F.desc(F.coalesce("created_at", F.lit(""))), *keys)


def by_status(forms: DataFrame, status: str = "all") -> DataFrame:
    return forms if status == "all" else forms.filter(F.col("status") == status)


def status_counts(forms: DataFrame) -> DataFrame:
    return forms.agg(
        F.count("*").alias("all"), F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("status") == "processed").alias("processed")
    )
