"""Writing tiers, reports, embeddings and keyed tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formlake.functions.text import clean_key_part, image_extension
from formlake.operators import medallion
from formlake.sources import store
from formlake.session import cut


def last_of_run(rows: DataFrame, order: str) -> DataFrame:
    """Of the rows of one (template_id, run_id) the last by `order`; `row` tells them apart and goes.

    Only the keys are shuffled, not the images: rows that lose are named and taken out.
    """
    place = F.row_number().over(Window.partitionBy(*store.KEY).orderBy(F.desc_nulls_last(order), F.desc("row")))
    lost = rows.select(*store.KEY, order, "row").withColumn("place", place).filter("place > 1").select("row")
    return rows.join(lost, "row", "left_anti").drop("row")


def acceptable(uploads: DataFrame) -> DataFrame:
    """Uploads with `refused`: why an upload is not taken, null if it is."""
    kvp = F.try_parse_json(F.col("kvp"))
    return uploads.withColumn(
        "refused",
        F.when(F.coalesce(F.octet_length("image"), F.lit(0)) == 0, "empty image")
        .when(~F.coalesce(F.schema_of_variant(kvp).startswith("OBJECT"), F.lit(False)), "kvp is no JSON object"),
    )


def ingest(uploads: DataFrame, root: str, name: str | None = None) -> DataFrame:
    """Bronze images and silver envelopes as one commit of the store in `root`; returns the refused uploads.

    uploads: run_id, template_id, file_name, content_type, image (binary), kvp (JSON text),
    created_at (ISO text). A blank run id becomes a fresh one; a run that is there already
    is replaced, and of several uploads of a run the last by created_at stays. `name` makes a
    repeated call do nothing.
    """
    fresh = F.replace(F.expr("uuid()"), F.lit("-"), F.lit(""))
    template, run = clean_key_part(F.col("template_id"), F.lit("unknown")), clean_key_part(F.col("run_id"), fresh)
    keyed = acceptable(uploads).withColumn("template_id", template).withColumn("run_id", run)
    checked = cut(keyed.withColumn("row", F.monotonically_increasing_id()))
    named = last_of_run(checked.filter("refused IS NULL").drop("refused"), "created_at")
    path = medallion.object_path(medallion.BRONZE, F.col("template_id"), F.col("run_id"), image_extension(F.col("file_name"), F.col("content_type")))
    named = named.withColumn("image_object", path)
    tables = {"bronze": named.select("template_id", "run_id", "image_object", "image"), "silver": silver_envelopes(named)}
    store.commit(root, tables, named, name)
    return checked.filter("refused IS NOT NULL").drop("row")


def silver_envelopes(named: DataFrame) -> DataFrame:
    """(template_id, run_id, name, payload): the envelope around each upload's key/value JSON."""
    head = F.to_json(F.struct("run_id", "template_id", F.col("file_name").alias("source_file_name"), "image_object", "created_at"))
    payload = F.concat(F.expr("substring(h, 1, length(h) - 1)"), F.lit(',"kvp":'), F.col("kvp"), F.lit("}"))
    name = medallion.object_path(medallion.SILVER, F.col("template_id"), F.col("run_id"), F.lit("json"))
    return named.withColumn("h", head).select("template_id", "run_id", name.alias("name"), payload.alias("payload"))


def write_gold(silver: DataFrame, root: str, transformed_at, name: str | None = None, form: str = "json") -> None:
    """Runs, fields and manifests as one commit of the store in `root`, from one parse of the payloads.

    Runs that are there already are replaced; a run without fields keeps none of its old ones. Of several
    valid objects of a run the last by created_at, then by path, stays.
    """
    order = Window.partitionBy(*store.KEY).orderBy(F.desc_nulls_last("created_at"), F.desc("silver_path"))
    last = cut(silver.filter("valid").withColumn("place", F.row_number().over(order)).filter("place = 1").drop("place"))
    runs, fields = medallion.gold_runs(last, transformed_at), medallion.gold_fields(last, transformed_at)
    store.commit(root, {"form-runs": runs, "extracted-fields": fields, "manifests": runs}, last, name, form)


def write_report(rows: DataFrame, templates: DataFrame, summary: DataFrame, root: str) -> None:
    """Query rows and template rows as CSV with a header, the summary as JSON."""
    rows.write.mode("overwrite").option("header", True).csv(f"{root}/rows")
    templates.write.mode("overwrite").option("header", True).csv(f"{root}/templates")
    summary.write.mode("overwrite").json(f"{root}/summary")


def write_embeddings(embeddings: DataFrame, path: str) -> None:
    """Vectors with their id and attributes in one table, aligned by key and not by position."""
    embeddings.write.mode("append").parquet(path)


def append_missing(todo: DataFrame, path: str, key: str, embed) -> int:
    """Embed only the rows whose key is not in the table yet; a re-run after a failure resumes."""
    spark = todo.sparkSession
    before = 0
    if table_exists(spark, path):
        done = spark.read.parquet(path).select(key)
        before = done.count()
        todo = todo.join(done, key, "left_anti")
    write_embeddings(embed(todo), path)
    return spark.read.parquet(path).count() - before


def table_exists(spark: SparkSession, path: str, form: str = "parquet") -> bool:
    try:
        spark.read.format(form).load(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise
    return True
