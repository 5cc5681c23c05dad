"""Streaming queries run to the end of what their folder holds; the SQL states the batch result."""

from __future__ import annotations

from math import ceil
from uuid import uuid4

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formlake.operators import events, models
from formlake.plans import inputs, medallion, records
from formlake.plans.inputs import DOCS, WORDS
from formlake.plans.records import DASHBOARD, GATE, JOBS, OBJECTS
from formlake.plans.registry import query, table
from formlake.session import cut, scratch
from formlake.sources import store
from formlake.streaming import jobs


CHARS_PER_FILE = 1 << 24


def arrive(df: DataFrame, files: int = 4) -> str:
    """Folder holding `df` in several files, as they would arrive."""
    path = scratch(df.sparkSession, "arrivals")
    df.repartition(files).write.parquet(path)
    return path


def text_files(spark, sf) -> int:
    """Files for rows that hold the documents' texts or words: four, and more so that none holds over 16 M characters on average."""
    chars = table(spark, sf, "documents").agg(F.sum(F.length("text"))).first()[0] or 0
    return max(4, ceil(chars / CHARS_PER_FILE))


def folders(spark) -> tuple[str, str]:
    return scratch(spark, "out"), scratch(spark, "state")


def name() -> str:
    return f"t{uuid4().hex}"


@query(f"WITH {OBJECTS}\nSELECT doc_id AS id, count(*)::INT AS object_count, round(sum(len * 0.7::DOUBLE), 3) AS area FROM objects WHERE ok GROUP BY ALL HAVING count(*) >= 3")
def stream_templates(spark, sf):
    none = F.lit(None)
    rows = records.templates(spark, sf).select(
        "id", F.col("id").alias("image_id"), F.col("split").alias("file_name"), F.lit(1).alias("width"), F.lit(1).alias("height"),
        F.struct(none.cast("binary").alias("bytes")).alias("image"), "objects",
    )
    out, state = folders(spark)
    jobs.extract_templates(spark, arrive(rows, text_files(spark, sf)), out, state).awaitTermination()
    return records.object_sums(spark.read.parquet(out))


@query(f"WITH {GATE}\nSELECT count(*) AS processed_files, count_if(is_english)::BIGINT AS english_files, (SELECT count(*) FROM records) AS records FROM records")
def stream_languages(spark, sf):
    out, state = folders(spark)
    jobs.gate_languages(spark, arrive(records.detected(spark, sf), text_files(spark, sf)), out, state).awaitTermination()
    counts, rows = spark.read.parquet(f"{out}/counts"), spark.read.parquet(f"{out}/records")
    return counts.agg(F.sum("processed_files").alias("processed_files"), F.sum("english_files").alias("english_files")).withColumn(
        "records", rows.agg(F.count("*")).scalar()
    )


@query(f"""WITH {DOCS},
{WORDS},
per AS (SELECT doc_id, lang, len(words) AS n FROM docs),
modes AS (SELECT *, lang IN ('en', 'de') AS train, ['mask25', 'mask20_corrupt10', 'clean'][doc_id % 3 + 1] AS mode FROM per)
SELECT lang AS template_id, mode, count(*) AS docs, sum(n)::BIGINT AS words,
  sum(CASE WHEN NOT train OR n = 0 THEN 0 WHEN mode = 'mask25' THEN greatest(1, round_even(n * 0.25, 0)) WHEN mode = 'mask20_corrupt10' THEN greatest(1, round_even(n * 0.2, 0)) ELSE 0 END)::BIGINT AS masked
FROM modes GROUP BY ALL""")
def stream_masking(spark, sf):
    mode = F.element_at(F.array(*map(F.lit, ("mask25", "mask20_corrupt10", "clean"))), (F.col("doc_id") % 3 + 1).cast("int"))
    docs = inputs.docs(spark, sf).select("doc_id", F.col("lang").alias("template_id"), mode.alias("mode"), "words")
    split = F.when(F.col("template_id").isin("en", "de"), "train").otherwise("val")
    splits = docs.select("template_id").distinct().withColumn("split", split)
    out, state = folders(spark)
    jobs.mask_documents(spark, arrive(docs, text_files(spark, sf)), splits, out, state).awaitTermination()
    done = spark.read.parquet(out)
    return done.groupBy("template_id", "mode").agg(F.count("*").alias("docs"), F.sum(F.size("words")).alias("words"), F.sum("n_masked").alias("masked"))


@query("SELECT count(DISTINCT url) AS images, sum(n)::BIGINT AS words FROM (SELECT url, any_value(length(url)) AS n FROM pages GROUP BY ALL)")
def stream_cache_totals(spark, sf):
    """Every page arrives twice, the second time in a later run of the stream and three days on, and counts once."""
    pages = table(spark, sf, "pages").select(F.col("url").alias("path"), F.length("url").cast("long").alias("n_words"), F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") % 3600).alias("at"))
    source, state = arrive(pages), scratch(spark, "state")
    jobs.cache_totals(spark, source, state, name()).awaitTermination()
    pages.withColumn("at", F.col("at") + F.expr("INTERVAL 3 DAYS")).repartition(4).write.mode("append").parquet(source)
    out = name()
    jobs.cache_totals(spark, source, state, out).awaitTermination()
    return spark.table(out)


@query(f"""WITH {medallion.RUNS}
SELECT template_id, count(*) AS runs, sum(field_count)::BIGINT AS fields, sum(field_count)::BIGINT AS field_rows, count(*) AS manifests FROM runs JOIN per USING (doc_id) GROUP BY ALL""")
def stream_gold(spark, sf):
    """Every third run comes in a first batch without its pairs, and whole in the second."""
    out, state = folders(spark)
    objects = medallion.silver_objects(spark, sf)
    early = objects.filter(F.pmod(F.xxhash64("name"), F.lit(3)) == 0).withColumn("payload", F.lit("{}"))
    files = text_files(spark, sf)
    source = arrive(early, files)
    jobs.transform_silver(spark, source, out, state).awaitTermination()
    objects.repartition(files).write.mode("append").parquet(source)
    jobs.transform_silver(spark, source, out, state).awaitTermination()
    runs, fields = store.read(spark, out, "form-runs"), store.read(spark, out, "extracted-fields")
    counts = fields.groupBy("template_id").agg(F.count("*").alias("field_rows"))
    manifests = store.read(spark, out, "manifests").groupBy("template_id").agg(F.count("*").alias("manifests"))
    totals = runs.groupBy("template_id").agg(F.count("*").alias("runs"), F.sum("field_count").alias("fields"))
    return totals.join(counts, "template_id").join(manifests, "template_id")


@query(f"WITH {DASHBOARD}\nSELECT * FROM d")
def stream_dashboard(spark, sf):
    """Running sums of the event stream, read as dashboard numbers."""
    rows = records.metric_events(spark, sf).select(
        "event_id", "event_type", F.col("ts").cast("string").alias("timestamp"), "success", "latency_ms", "match_count", "top_scores", "selected_rank",
        *(F.lit(None).cast("string").alias(c) for c in ("status", "run_id", "template_id")),
    )
    out = name()
    jobs.event_totals(spark, arrive(rows), scratch(spark, "state"), out).awaitTermination()
    return events.dashboard(spark.table(out))


@query(f"WITH {JOBS}\nSELECT run_id::VARCHAR AS run_id, status, kvp_status, updated FROM jobs")
def stream_jobs(spark, sf):
    """Final job rows of the stateful stream; a run's changes come in several files and two batches, out of order."""
    late = F.col("seq") % 3 == 1
    return streamed_jobs(spark, sf, (~late, late))


def streamed_jobs(spark, sf, parts, **options) -> DataFrame:
    """Last job rows after the changes came in one batch for each of `parts`."""
    changes = records.job_changes(spark, sf).withColumn("run_id", F.col("run_id").cast("string"))
    out, state = folders(spark)
    source = scratch(spark, "arrivals")
    for part in parts:
        changes.filter(part).repartition(4).write.mode("append").parquet(source)
        jobs.store_jobs(jobs.stream(spark, source, jobs.CHANGE), out, state, **options).awaitTermination()
    rows = spark.read.schema(f"{jobs.JOB}, batch int").parquet(out)
    last = rows.groupBy("run_id").agg(F.max(F.struct("batch", "updated_at", "status", "kvp_status")).alias("j"))
    return last.select("run_id", "j.status", "j.kvp_status", F.unix_seconds("j.updated_at").alias("updated"))


@query(f"""WITH {JOBS}
SELECT run_id::VARCHAR AS run_id, CASE WHEN run_id % 2 = 0 THEN 'expired' ELSE status END AS status, kvp_status, updated FROM jobs""")
def stream_expired_jobs(spark, sf):
    """Jobs expire after a millisecond here: those of even runs have before the odd runs come."""
    even = F.col("run_id").cast("long") % 2 == 0
    return streamed_jobs(spark, sf, (even, ~even), ttl_ms=1)


@query("SELECT vec_id, round(list_sum(embedding::DOUBLE[]), 4) AS score, 0::BIGINT AS missing FROM embeddings")
def model_scores(spark, sf):
    """A stand-in model: the sum of each vector, in batches."""
    def model(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"vec_id": batch["vec_id"], "score": np.stack(batch["embedding"]).astype(float).sum(axis=1)})

    source = table(spark, sf, "embeddings").select("vec_id", "embedding")
    scored = cut(models.score_batches(source, model, "vec_id long, score double"))
    missing = models.unscored(source, scored, "vec_id").agg(F.count("*")).scalar()
    return scored.select("vec_id", F.round("score", 4).alias("score")).withColumn("missing", missing)
