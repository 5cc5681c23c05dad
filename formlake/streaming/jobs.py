"""Polling loops as Structured Streaming queries.

Every start function takes a source folder and a checkpoint folder and returns a
StreamingQuery. With `once` it works off what is there and stops; otherwise it keeps
watching. Files are processed once, by the query's checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from formlake.operators import augment, events, gates, medallion
from formlake.sources import readers, writers

JOB_TTL_MS = 4 * 60 * 60 * 1000


def _start(writer, checkpoint: str, once: bool, poll: str = "30 seconds") -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=poll)).start()


def stream(spark: SparkSession, folder: str, schema, form: str = "parquet", files: int = 1000) -> DataFrame:
    """New files of a folder, at most `files` per batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(form).load(folder)


def extract_templates(spark: SparkSession, source: str, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Source tables as they arrive: rows with enough qualifying objects are appended."""
    rows = stream(spark, source, readers.SOURCE_SCHEMA).drop("image")
    pairs = F.arrays_zip(F.col("objects.id").alias("id"), F.col("objects.area").alias("area"))
    kept = gates.keep_templates(rows, gates.qualifying(pairs)).drop("objects")
    return _start(kept.writeStream.format("parquet").option("path", out), checkpoint, once)


def gate_languages(spark: SparkSession, source: str, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Language records of new documents are appended; counts of a batch go next to them."""
    docs = stream(spark, source, "doc_id long, text string, lang string, confidence double")

    def write(batch: DataFrame, batch_id: int) -> None:
        # a repeated batch overwrites its own folder, so no record is written twice
        gates.language_records(batch).write.mode("overwrite").parquet(f"{out}/records/batch={batch_id}")
        written = batch.sparkSession.read.parquet(f"{out}/records/batch={batch_id}")
        gates.language_counts(written).write.mode("overwrite").parquet(f"{out}/counts/batch={batch_id}")

    return _start(docs.writeStream.foreachBatch(write), checkpoint, once)


def mask_documents(spark: SparkSession, source: str, splits: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """New OCR files of training templates are masked; others pass clean.

    splits: template_id, split, a static table. Choices come from hashes, so no state is kept.
    """
    docs = stream(spark, source, "doc_id long, template_id string, mode string, words array<string>")
    joined = docs.join(splits, "template_id")
    train = F.col("split") == "train"
    mask = F.when(train & (F.col("mode") == "mask25"), 0.25).when(train & (F.col("mode") == "mask20_corrupt10"), 0.20).otherwise(0.0)
    corrupt = F.when(train & (F.col("mode") == "mask20_corrupt10"), 0.10).otherwise(0.0)
    key = F.concat(F.lit("36:"), F.col("doc_id").cast("string"))
    edited = joined.withColumn("m", augment.mask_and_corrupt(F.col("words"), key, mask, corrupt, "letters"))
    rows = edited.select("doc_id", "template_id", "split", "mode", F.col("m.words").alias("words"), F.size("m.masked").alias("n_masked"), F.size("m.corrupted").alias("n_corrupted"))
    return _start(rows.writeStream.format("parquet").option("path", out), checkpoint, once)


def cache_totals(spark: SparkSession, source: str, checkpoint: str, name: str, once: bool = True) -> StreamingQuery:
    """Images and words seen so far, as in-memory table `name`; a path counts once, however late it comes again.

    The paths seen are the query's state, by path over its partitions, and never forgotten. A session that keeps
    state in RocksDB holds them on disk and reads only those that a batch asks for.
    """
    entries = stream(spark, source, "path string, n_words long, at timestamp").dropDuplicates(["path"])
    totals = entries.agg(F.count("*").alias("images"), F.sum("n_words").alias("words"))
    return _start(totals.writeStream.outputMode("complete").format("memory").queryName(name), checkpoint, once)


def transform_silver(spark: SparkSession, source: str, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Silver objects are turned into gold runs, fields and manifests of the store in `out` as they are stored.

    A batch is a commit named by the query and its number: repeated after a failure it counts
    once, and a run that comes in a later batch replaces the earlier one.
    """
    objects = stream(spark, source, "name string, payload string")

    def write(batch: DataFrame, batch_id: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        stamp = F.lit(pd.Timestamp.now("UTC").isoformat())
        writers.write_gold(medallion.parse_silver(batch), out, stamp, f"{query}-{batch_id}", "parquet")

    return _start(objects.writeStream.foreachBatch(write), checkpoint, once)


def event_totals(spark: SparkSession, source: str, checkpoint: str, name: str, once: bool = True) -> StreamingQuery:
    """Sums of the metric events so far, as in-memory table `name`; `events.dashboard` reads them."""
    sums = events.event_sums(stream(spark, source, events.EVENT_SCHEMA))
    return _start(sums.writeStream.outputMode("complete").format("memory").queryName(name), checkpoint, once)


# ---- jobs -------------------------------------------------------------------------------------------

CHANGE = "run_id string, seq long, action string, at timestamp"
JOB = "run_id string, status string, kvp_status string, created_at timestamp, started_at timestamp, finished_at timestamp, updated_at timestamp"
STATE = JOB.replace("run_id string, ", "") + ", seq long, moved long"
FIELDS = ("status", "kvp_status", "created_at", "started_at", "finished_at", "updated_at", "seq", "moved")


def next_state(state: dict | None, action: str, at) -> dict | None:
    """State after one change; a create counts only for a new or failed job."""
    if action == "create":
        if state is None or state["status"] in ("failed", "expired"):
            return {"status": "accepted", "kvp_status": "pending", "created_at": at, "started_at": None, "finished_at": None, "updated_at": at}
        return state
    state = state or {"created_at": at, "started_at": None, "finished_at": None}
    if action == "running":
        return {**state, "status": "running", "kvp_status": "running", "started_at": state["started_at"] or at, "updated_at": at}
    status = ("kvp_ready", "ready") if action == "ready" else ("failed", "failed")
    return {**state, "status": status[0], "kvp_status": status[1], "finished_at": at, "updated_at": at}


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, ttl_ms: int) -> Iterator[pd.DataFrame]:
    """Apply the changes of one run and emit its job; after a quiet time emit it as expired and forget it.

    Changes come in batches, in any order. `moved` is the last change of the job that was
    no create: older ones do not turn the job back. A newer one that is older than a
    create undoes that create, unless it is the failure that allows it.
    """
    if state.hasTimedOut:
        job = dict(zip(FIELDS, state.get))
        state.remove()
        yield _job_row(key[0], {**job, "status": "expired"})
        return
    job = dict(zip(FIELDS, state.get)) if state.exists else None
    changes = sorted((int(s), a, t) for b in batches for s, a, t in zip(b["seq"], b["action"], b["at"]))
    for seq, action, at in changes:
        moved = job["moved"] if job else -1
        if seq < moved:
            continue
        if job and action == "failed" and job["status"] == "accepted" and seq < job["seq"]:
            job = {**job, "moved": seq}
            continue
        after = next_state(job, action, at)
        if after != job:
            job = {**after, "seq": seq, "moved": moved if action == "create" else seq}
    state.update(tuple(None if pd.isna(job[f]) else job[f] for f in FIELDS))
    state.setTimeoutDuration(ttl_ms)
    yield _job_row(key[0], job)


def _job_row(run_id: str, job: dict) -> pd.DataFrame:
    row = pd.DataFrame([{"run_id": run_id, **{f: job[f] for f in FIELDS[:-2]}}])
    for column in FIELDS[2:-2]:
        row[column] = pd.to_datetime(row[column])
    return row


def store_jobs(changes: DataFrame, out: str, checkpoint: str, once: bool = True, ttl_ms: int = JOB_TTL_MS) -> StreamingQuery:
    """Job rows of `track_jobs`, one folder per batch; the row of a run in its last batch is its state.

    With timeouts there is always another batch, so `once` runs a single one.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = track_jobs(changes, ttl_ms).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(once=True) if once else writer).start()


def track_jobs(changes: DataFrame, ttl_ms: int = JOB_TTL_MS) -> DataFrame:
    """Current job rows from a stream of changes (run_id, seq, action, at); jobs quiet for `ttl_ms` expire."""

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        return _advance(key, batches, state, ttl_ms)

    return changes.groupBy("run_id").applyInPandasWithState(advance, JOB, STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)
