"""Metric events, dashboard, extraction jobs and keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formlake.functions.text import clean_email, half_up, is_email, stripped

# fixed values
RECENT_EVENTS = 12
JOB_TTL = "INTERVAL 4 HOURS"

# One wide row per event; columns of other event types are null.
EVENT_SCHEMA = (
    "event_id string, event_type string, timestamp string, success boolean, latency_ms double, match_count long, "
    "top_scores array<double>, selected_rank int, status string, run_id string, template_id string"
)


def event_sums(events: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts and sums the dashboard is made of. They add up, so a stream can keep them."""
    kind = F.col("event_type")
    good = F.coalesce("success", F.lit(False))

    def n(condition: Column, name: str) -> Column:
        return F.count_if(condition).alias(name)

    def total(condition: Column, value: Column, name: str) -> Column:
        return F.coalesce(F.sum(F.when(condition, value)), F.lit(0.0)).alias(name)

    query, storage, pre, chosen = (kind == k for k in ("query", "storage", "precompute", "selection"))
    top1 = F.get("top_scores", F.lit(0))
    rank = F.col("selected_rank")
    return events.groupBy(*(by or [])).agg(
        n(query, "total_queries"), n(query & good, "successful_queries"), n(query & ~good, "failed_queries"),
        total(query & good, F.col("latency_ms"), "query_latency"), total(query & good, F.col("match_count").cast("double"), "matches"),
        total(query & good, top1, "top1"), n(query & good & top1.isNotNull(), "top1_count"),
        *(n(chosen & (rank == i), f"top_{i}") for i in (1, 2, 3)), n(chosen & (rank >= 4), "top_4_plus"),
        total(pre & good, F.col("latency_ms"), "precompute_latency"),
        n(pre & ~good, "failed_precompute_count"), n(pre & good, "successful_precompute_count"),
        n(storage & good, "storage_success_count"), n(storage & ~good, "storage_failure_count"), n(storage, "total_storage_events"),
    )


def dashboard(sums: DataFrame) -> DataFrame:
    """Totals and averages from the sums; averages of nothing are 0."""

    def average(total: str, count: str) -> Column:
        return F.when(F.col(count) > 0, F.col(total) / F.col(count)).otherwise(F.lit(0.0))

    return sums.select(
        "total_queries", "successful_queries", "failed_queries",
        half_up(average("query_latency", "successful_queries")).cast("long").alias("average_query_latency_ms"),
        F.round(average("matches", "successful_queries"), 1).alias("average_returned_match_count"),
        F.round(average("top1", "top1_count"), 4).alias("average_top1_similarity_score"),
        "top_1", "top_2", "top_3", "top_4_plus",
        half_up(average("precompute_latency", "successful_precompute_count")).cast("long").alias("average_precompute_latency_ms"),
        "failed_precompute_count", "successful_precompute_count", "storage_success_count", "storage_failure_count", "total_storage_events",
    )


def rank_shares(sums: DataFrame) -> DataFrame:
    """Rank buckets with their width in percent of the largest one."""
    names = (("Top 1", "top_1"), ("Top 2", "top_2"), ("Top 3", "top_3"), ("Top 4+", "top_4_plus"))
    largest = F.greatest(F.lit(1), *(F.col(c) for _, c in names))
    rows = F.array(*(F.struct(F.lit(label).alias("label"), F.col(c).alias("value"), half_up(F.col(c) / largest * 100).cast("long").alias("width")) for label, c in names))
    return sums.select(F.inline(rows))


def recent(events: DataFrame, order: list[str], n: int = RECENT_EVENTS) -> DataFrame:
    """The last events in arrival order, newest first."""
    return events.orderBy(*(F.desc(c) for c in order)).limit(n)


# ---- jobs ------------------------------------------------------------------------------------


def latest_jobs(changes: DataFrame) -> DataFrame:
    """Current state per run from a change log (run_id, seq, action, at, ..).

    Actions: create, running, ready, failed. A create only counts for a new or a failed
    job; running and ready jobs are not restarted. Everything is a maximum, so the
    changes of one run are combined before the shuffle and never gathered.
    """
    status = F.when(F.col("action") == "ready", "kvp_ready").otherwise(F.col("action"))
    other = F.col("action") != "create"
    last = F.max(F.when(other, F.struct("seq", status.alias("status"), "at")))
    create = F.max(F.when(~other, F.struct("seq", "at")))
    per = changes.groupBy("run_id").agg(last.alias("o"), create.alias("c"), F.min("at").alias("first_at"))
    recreated = (F.col("o.status") == "failed") & (F.col("c.seq") > F.col("o.seq"))
    fresh = F.col("o").isNull() | F.coalesce(recreated, F.lit(False))
    kvp = F.when(fresh, "pending").when(F.col("o.status") == "kvp_ready", "ready").otherwise(F.col("o.status"))
    done = ~fresh & F.col("o.status").isin("kvp_ready", "failed")
    return per.select(
        "run_id", F.when(fresh, "accepted").otherwise(F.col("o.status")).alias("status"), kvp.alias("kvp_status"),
        F.when(fresh, F.col("c.at")).otherwise(F.col("o.at")).alias("updated_at"), F.when(done, F.col("o.at")).alias("finished_at"),
    )


def live_jobs(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs touched within the last four hours."""
    return jobs.filter(F.col("updated_at") >= now - F.expr(JOB_TTL))


# ---- keyed tables -------------------------------------------------------------------------------


def upsert(current: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of both frames, the latest per key; a hot key is combined before the shuffle."""
    both = current.unionByName(changes)
    others = [c for c in both.columns if c not in (key, order)]
    return both.groupBy(key).agg(F.max(F.struct(order, *others)).alias("r")).select(key, "r.*").select(*both.columns)


def access_requests(requests: DataFrame) -> DataFrame:
    """Valid requests with trimmed names and lower-case addresses."""
    clean = requests.withColumn("email", clean_email(F.col("email"))).withColumn("name", stripped("name"))
    return clean.filter(is_email(F.col("email")) & (F.length("name") > 0))


def newest_first(rows: DataFrame, column: str, *ties: str) -> DataFrame:
    return rows.orderBy(F.desc_nulls_last(column), *ties)


def delete_keys(rows: DataFrame, doomed: DataFrame, key: str) -> DataFrame:
    return rows.join(doomed.select(key), key, "left_anti")
