"""Joins and numbering that hold when one key owns a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formlake.session import cut

HEAVY_KEYS = 2000
SALTS = 32
ONE_TASK_ROWS = 100_000
WINDOW_ROWS = 100_000


def join_on_counted_key(facts: DataFrame, keys: DataFrame, key: str, count: str, salt_by: str) -> DataFrame:
    """Inner join of `facts` with one row per key, where `count` is the key's number of facts.

    A key is heavy when it owns more than 1/2000 of the facts, so there are fewer
    than 2000 heavy keys whatever the data: that list is safe to broadcast. Facts
    of heavy keys are dealt over 32 salts and only those key rows are copied.
    """
    total = keys.agg(F.sum(count)).scalar()
    marked = keys.withColumn("heavy", F.col(count) * HEAVY_KEYS > total)
    heavy = F.broadcast(marked.filter("heavy").select(key, F.lit(True).alias("is_heavy")))
    deal = F.when(F.col("is_heavy"), F.pmod(F.xxhash64(salt_by), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    left = facts.join(heavy, key, "left").withColumn("salt", deal).drop("is_heavy")
    copies = F.sequence(F.lit(0), F.when(F.col("heavy"), F.lit(SALTS - 1)).otherwise(F.lit(0)))
    right = marked.withColumn("salt", F.explode(copies)).drop("heavy")
    return left.join(right.hint("merge"), [key, "salt"]).drop("salt")


def hash_rank(df: DataFrame, key: Column, name: str, by: list[str] | None = None) -> DataFrame:
    """Position 1..n of each row in md5 order of `key`, without a window over a large share of the rows.

    Groups in `by` are windows of their own, unless one holds over 100,000 rows and 1/2000 of all.
    Those, fewer than 2000, and the whole frame are bucketed by the first three hex digits of
    the md5, 4096 even buckets in order; a row's position is its place in its bucket plus the
    sizes of the buckets before.
    """
    by = by or []
    hashed = df.withColumn("_h", F.md5(key))
    bucket = F.substring("_h", 1, 3)
    if by:
        counts = cut(df.groupBy(*by).agg(F.count("*").alias("_n")))
        total = counts.agg(F.sum("_n")).first()[0] or 0
        large = counts.filter((F.col("_n") * HEAVY_KEYS > total) & (F.col("_n") > WINDOW_ROWS)).select(*by, F.lit(True).alias("_large"))
        if large.isEmpty():
            return hashed.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy("_h")).cast("long")).drop("_h")
        hashed = hashed.join(F.broadcast(large), by, "left").withColumn("_b", F.when(F.col("_large"), bucket).otherwise("")).drop("_large")
    else:
        hashed = hashed.withColumn("_b", bucket)
    sizes = hashed.filter("_b <> ''").groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*by, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    place = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_h"))
    return (
        hashed.withColumn("_p", place).join(offsets, [*by, "_b"], "left")
        .withColumn(name, (F.col("_p") + F.coalesce("_o", F.lit(0))).cast("long")).drop("_h", "_b", "_p", "_o")
    )


def group_rank(df: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    """Position 1..n in a total order within each group, also for one group with most rows.

    Rows are range-partitioned by group and order and written once, so a large group
    lies in many partitions; each numbers its own rows and adds the group's rows in
    the partitions before it. End `order` with a unique column, so that equal values
    cannot gather in one partition.
    """
    ranged = cut(df.repartitionByRange(*(F.col(c) for c in by), *order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*by, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    place = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order))
    return (
        ranged.withColumn("_p", place).join(offsets, [*by, "_part"])
        .withColumn(name, F.col("_p") + F.col("_o")).drop("_part", "_p", "_o")
    )


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Position 1..n in a total order over the whole frame, without a single-task window."""
    return group_rank(df, [], order, name)


def first_rows(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows in a total order. Few of them are one task's; more are found by their position, in as many tasks as they fill."""
    if n <= ONE_TASK_ROWS:
        return df.orderBy(*order).limit(n)
    return global_rank(df, order, "_at").filter(F.col("_at") <= n).drop("_at")


def lookup_on_counted_key(facts: DataFrame, lookup: DataFrame, key: str, salt_by: str) -> DataFrame:
    """Left join of `facts` with `lookup`, whose rows of heavy keys are copied for the salts of their facts.

    As in `join_on_counted_key` fewer than 2000 keys own more than 1/2000 of the facts each. Facts
    without a key find nothing and are dealt over the salts too.
    """
    counts = cut(facts.groupBy(key).agg(F.count("*").alias("_n")))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    heavy = F.broadcast(counts.filter((F.col("_n") * HEAVY_KEYS > total) & F.col(key).isNotNull()).select(key, F.lit(True).alias("_heavy")))
    spread = F.col("_heavy") | F.col(key).isNull()
    salt = F.when(spread, F.pmod(F.xxhash64(salt_by), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    left = facts.join(heavy, key, "left").withColumn("_salt", salt).drop("_heavy")
    copies = F.sequence(F.lit(0), F.when(F.col("_heavy"), F.lit(SALTS - 1)).otherwise(F.lit(0)))
    right = lookup.join(heavy, key, "left").withColumn("_salt", F.explode(copies)).drop("_heavy")
    return left.join(right, [key, "_salt"], "left").drop("_salt")
