"""Tables keyed by (template_id, run_id), written by commits; readers see the newest version of each run.

A commit names the runs it holds and brings rows of one or several tables, so that the tables
change together. Rows lie in files by commit and template, ordered by run, so that a run's rows are found by the
files' own statistics; a large template is several files. The names
of a commit's runs lie beside them, and last comes one row in the log, which makes the commit count. A
commit that was broken off leaves no such row and is written over when it is tried again;
one that stands in the log is not repeated. What is written follows the new runs alone, whatever is
in the store. A run that a commit names without rows is gone from that table.

Readers join a commit's rows with the newest commit of each run. `compact` writes what they see as a
commit before which nothing is read; older files stay for the owner of the folder to clear. Commits are numbered by
the log, so they come from one writer at a time. Templates and runs are never empty texts.
"""

from __future__ import annotations

import json
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formlake.session import cut

KEY = ["template_id", "run_id"]
LOG = "commit string, seq long, base boolean, form string, tables string"


def exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.format("text").load(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def history(spark: SparkSession, root: str) -> list:
    """Log rows from the last base on, oldest first: one for each commit since the store was compacted."""
    if not exists(spark, f"{root}/commits"):
        return []
    rows = spark.read.schema(LOG).json(f"{root}/commits/*").orderBy("seq", "commit").collect()
    bases = [i for i, r in enumerate(rows) if r["base"]]
    return rows[bases[-1] if bases else 0 :]


def commit(root: str, tables: dict[str, DataFrame], keys: DataFrame, name: str | None = None, form: str = "parquet", base: bool = False) -> bool:
    """Write rows of `tables` for the runs in `keys`; False if a commit of this name is there already."""
    spark = keys.sparkSession
    name = name or uuid4().hex
    done = spark.read.schema(LOG).json(f"{root}/commits/*").filter(F.col("commit") == name) if exists(spark, f"{root}/commits") else None
    if done is not None and not done.isEmpty():
        return False
    past = history(spark, root)
    schemas = {t: json.loads(r["tables"])[t] for r in past for t in json.loads(r["tables"])}
    for table, rows in tables.items():
        schemas[table] = rows.schema.json()
        dealt = rows.hint("rebalance", "template_id").sortWithinPartitions(*KEY)
        dealt.write.mode("overwrite").partitionBy("template_id").format(form).save(f"{root}/{table}/commit={name}")
    keys.select(*KEY).distinct().write.mode("overwrite").parquet(f"{root}/runs/commit={name}")
    entry = [(name, past[-1]["seq"] + 1 if past else 0, base, form, json.dumps(schemas))]
    spark.createDataFrame(entry, LOG).coalesce(1).write.mode("overwrite").json(f"{root}/commits/{name}")
    return True


def newest(spark: SparkSession, root: str, commits: list) -> DataFrame:
    """(template_id, run_id, commit): the last commit that names a run."""
    order = F.element_at(F.create_map(*(F.lit(x) for r in commits for x in (r["commit"], r["seq"]))), F.col("commit"))
    named = spark.read.option("basePath", f"{root}/runs").schema("template_id string, run_id string, commit string")
    rows = named.parquet(*(f"{root}/runs/commit={r['commit']}" for r in commits))
    last = rows.groupBy(*KEY).agg(F.max(F.struct(order.alias("seq"), "commit")).alias("last"))
    return last.select(*KEY, F.col("last.commit").alias("commit"))


def read(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The newest rows of every run. A filter on template_id reads that template's folders alone."""
    commits = history(spark, root)
    if not commits:
        raise FileNotFoundError(f"no commit in {root}")
    schema = T.StructType.fromJson(json.loads(json.loads(commits[-1]["tables"])[table]))
    stored = T.StructType([f for f in schema.fields if f.name != "template_id"] + [T.StructField(c, T.StringType()) for c in ("commit", "template_id")])
    found = None
    for form in sorted({r["form"] for r in commits}):
        paths = [f"{root}/{table}/commit={r['commit']}" for r in commits if r["form"] == form and table in json.loads(r["tables"]) and exists(spark, f"{root}/{table}/commit={r['commit']}")]
        if paths:
            part = spark.read.option("basePath", f"{root}/{table}").schema(stored).format(form).load(paths)
            found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], schema)
    return found.join(newest(spark, root, commits), [*KEY, "commit"], "left_semi").select(*schema.names)


def compact(spark: SparkSession, root: str) -> None:
    """One commit of all that readers see, before which nothing is read any more."""
    commits = history(spark, root)
    tables = {t: cut(read(spark, root, t)) for t in json.loads(commits[-1]["tables"])}
    commit(root, tables, cut(newest(spark, root, commits)), form=commits[-1]["form"], base=True)
