"""Session settings shared by every operator."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder for cut lineage and staged tables: the cluster's `spark.checkpoint.dir`.

    Only a local master, as in tests, may fall back to a temporary folder; on a
    cluster a machine-local folder would be lost with its machine.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if configured:
        if not current.isDefined():
            sc.setCheckpointDir(configured)
        return configured
    if current.isDefined():
        return current.get()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="formlake-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.setCheckpointDir(folder)
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write `df` as a table in the shared checkpoint folder and continue from that table.

    Unlike a cached frame it survives lost executors, and unlike recomputation it
    pins the rows a non-deterministic step produced.
    """
    spark = df.sparkSession
    path = scratch(spark, "cut")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
