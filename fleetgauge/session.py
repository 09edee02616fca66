"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.caseSensitive": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.compression.codec": "snappy",
}


def build(master: str | None = None, app: str = "fleetgauge", **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; a local one only in local mode."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named
    if not context.master.startswith("local"):
        raise ValueError("Set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    context.setCheckpointDir(folder)
    return folder


def scratch(spark: SparkSession, purpose: str) -> str:
    """A path nobody has used yet, below the shared folder."""
    return f"{shared_folder(spark)}/{purpose}-{uuid.uuid4()}"


def settle(df: DataFrame, purpose: str = "settled") -> DataFrame:
    """Write a frame once and read it back: stable rows, and lineage that survives lost executors."""
    path = scratch(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def together(tasks: Iterable[Callable[[], Any]]) -> list[Any]:
    """Run independent jobs at the same time, so that short ones do not leave executors idle.

    Results come in the order of the tasks; the first failure is raised.
    """
    tasks = list(tasks)
    inherit = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(max_workers=min(8, max(1, len(tasks)))) as pool:
        return [f.result() for f in [pool.submit(inherit(t)) for t in tasks]]
