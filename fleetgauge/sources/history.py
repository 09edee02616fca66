"""Append-only check history, the publication log and report files."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgauge.contracts import BOUND_CHECK_SCHEMA, CHECK_SCHEMA, PUBLICATION_SCHEMA


def append_checks(results: DataFrame, path: str, version_id: str, attempt_id: str, manifest_sha256: str | None = None) -> None:
    """Add one attempt on one manifest; attempts live in their own partition and are never rewritten."""
    bound = results.select(
        F.lit(version_id).alias("version_id"), F.lit(attempt_id).alias("attempt_id"), *CHECK_SCHEMA.fieldNames(),
        F.current_timestamp().alias("checked_at"), F.lit(manifest_sha256).cast("string").alias("manifest_sha256"),
    )
    if not attempts_of(results.sparkSession, path, version_id).filter(F.col("attempt_id") == attempt_id).isEmpty():
        raise ValueError("An attempt is recorded once")
    bound.write.mode("append").partitionBy("version_id", "attempt_id").parquet(path)


def attempts_of(spark: SparkSession, path: str, version_id: str) -> DataFrame:
    try:
        history = spark.read.schema(BOUND_CHECK_SCHEMA).parquet(path)
    except Exception as error:  # the history does not exist before the first attempt
        if "PATH_NOT_FOUND" not in str(error):
            raise
        history = spark.createDataFrame([], BOUND_CHECK_SCHEMA)
    return history.filter(F.col("version_id") == version_id)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(PUBLICATION_SCHEMA).parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], PUBLICATION_SCHEMA)


def active_event(log: DataFrame) -> DataFrame:
    """The event of the latest run; no row before the first publication."""
    return log.orderBy(F.col("run_seq").desc_nulls_last(), F.col("event_id").asc_nulls_last()).limit(1)


def active_version(log: DataFrame) -> Column:
    return log.agg(F.max_by("version_id", "run_seq")).scalar()


def read_active(versions: DataFrame, log: DataFrame) -> DataFrame:
    """Rows of the active version; the scalar subquery prunes ``version_id`` partitions."""
    return versions.filter(F.col("version_id") == active_version(log)).drop("version_id")


def read_published(versions: DataFrame, log: DataFrame, version_id: str) -> DataFrame:
    """Rows of the version that an earlier answer named, if it was ever published; it need not be the active one."""
    known = log.filter(F.col("version_id") == version_id).select("version_id").limit(1)
    return versions.filter(F.col("version_id") == version_id).join(known, "version_id", "left_semi").drop("version_id")


@dataclass(frozen=True)
class Candidate:
    version_id: str
    run_seq: int
    coverage_start: date
    coverage_end: date
    latest_observation_date: date


def decide(log: DataFrame, candidate: Candidate) -> str:
    """What publishing this candidate would do, from the log's aggregates alone."""
    newest = F.max_by(F.struct("run_seq", "coverage_start", "coverage_end"), "run_seq")
    facts = log.agg(
        F.count_if(F.col("version_id") == candidate.version_id).alias("known"), newest.alias("active")
    ).first()
    active = facts["active"]
    if facts["known"]:
        return "already_published"
    if active is None:
        return "publish"
    if candidate.run_seq <= active["run_seq"]:
        return "superseded"
    if candidate.coverage_start > active["coverage_start"] or candidate.coverage_end < active["coverage_end"]:
        return "coverage_regression"
    return "publish"


def publish(spark: SparkSession, path: str, candidate: Candidate, mode: str = "automatic") -> str:
    """Append at most one event. Callers publish from one place at a time."""
    decision = decide(read_log(spark, path), candidate)
    if decision != "publish":
        return decision
    event = spark.range(1).select(
        F.sha2(F.concat(F.lit("publish:"), F.lit(candidate.version_id)), 256).alias("event_id"),
        F.lit(candidate.version_id).alias("version_id"),
        F.lit(candidate.run_seq).cast("long").alias("run_seq"),
        F.lit(candidate.coverage_start).alias("coverage_start"),
        F.lit(candidate.coverage_end).alias("coverage_end"),
        F.lit(candidate.latest_observation_date).alias("latest_observation_date"),
        F.current_timestamp().cast("timestamp_ntz").alias("published_at"),
        F.lit(mode).alias("mode"),
    )
    event.write.mode("append").parquet(path)
    return "published"


def write_report(comparisons: DataFrame, summary: DataFrame | Callable[[], DataFrame], folder: str) -> None:
    """Every comparison as CSV and the summary as JSON, in a folder that must be new. A summary may be asked for once
    the comparisons are written."""
    comparisons.write.mode("errorifexists").option("header", True).csv(f"{folder}/reconciliation")
    made = summary if isinstance(summary, DataFrame) else summary()
    made.write.mode("errorifexists").option("ignoreNullFields", False).json(f"{folder}/summary")
