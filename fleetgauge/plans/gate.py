"""Decide whether a version's results let it through."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgauge.contracts import DIAGNOSTIC_MESSAGES, DIAGNOSTIC_PAIRS, REQUIRED_PAIRS, severity
from fleetgauge.operators.summary import one_row

REGISTRY_NAME = "warnings-v1"  # fixed value: part of the digest


def _registry(spark: SparkSession, pairs: list[tuple[str, str]]) -> DataFrame:
    rows = [(code, scope, severity(code)) for code, scope in pairs]
    return spark.createDataFrame(rows, "check_code STRING, dataset_key STRING, expected_severity STRING")


def registry_faults(results: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Pairs of the registry that do not have exactly one consistent result, and foreign pairs."""
    registry = _registry(results.sparkSession, pairs)
    consistent = (
        (F.col("checked_count") >= 0) & F.col("failed_count").between(F.lit(0), F.col("checked_count"))
        & F.col("status").isin("pass", "fail", "error")
        & ~((F.col("status") == "pass") & (F.col("failed_count") != 0))
        & ~((F.col("status") == "fail") & (F.col("failed_count") == 0))
        & ~(F.col("required") & (F.col("status") == "pass") & (F.col("checked_count") == 0))
    )
    found = results.groupBy("check_code", "dataset_key").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~F.coalesce(consistent, F.lit(False))).alias("inconsistent"),
        F.max("severity").alias("severity"),
        F.max("status").alias("status"),
    )
    joined = registry.join(found, ["check_code", "dataset_key"], "full_outer")
    fault = (
        F.when(F.col("expected_severity").isNull(), F.lit("unknown"))
        .when(F.col("n").isNull(), F.lit("absent"))
        .when(F.col("n") != 1, F.lit("repeated"))
        .when(F.col("inconsistent") > 0, F.lit("inconsistent"))
        .when(F.col("severity") != F.col("expected_severity"), F.lit("severity"))
    )
    return joined.select("check_code", "dataset_key", fault.alias("fault"), "status")


def required_pass(results: DataFrame) -> DataFrame:
    """One row: do all required pairs have exactly one passing result?"""
    checked = registry_faults(results.filter("required"), REQUIRED_PAIRS)
    good = F.col("fault").isNull() & (F.col("status") == "pass")
    return checked.agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if(~F.coalesce(good, F.lit(False))).alias("blocking"),
    ).withColumn("passed", F.col("blocking") == 0)


def diagnostics_complete(results: DataFrame) -> DataFrame:
    checked = registry_faults(results.filter("NOT required"), DIAGNOSTIC_PAIRS)
    good = F.col("fault").isNull() & (F.col("status") != "error")
    return checked.agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if(~F.coalesce(good, F.lit(False))).alias("open"),
    ).withColumn("complete", F.col("open") == 0)


def one_attempt(bound: DataFrame) -> DataFrame:
    """Results of one attempt on one version and one manifest, never a mixture."""
    names = ("version_id", "attempt_id", "manifest_sha256")
    distinct = [F.countDistinct(n).alias(n) for n in names]
    absent = F.count_if(F.greatest(*[F.col(n).isNull() for n in names]))
    counted = bound.agg(*distinct, absent.alias("unbound"))
    single = (F.col("unbound") == 0)
    for n in names:
        single = single & (F.col(n) == 1)
    return counted.select(single.alias("single"))


def warning_summaries(results: DataFrame) -> DataFrame:
    """Affected rows per (code, scope). A warning is a summary with affected rows, not a row."""
    message = F.create_map(*[F.lit(x) for pair in DIAGNOSTIC_MESSAGES.items() for x in pair])
    return results.filter("NOT required").select(
        F.col("check_code").alias("code"), "dataset_key", "severity", F.col("failed_count").alias("affected_count"),
        message[F.col("check_code")].alias("message"), "details_hash",
    )


def warning_count() -> Column:
    return F.count_if((F.col("severity") == "warning") & (F.col("affected_count") > 0))


def warning_identity(results: DataFrame) -> DataFrame:
    """Warning count and a digest over the 23 ordered summaries."""
    summary = F.struct("code", "dataset_key", "severity", "affected_count", "message", "details_hash")
    body = F.concat(
        F.lit(REGISTRY_NAME + "\n"),
        F.to_json(F.array_sort(F.collect_list(summary)), {"ignoreNullFields": "false"}),
    )
    return warning_summaries(results).agg(
        warning_count().alias("warning_count"), F.sha2(body, 256).alias("warning_digest")
    )


def decision(results: DataFrame) -> DataFrame:
    """Gate, completeness, warning count and whether a person has to approve: one row."""
    parts = one_row(
        [required_pass(results).select("passed"), diagnostics_complete(results).select("complete"), warning_identity(results)]
    )
    through = F.col("passed") & F.col("complete")
    return parts.select(
        F.when(through, F.lit("passed")).otherwise(F.lit("failed")).alias("status"),
        F.when(through, F.col("warning_count")).alias("warning_count"),
        F.when(through, F.col("warning_digest")).alias("warning_digest"),
        F.when(through, F.col("warning_count") > 0).alias("approval_required"),
    )
