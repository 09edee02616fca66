"""The common shape of a check result: one row per (code, scope)."""

from __future__ import annotations

import logging
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgauge.contracts import CHECK_SCHEMA, REQUIRED_SCOPES, severity

logger = logging.getLogger(__name__)


def _row(code: str, scope: str, checked: Column, failed: Column, details: Column | None, error: Column) -> Column:
    state = F.when(error, F.lit("error")).when(failed > 0, F.lit("fail")).otherwise(F.lit("pass"))
    counted = lambda c: F.when(error, F.lit(0)).otherwise(c).cast("long")
    return F.struct(
        F.lit(code).alias("check_code"),
        F.lit(scope).alias("dataset_key"),
        F.lit(code in REQUIRED_SCOPES).alias("required"),
        F.lit(severity(code)).alias("severity"),
        state.alias("status"),
        counted(checked).alias("checked_count"),
        counted(failed).alias("failed_count"),
        (F.lit(None) if details is None else details).cast("string").alias("details_hash"),
    )


def outcome(
    code: str, scope: str, checked: Column, failed: Column, details: Column | None = None, error: Column | None = None
) -> Column:
    return _row(code, scope, checked, failed, details, F.lit(False) if error is None else error)


def outcomes(facts: DataFrame, rows: list[Column]) -> DataFrame:
    """Turn one row of facts into one result row per check."""
    return facts.select(F.inline(F.array(*rows)))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def evaluate(spark: SparkSession, codes: list[tuple[str, str]], build: Callable[[], DataFrame]) -> DataFrame:
    """Run one job; a job that cannot finish yields ``error`` rows and never a pass.

    Only the few result rows come to the driver.
    """
    try:
        rows = build().collect()
    except Exception as problem:  # the result says "error"; the log says why
        logger.warning("check job %s could not complete: %s", codes, problem)
        rows = [
            (code, scope, code in REQUIRED_SCOPES, severity(code), "error", 0, 0, None) for code, scope in codes
        ]
    return spark.createDataFrame(rows, CHECK_SCHEMA)
