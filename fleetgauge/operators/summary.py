"""Counts, duplicates, coverage and group sums."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.contracts import GrainSpec
from fleetgauge.functions.exact import TOTAL, exact_mean, share_percent


def by_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows sent to their key, for an aggregation whose groups are mostly single rows.

    Combining such rows before the shuffle saves nothing, and the table it takes grows with what a task reads;
    after it, a task holds one shuffle partition, whose size adaptive execution bounds.
    """
    return df.repartition(*keys)


def any_rows(df: DataFrame) -> bool:
    return not df.isEmpty()


def one_row(parts: list[DataFrame]) -> DataFrame:
    """Several one-row results side by side, without a join: a union of narrow rows, then
    the only value of each column. A part without rows leaves its columns null."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def group_sums(df: DataFrame, keys: list[str], measures: tuple[str, ...] = ("capacity", "outage")) -> DataFrame:
    """Exact sums at a coarser grain; a group that nobody reported stays absent."""
    sums = [F.sum(name).cast(TOTAL).alias(name) for name in measures]
    return df.groupBy(*keys).agg(*sums) if keys else df.agg(*sums)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def surplus_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows and rows beyond the first of their key (identical rows count too)."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))
    return per_key.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("checked_count"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("failed_count"),
    )


def coverage(df: DataFrame, spec: GrainSpec) -> DataFrame:
    """Rows, unique keys, days, first and last day, in two aggregations over one shuffle of keys."""
    per_key = df.groupBy(*spec.keys).agg(F.count(F.lit(1)).alias("copies"))
    per_day = per_key.groupBy(spec.period).agg(F.sum("copies").alias("rows"), F.count(F.lit(1)).alias("keys"))
    return per_day.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum("keys"), F.lit(0)).alias("unique_keys"),
        F.count(F.lit(1)).alias("days"),
        F.min(spec.period).alias("first_day"),
        F.max(spec.period).alias("last_day"),
    )


def first_and_last(df: DataFrame, spec: GrainSpec, values: tuple[str, ...] = ("capacity", "outage")) -> DataFrame:
    period = spec.period
    picks = [F.min(period).alias("first_day"), F.max(period).alias("last_day")]
    for name in values:
        picks += [F.min_by(name, period).alias(f"first_{name}"), F.max_by(name, period).alias(f"last_{name}")]
    return df.groupBy(*spec.entity).agg(*picks, F.count(F.lit(1)).alias("records"))


def weighted_percent(units: DataFrame, keys: list[str]) -> DataFrame:
    """The share of summed MW next to the plain mean of reported percentages.

    The mean is unknown as soon as one percentage is; a zero total has no share.
    """
    capacity = F.sum("capacity").cast(TOTAL)
    outage = F.sum("outage").cast(TOTAL)
    percents = F.sum("percentOutage").cast(TOTAL)
    grouped = units.groupBy(*keys).agg(
        capacity.alias("capacity"), outage.alias("outage"), percents.alias("_percents"),
        F.count(F.lit(1)).alias("units"), F.count("percentOutage").alias("_reported"),
    )
    return grouped.select(
        *keys, "units", "capacity", "outage",
        share_percent("outage", "capacity").alias("weighted_percent"),
        F.when(F.col("capacity") == 0, F.lit("zero_capacity")).alias("ratio_reason"),
        F.when(F.col("units") == F.col("_reported"), exact_mean(F.col("_percents"), F.col("units"))).alias("mean_percent"),
    )


def present_every_day(df: DataFrame, spec: GrainSpec) -> DataFrame:
    """Entities observed on every day on which anything was observed."""
    pairs = df.groupBy(*spec.entity, spec.period).agg(F.lit(1).alias("_one"))
    days = df.agg(F.countDistinct(spec.period)).scalar()
    return pairs.groupBy(*spec.entity).agg(F.count(F.lit(1)).alias("days")).filter(F.col("days") == days)


def reuse(df: DataFrame, keys: list[str], owner: str) -> DataFrame:
    """How many distinct owners share one id within a group."""
    return df.groupBy(*keys, owner).agg(F.lit(1).alias("_one")).groupBy(*keys).agg(
        F.count(owner).alias("owners")
    )


