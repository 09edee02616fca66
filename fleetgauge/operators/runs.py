"""Longest run of consecutive days on which a condition holds, per entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge.contracts import GrainSpec


def fully_out() -> Column:
    return (F.col("capacity") > 0) & (F.col("capacity") == F.col("outage")) & (F.col("percentOutage") == 100)


def runs(df: DataFrame, spec: GrainSpec, condition: Column) -> DataFrame:
    """Runs of matching days. A gap or a day that does not match ends a run.

    Matching rows reduce to distinct (entity, day) pairs before the window, so a window
    group is at most as long as the calendar, however many rows an entity has.
    """
    days = df.filter(condition).groupBy(*spec.entity, spec.period).agg(F.lit(1).alias("_one"))
    order = Window.partitionBy(*spec.entity).orderBy(F.col(spec.period).asc_nulls_last())
    island = days.withColumn("_island", F.date_sub(F.col(spec.period), F.row_number().over(order)))
    return island.groupBy(*spec.entity, "_island").agg(
        F.count(F.lit(1)).alias("run_days"), F.min(spec.period).alias("run_start"), F.max(spec.period).alias("run_end")
    ).drop("_island")


def longest_runs(df: DataFrame, spec: GrainSpec, condition: Column) -> DataFrame:
    """One run per entity: the longest, and the first of equally long ones."""
    found = runs(df, spec, condition)
    best = F.max(F.struct("run_days", (-F.unix_date("run_start")).alias("_early"), "run_start", "run_end")).alias("b")
    return found.groupBy(*spec.entity).agg(best).select(*spec.entity, "b.run_days", "b.run_start", "b.run_end")
