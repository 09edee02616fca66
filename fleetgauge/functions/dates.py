"""Calendars, date shifts and the range that a request selects."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgauge.contracts import MAX_RANGE_DAYS, PRESET_DAYS


def day(value: date | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def inclusive_days(start: Column, end: Column) -> Column:
    return F.datediff(end, start) + F.lit(1)


def calendar(spark: SparkSession, start: date | Column, end: date | Column, name: str = "period") -> DataFrame:
    """One row per day of an inclusive window (a window has thousands of days at most)."""
    return spark.range(1).select(F.explode(F.sequence(day(start), day(end))).alias(name))


def observed_calendar(df: DataFrame, period: str = "period") -> DataFrame:
    """Every day between the first and the last observation."""
    bounds = df.agg(F.min(period).alias("first"), F.max(period).alias("last"))
    return bounds.select(F.explode(F.sequence("first", "last")).alias(period))


def latest(df: DataFrame, period: str = "period") -> Column:
    """The newest observation as a scalar subquery: no extra action, no join."""
    return df.agg(F.max(period).alias("latest")).scalar()


def resolve_range(
    newest: date, preset: str | None = None, start: date | None = None, end: date | None = None
) -> tuple[date, date]:
    """A preset ends at the newest observation; a custom range is taken as it is given."""
    if preset is not None and (start is not None or end is not None):
        raise ValueError("Give a preset or a range, not both")
    if (start is None) != (end is None):
        raise ValueError("A range needs both ends")
    if start is not None:
        if not 1 <= (end - start).days + 1 <= MAX_RANGE_DAYS:
            raise ValueError("A range holds 1 to 366 days")
        return start, end
    count = PRESET_DAYS[preset or "30d"]
    return newest - timedelta(days=count - 1), newest


def preset_start(newest: Column, preset: str) -> Column:
    return F.date_sub(newest, PRESET_DAYS[preset] - 1)


def between(df: DataFrame, start: date | Column, end: date | Column, period: str = "period") -> DataFrame:
    return df.filter((F.col(period) >= day(start)) & (F.col(period) <= day(end)))
