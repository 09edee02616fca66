"""Daily series, single-day metric, freshness and facility contributions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.contracts import FACILITY, GrainSpec
from fleetgauge.functions.dates import between, calendar, day, latest, preset_start
from fleetgauge.functions.exact import SHARE, TOTAL, outside_percent, share_percent, share_reason
from fleetgauge.operators.adjacency import with_previous_day
from fleetgauge.operators.numbering import rank_within
from fleetgauge.sources.history import active_event


def build_points(national: DataFrame, days: DataFrame) -> DataFrame:
    """One point per requested day. A day nobody reported has a reason, never a zero."""
    shares = national.select(
        "period", "capacity", "outage", "percentOutage",
        share_percent("outage", "capacity").alias("offline_share_percent"), share_reason("capacity").alias("_reason"),
        F.lit(True).alias("_reported"),
    )
    reason = F.when(F.col("_reported").isNull(), F.lit("not_reported")).otherwise(F.col("_reason"))
    return days.join(shares, "period", "left").select(
        "period", "capacity", "outage", "percentOutage", "offline_share_percent", reason.alias("reason")
    )


def dashboard(national: DataFrame, start: date | Column, end: date | Column) -> DataFrame:
    """Points of an inclusive range; the filter on ``period`` reaches the Parquet scan."""
    return build_points(between(national, start, end), calendar(national.sparkSession, start, end))


def dashboard_preset(national: DataFrame, preset: str) -> DataFrame:
    newest = latest(national)
    return dashboard(national, preset_start(newest, preset), newest)


def metric(national: DataFrame, on: date | Column) -> DataFrame:
    """One day's share: the dashboard of a one-day range."""
    return dashboard(national, on, on).select("period", F.col("offline_share_percent").alias("value"), "reason")


def day_card(points: DataFrame) -> DataFrame:
    """Remaining capacity and remaining share, and whether the share is out of range."""
    share = F.col("offline_share_percent")
    return points.select(
        "period", "capacity", "outage", "offline_share_percent", "reason",
        outside_percent(share).alias("out_of_range"),
        (F.col("capacity") - F.col("outage")).cast(TOTAL).alias("remaining_capacity"),
        (F.lit(100) - share).cast(SHARE).alias("remaining_percent"),
    )


def previous_day_line(points: DataFrame) -> DataFrame:
    """Change in percentage points against the day before, or why there is none."""
    return with_previous_day(
        points.select("period", "offline_share_percent", "reason"), "offline_share_percent", "reason"
    ).withColumn("change_points", F.col("change_points").cast(SHARE))


def freshness(national: DataFrame, log: DataFrame) -> DataFrame:
    """Latest observation of the published rows and the time of their publication."""
    newest = latest(national)
    return active_event(log).select("version_id", newest.alias("latest_observation_date"), "published_at")


def daily_peaks(facility: DataFrame, spec: GrainSpec = FACILITY) -> DataFrame:
    return facility.groupBy(spec.period).agg(
        F.max("outage").alias("largest_outage"), F.sum("outage").cast(TOTAL).alias("facility_total"),
        F.count(F.lit(1)).alias("facilities"),
    )


def contribution_bars(facility: DataFrame, spec: GrainSpec = FACILITY) -> DataFrame:
    """Each facility's outage as a percentage of the largest one of its day."""
    return facility.join(daily_peaks(facility, spec).select(spec.period, "largest_outage"), spec.period).select(
        *spec.keys, spec.label, "outage",
        F.coalesce(share_percent("outage", "largest_outage"), F.lit(0)).cast(SHARE).alias("bar_percent"),
    )


def ranked_contributions(facility: DataFrame, spec: GrainSpec = FACILITY) -> DataFrame:
    """Bars with their position in the day, largest outage first."""
    order = [F.col("outage").desc_nulls_last(), *[F.col(k).asc_nulls_last() for k in spec.entity]]
    return rank_within(contribution_bars(facility, spec), [spec.period], order)


def day_contributions(facility: DataFrame, on: date | Column, spec: GrainSpec = FACILITY) -> DataFrame:
    """The bars of one day in display order."""
    bars = contribution_bars(facility.filter(F.col(spec.period) == day(on)), spec)
    return bars.orderBy(F.col("outage").desc_nulls_last(), *[F.col(k).asc_nulls_last() for k in spec.entity])


def contribution_totals(facility: DataFrame, national: DataFrame) -> DataFrame:
    """The sum of a day's facilities next to the national value; they may differ."""
    totals = daily_peaks(facility)
    return totals.join(national.select("period", F.col("outage").alias("national_outage")), "period", "full_outer").select(
        "period", "facilities", "facility_total", "national_outage",
        (F.col("facility_total") - F.col("national_outage")).cast(TOTAL).alias("difference"),
    )


def trailing_series(
    df: DataFrame, spec: GrainSpec, end: date | Column, days: int = 8, ids: dict[str, str] | None = None
) -> DataFrame:
    """The last ``days`` days of every entity with a row in them, or of the one that ``ids`` names; a day without a
    row stays null. Only the range is read."""
    last = day(end)
    recent = between(df, F.date_sub(last, days - 1), last, spec.period)
    for name, value in (ids or {}).items():
        recent = recent.filter(F.col(name) == F.lit(value))
    entities = recent.select(*spec.entity).distinct()
    slots = entities.select(*spec.entity, F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias(spec.period))
    return slots.join(recent.select(*spec.keys, "outage"), list(spec.keys), "left").select(*spec.keys, "outage")


