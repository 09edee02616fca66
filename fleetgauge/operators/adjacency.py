"""Changes between consecutive days.

Every observation is sent to its own day and to the next one, and one aggregation on
(entity, day) brings both sides together. Hashing on entity *and* day spreads an
entity that holds a large part of the table; nothing is sorted and nothing is carried
over a gap, because a day without a predecessor simply has no "previous" half.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.contracts import GrainSpec
from fleetgauge.functions.exact import TOTAL
from fleetgauge.operators.summary import by_key


def day_pairs(
    df: DataFrame, spec: GrainSpec, value: str = "capacity", start: Column | None = None, end: Column | None = None
) -> DataFrame:
    """Per (entity, day): whether the entity was there, whether it was there the day
    before, and both values. With a window, only pairs inside the window count."""
    period = F.col(spec.period)
    sides = F.array(
        F.struct(period.alias("day"), F.lit(True).alias("now")),
        F.struct(F.date_add(period, 1).alias("day"), F.lit(False).alias("now")),
    )
    spread = df.select(*spec.entity, F.col(value).alias("_v"), F.explode(sides).alias("s"))
    if start is not None:
        spread = spread.filter((F.col("s.day") > start) & (F.col("s.day") <= end))
    now, keys = F.col("_now"), [*spec.entity, spec.period]
    spread = spread.select(*spec.entity, "_v", F.col("s.day").alias(spec.period), F.col("s.now").alias("_now"))
    # Aggregated in a table where they arrive, without a sort: a task's table is that of one shuffle partition.
    highest = lambda side: F.max(F.when(side, F.col("_v")))
    return by_key(spread, keys).groupBy(*keys).agg(
        F.count_if(now).alias("rows_now"),
        F.count_if(~now).alias("rows_before"),
        highest(~now).alias("previous_value"),
        highest(now).alias("value"),
    )


def was() -> Column:
    return F.col("rows_before") > 0


def is_now() -> Column:
    return F.col("rows_now") > 0


def member_change() -> Column:
    return F.when(is_now() & ~was(), F.lit("added")).when(was() & ~is_now(), F.lit("removed"))


def membership_changes(pairs: DataFrame, spec: GrainSpec) -> DataFrame:
    change = member_change()
    return pairs.select(
        spec.period, F.date_sub(spec.period, 1).alias("previous_period"), *spec.entity, change.alias("change")
    ).filter(F.col("change").isNotNull())


def value_changes(pairs: DataFrame, spec: GrainSpec) -> DataFrame:
    return pairs.filter(value_changed()).select(
        spec.period, F.date_sub(spec.period, 1).alias("previous_period"), *spec.entity, "previous_value", "value",
        (F.col("value") - F.col("previous_value")).cast(TOTAL).alias("difference"),
    )


def member_changed() -> Column:
    return is_now() != was()


def value_changed() -> Column:
    return is_now() & was() & (F.col("value") != F.col("previous_value"))


def pair_counts() -> list[Column]:
    """Checked and affected counts of both kinds of change, for one aggregation over pairs."""
    return [
        F.count(F.lit(1)).alias("membership_checked"),
        F.count_if(member_changed()).alias("membership_affected"),
        F.count_if(is_now() & was()).alias("value_checked"),
        F.count_if(value_changed()).alias("value_affected"),
        F.count_if((F.col("rows_now") > 1) | (F.col("rows_before") > 1)).alias("repeated"),
    ]


def with_previous_day(points: DataFrame, value: str, reason: str | None = None, period: str = "period") -> DataFrame:
    """Yesterday's value (and the reason it is absent) next to today's, for a daily series."""
    names = [value] + ([reason] if reason else [])
    earlier = points.select(
        F.date_add(period, 1).alias(period), F.lit(True).alias("_known"), *[F.col(n).alias(f"previous_{n}") for n in names]
    )
    joined = points.join(earlier, period, "left")
    if reason:
        joined = joined.withColumn(
            f"previous_{reason}", F.when(F.col("_known").isNull(), F.lit("not_reported")).otherwise(F.col(f"previous_{reason}"))
        )
    return joined.drop("_known").withColumn("change_points", F.col(value) - F.col(f"previous_{value}"))
