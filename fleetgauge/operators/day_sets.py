"""The days of an entity as bitmaps: they merge, and answer distinct days, gaps and the missing days themselves.

A set is one row per entity and stretch of 32,768 days, built in one aggregation and never larger than 4 KB,
however many rows a day has. Sets of blocks, versions or finer grains merge by OR, so distinct days of a coarser
grain need no second look at the rows.

Defined results: rows without a day are left out, null ids are an entity of their own, an empty table has no sets.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.operators.summary import by_key

SPAN = 32_768  # bits of one of Spark's bitmaps


def _day(bucket: Column, position: Column) -> Column:
    """Day number of a bit: positions run upwards from day 1 on, and downwards before it."""
    return F.when(bucket > 0, (bucket - 1) * SPAN + position + 1).otherwise(bucket * SPAN - position)


def _has(days: Column, position: Column) -> Column:
    byte = F.conv(F.hex(F.substring(days, F.floor(position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), (position % 8).cast("int"))) != 0


def day_sets(df: DataFrame, entity: tuple[str, ...], period: str = "period") -> DataFrame:
    """(entity…, bucket, days, first_day, last_day)."""
    number = F.unix_date(period).cast("long")
    dated = df.where(F.col(period).isNotNull()).select(*entity, period, F.bitmap_bucket_number(number).alias("bucket"), F.bitmap_bit_position(number).alias("bit"))
    # Days move as numbers: most sets hold few, and a bitmap of 4 KB for each would move instead.
    keys = [*entity, "bucket"]
    return by_key(dated, keys).groupBy(*keys).agg(
        F.bitmap_construct_agg("bit").alias("days"), F.min(period).alias("first_day"), F.max(period).alias("last_day")
    )


def merged(sets: DataFrame, entity: tuple[str, ...]) -> DataFrame:
    """Sets of a coarser entity, or of several blocks of rows stacked."""
    return sets.groupBy(*entity, "bucket").agg(
        F.bitmap_or_agg("days").alias("days"), F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day")
    )


def day_counts(sets: DataFrame, entity: tuple[str, ...]) -> DataFrame:
    """(entity…, days, first_day, last_day, missing_days): distinct days, and those absent between the first and the last."""
    found = sets.groupBy(*entity).agg(
        F.sum(F.bitmap_count("days")).alias("days"), F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day")
    )
    absent = F.date_diff("last_day", "first_day").cast("long") + 1 - F.col("days")
    return found.where(F.col("days") > 0).withColumn("missing_days", absent)


def missing_days(sets: DataFrame, entity: tuple[str, ...], start: date | None = None, end: date | None = None) -> DataFrame:
    """(entity…, period): a row for each day between an entity's first and last day, or of the given window, on which it has no row.

    An entity with all its days gives no work: its count says so before a day is looked at.
    """
    low = F.unix_date(F.lit(start)) if start else F.min(F.unix_date("first_day"))
    high = F.unix_date(F.lit(end)) if end else F.max(F.unix_date("last_day"))
    whole = sets.groupBy(*entity).agg(
        F.map_from_entries(F.collect_list(F.struct("bucket", "days"))).alias("sets"), F.sum(F.bitmap_count("days")).alias("held"),
        F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"), low.cast("long").alias("low"), high.cast("long").alias("high"),
    )
    inside = (F.unix_date("first_day") >= F.col("low")) & (F.unix_date("last_day") <= F.col("high"))
    open_ones = whole.where(~inside | (F.col("high") - F.col("low") + 1 > F.col("held"))).where("low <= high")
    bucket = F.bitmap_bucket_number
    buckets = open_ones.withColumn("bucket", F.explode(F.sequence(bucket(F.col("low")), bucket(F.col("high")))))
    ends = _day(F.col("bucket"), F.lit(0)), _day(F.col("bucket"), F.lit(SPAN - 1))
    first, last = F.greatest(F.least(*ends), F.col("low")), F.least(F.greatest(*ends), F.col("high"))
    days = F.try_element_at("sets", F.col("bucket"))
    absent = lambda day: ~F.coalesce(_has(days, F.bitmap_bit_position(day)), F.lit(False))
    number = F.explode(F.filter(F.sequence(first, last), absent))
    return buckets.select(*entity, number.alias("day")).select(*entity, F.date_from_unix_date(F.col("day").cast("int")).alias("period"))
