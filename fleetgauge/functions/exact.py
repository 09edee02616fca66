"""Exact decimal expressions: shares, fixed text, percentage comparison.

All of them are built-in column expressions over integers held in wide decimals,
so nothing is rounded before the one rounding that the definition asks for.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetgauge.contracts import MEASURE

WIDE = T.DecimalType(33, 0)
TOTAL = T.DecimalType(34, 6)
SHARE = T.DecimalType(38, 2)


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _decimal(text: str) -> Column:
    return F.lit(Decimal(text))


def millionths(value: Column | str) -> Column:
    return (_column(value) * F.lit(1_000_000)).cast(WIDE)


def share_percent(part: Column | str, whole: Column | str) -> Column:
    """100·part/whole at two places, half away from zero; null when whole is zero.

    With both sides as integers, (20000·part + whole) // (2·whole) is the share in
    hundredths of a percent, already rounded: no ratio is formed before the division.
    """
    part, whole = _column(part), _column(whole)
    size = millionths(F.abs(whole))
    above = (millionths(F.abs(part)) * F.lit(20_000) + size).cast(T.DecimalType(38, 0))
    below = F.nullif((size * F.lit(2)).cast(T.DecimalType(34, 0)), F.lit(0).cast(T.DecimalType(34, 0)))
    hundredths = ((above - above % below).cast(T.DecimalType(38, 0)) / below).cast(T.DecimalType(36, 0))
    signed = F.when((part < 0) != (whole < 0), -hundredths).otherwise(hundredths)
    return (signed * _decimal("0.01")).cast(SHARE)


def share_reason(whole: Column | str) -> Column:
    return F.when(_column(whole) == 0, F.lit("zero_capacity"))


def outside_percent(value: Column | str) -> Column:
    """True below 0 or above 100; the value itself is kept as it is."""
    value = _column(value)
    return (value < 0) | (value > 100)


def percent_disagrees(percent: Column | str, capacity: Column | str, outage: Column | str) -> Column:
    """|percent − 100·outage/capacity| > 0.0051, exactly; null where it does not apply.

    Doubles settle every row whose distance from the threshold exceeds the rounding
    error of the doubles themselves; only rows nearer than that need whole numbers.
    """
    percent, capacity, outage = _column(percent), _column(capacity), _column(outage)
    ratio = F.when(capacity != 0, outage.cast("double") * 100 / capacity.cast("double"))
    distance = F.abs(percent.cast("double") - ratio) - F.lit(0.0051)
    uncertain = (F.abs(percent.cast("double")) + F.abs(ratio) + 1) * F.lit(1e-13)
    return F.when(F.abs(distance) > uncertain, distance > 0).when(
        ratio.isNotNull() & percent.isNotNull(), _disagrees_exactly(percent, capacity, outage)
    )


def _disagrees_exactly(percent: Column, capacity: Column, outage: Column) -> Column:
    """The same comparison on whole millionths.

    100·outage/capacity is a whole quotient and a fraction between -1 and 1. Twice the distance to the quotient, moved by
    one towards the side of the fraction, tells on which side of the threshold the distance lies; no 48-digit product is
    formed and every DECIMAL(24,6) value stays inside 38 digits. Each operand is named as seldom as possible: the
    expression is generated in full wherever the comparison is used, and HotSpot never compiles a method above 8000 bytes.
    """
    p = millionths(percent).cast(T.DecimalType(24, 0))
    c = F.nullif(millionths(capacity).cast(T.DecimalType(24, 0)), F.lit(0).cast(T.DecimalType(24, 0)))
    scaled = (millionths(outage).cast(T.DecimalType(24, 0)) * F.lit(100_000_000)).cast(T.DecimalType(32, 0))
    rest = scaled % c
    quotient = ((scaled - rest).cast(T.DecimalType(32, 0)) / c).cast(T.DecimalType(33, 0))
    side = (F.signum(rest) * F.signum(capacity)).cast("int")
    return F.abs((p - quotient) * F.lit(2) - side) > F.lit(2 * 5100)


def exact_mean(total: Column, count: Column) -> Column:
    """Mean of DECIMAL(24,6) values at ten places, half away from zero."""
    return (total / count.cast(T.DecimalType(20, 0))).cast(T.DecimalType(28, 10))


def fixed_text(value: Column | str) -> Column:
    """Six-place plain text; null stays null."""
    return _column(value).cast(MEASURE).cast("string")
