"""Strict text-to-value expressions, with an error code where a text is refused."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.contracts import MEASURE, GrainSpec

# Accepted text forms, unit labels and, in the functions below, the codes of refusals.
BLANK = r"^[\s\p{Z}\x1C-\x1F\x85]*\z"
DATE_TEXT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
DECIMAL_TEXT = r"^[+-]?(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)\z"
FITTING_DECIMAL = r"^[+-]?(?:0*[0-9]{1,18}(?:\.[0-9]{1,6}0*)?|\.[0-9]{1,6}0*)\z"
INTEGER_DIGITS = r"^[+-]?0*([0-9]*)"
UNITS = {"capacity": "megawatts", "outage": "megawatts", "percentOutage": "percent"}


def is_blank(text: Column) -> Column:
    return text.isNull() | text.rlike(BLANK)


def kept_text(text: Column) -> Column:
    """Optional text: blank becomes null, anything else is kept verbatim. Text from ``!`` to ``~`` starts with a visible
    character, and needs no search."""
    return F.when(text.between("!", "~") | ~is_blank(text), text)


@dataclass(frozen=True)
class Parsed:
    value: Column
    error: Column


def parse_text(text: Column) -> Parsed:
    error = F.when(is_blank(text), F.lit("required_text"))
    return Parsed(F.when(error.isNull(), text), error)


def parse_date(text: Column) -> Parsed:
    day = F.when(text.rlike(DATE_TEXT) & ~text.startswith("0000"), text.try_cast("date"))
    error = F.when(is_blank(text), F.lit("required_text")).when(day.isNull(), F.lit("invalid_date"))
    return Parsed(day, error)


def parse_decimal(text: Column, nonnegative: bool = False) -> Parsed:
    """DECIMAL(24,6) text that fits without rounding; the form is tested before the cast."""
    number = F.when(text.rlike(FITTING_DECIMAL), text.try_cast(MEASURE))
    value = F.when(number >= 0, number) if nonnegative else number
    error = (
        F.when(number.isNotNull(), F.when(number < 0, F.lit("negative_capacity")) if nonnegative else F.lit(None))
        .when(is_blank(text), F.lit("required_text"))
        .when(~text.rlike(DECIMAL_TEXT), F.lit("invalid_decimal"))
        .when(F.length(F.regexp_extract(text, INTEGER_DIGITS, 1)) > 18, F.lit("decimal_overflow"))
        .otherwise(F.lit("decimal_scale"))
    )
    return Parsed(value, error)


def normalize(raw: DataFrame, spec: GrainSpec, keep: tuple[str, ...] = ()) -> DataFrame:
    """Typed columns plus ``error_code``/``error_field`` of the first refused field.

    ``raw`` holds one text column per source field. A boolean ``<field>_not_text``
    column, where present, marks a value that was not text in the source, and a
    ``body_fault`` column a page that was refused whole.

    Values are parsed in one projection and judged in the next, so a good row pays for
    one test and one cast per field; the tests that name a fault run for faults only.
    """
    present = set(raw.columns)
    numbers = (*spec.measures, spec.percent)

    def text(name: str) -> Column:
        return F.col(f"`{name}`") if name in present else F.lit(None).cast("string")

    def not_text(name: str) -> Column:
        return F.col(f"{name}_not_text") if f"{name}_not_text" in present else F.lit(False)

    values = {spec.period: parse_date(text(spec.period)).value}
    values |= {name: kept_text(text(name)) for name in (*spec.entity, *([spec.label] if spec.label else []))}
    values |= {name: parse_decimal(text(name), nonnegative=name == "capacity").value for name in numbers}
    parsed = raw.select("*", *[value.alias(f"_{name}") for name, value in values.items()])

    def fault(condition: Column, field: str, code: Column | str) -> Column:
        code = F.lit(code) if isinstance(code, str) else code
        return F.when(condition, F.concat(code, F.lit("|"), F.lit(field)))

    def unit_fault(name: str, needed: Column) -> Column:
        wrong = ~text(f"{name}-units").eqNullSafe(F.lit(UNITS[name]))
        return fault(needed & wrong, f"{name}-units", "invalid_units")

    unparsed = lambda name: F.col(f"_{name}").isNull()
    steps = [fault(F.col("body_fault").isNotNull(), "sanitized_response", F.col("body_fault"))] if "body_fault" in present else []
    steps += [fault(unparsed(spec.period), spec.period, parse_date(text(spec.period)).error)]
    steps += [fault(unparsed(name), name, "required_text") for name in spec.entity]
    if spec.label:
        steps.append(fault(not_text(spec.label), spec.label, "invalid_text"))
    for name in spec.measures:
        steps.append(unit_fault(name, F.lit(True)))
        steps.append(fault(unparsed(name), name, parse_decimal(text(name), nonnegative=name == "capacity").error))
    percent = spec.percent
    given = ~unparsed(percent) | ~is_blank(text(percent))
    steps.append(fault(not_text(percent), percent, "invalid_text"))
    steps.append(unit_fault(percent, given))
    steps.append(fault(unparsed(percent) & given, percent, parse_decimal(text(percent)).error))
    judged = parsed.select(
        *[F.col(f"`{name}`") for name in keep], *[F.col(f"_{name}").alias(name) for name in values],
        F.split(F.coalesce(*steps), r"\|").alias("_fault"),
    )
    return judged.select(
        *keep, *values, F.col("_fault")[0].alias("error_code"), F.col("_fault")[1].alias("error_field")
    )


def accepted(normalized: DataFrame, spec: GrainSpec) -> DataFrame:
    return normalized.filter(F.col("error_code").isNull()).select(*spec.schema.names)


def refused(normalized: DataFrame) -> DataFrame:
    return normalized.filter(F.col("error_code").isNotNull())
