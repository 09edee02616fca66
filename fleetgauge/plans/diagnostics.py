"""Diagnostics: values that are kept as published but worth a note."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.contracts import DIAGNOSTIC_MESSAGES, DIAGNOSTIC_SCOPES, GrainSpec
from fleetgauge.functions.digests import SLICE, fingerprint, row_digest
from fleetgauge.functions.exact import outside_percent, percent_disagrees
from fleetgauge.operators.adjacency import day_pairs, member_changed, pair_counts, value_changed
from fleetgauge.plans.outcomes import outcome, outcomes


def row_conditions(spec: GrainSpec) -> dict[str, Column]:
    """The condition of each row diagnostic that applies to a grain."""
    conditions = {
        "D01": F.col(spec.label).isNull() if spec.label else None,
        "D02": F.col("percentOutage").isNull(),
        "D03": F.col("outage") < 0,
        "D04": F.col("outage") > F.col("capacity"),
        "D05": F.coalesce(outside_percent("percentOutage"), F.lit(False)),
        "D06": F.coalesce(percent_disagrees("percentOutage", "capacity", "outage"), F.lit(False)),
    }
    return {code: c for code, c in conditions.items() if c is not None and spec.name in DIAGNOSTIC_SCOPES[code]}


def reasons() -> list[Column]:
    """Why D06 cannot be judged, each null where it does not hold."""
    return [
        F.when(F.col("percentOutage").isNull(), F.lit("missing_source_percentage")),
        F.when(F.col("capacity") == 0, F.lit("zero_capacity")),
    ]


def not_applicable() -> Column:
    """Why D06 cannot be judged: an array of reasons, empty where it can."""
    return F.array_compact(F.array(*reasons()))


def row_diagnostics(df: DataFrame, spec: GrainSpec, codes: tuple[str, ...] | None = None, width: int = SLICE) -> DataFrame:
    """D01–D06 (or ``codes`` of them) in one pass without a shuffle of rows. Each condition is judged
    once per row, in a projection of its own, before the counts and fingerprints use it."""
    conditions = {code: c for code, c in row_conditions(spec).items() if codes is None or code in codes}
    columns = [*spec.keys, *spec.measures, "percentOutage"]
    judged = df.select(*columns, *[c.alias(code) for code, c in conditions.items()])
    judged = judged.withColumn("_digest", F.when(reduce(or_, [F.col(code) for code in conditions]), row_digest(columns)))
    facts = judged.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col(code)).alias(f"{code}_affected") for code in conditions],
        *[fingerprint(F.col(code), width=width).alias(f"{code}_details") for code in conditions],
    )
    return outcomes(
        facts,
        [
            outcome(code, spec.name, F.col("n"), F.col(f"{code}_affected"), F.col(f"{code}_details"))
            for code in conditions
        ],
    )


def affected_rows(df: DataFrame, spec: GrainSpec, code: str) -> DataFrame:
    return df.filter(row_conditions(spec)[code]).select(*spec.keys, *spec.measures, "percentOutage")


def change_diagnostics(
    df: DataFrame, spec: GrainSpec, start: Column, end: Column, codes: tuple[str, ...] = ("D07", "D08"), width: int = SLICE
) -> DataFrame:
    """D07 and D08 (or one of them) from one aggregation over the pairs of window days."""
    pairs = day_pairs(df, spec, "capacity", start, end)
    columns = [*spec.keys, "previous_value", "value"]
    pairs = pairs.withColumn("_digest", F.when(member_changed() | value_changed(), row_digest(columns)))
    facts = pairs.agg(
        *pair_counts(),
        fingerprint(member_changed(), width=width).alias("membership_details"),
        fingerprint(value_changed(), width=width).alias("value_details"),
    )
    rows = []
    if "D07" in codes and spec.name in DIAGNOSTIC_SCOPES["D07"]:
        rows.append(
            outcome("D07", spec.name, F.col("membership_checked"), F.col("membership_affected"), F.col("membership_details"))
        )
    if "D08" in codes:
        rows.append(outcome(
            "D08", spec.name, F.col("value_checked"), F.col("value_affected"), F.col("value_details"),
            error=F.col("repeated") > 0,
        ))
    return outcomes(facts, rows)


def notes(results: DataFrame, dataset: str | None = None) -> DataFrame:
    """Nonzero diagnostics to show with a table; the advertised-total one is never shown."""
    message = F.create_map(*[F.lit(x) for pair in DIAGNOSTIC_MESSAGES.items() for x in pair])
    shown = results.filter(~F.col("required") & (F.col("check_code") != "D09") & (F.col("failed_count") > 0))
    if dataset is not None:
        shown = shown.filter(F.col("dataset_key") == dataset)
    return shown.select(
        F.col("check_code").alias("code"), "severity", F.col("dataset_key").alias("scope"),
        message[F.col("check_code")].alias("message"), F.col("failed_count").cast("string").alias("affected_count"),
    )
