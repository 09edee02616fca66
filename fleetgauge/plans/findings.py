"""Findings over saved exports: steps, long outages, probes, weighted shares, reconciliation."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from fleetgauge.contracts import FACILITY, GRAINS, GrainSpec
from fleetgauge.functions.dates import inclusive_days
from fleetgauge.functions.exact import TOTAL
from fleetgauge.operators.adjacency import day_pairs, membership_changes
from fleetgauge.operators.compare import (
    change_summary,
    date_defects,
    multiset_difference,
    reconcile,
    row_agreement,
    snapshot_change,
    stacked,
)
from fleetgauge.operators.runs import fully_out, longest_runs
from fleetgauge.operators.summary import coverage, first_and_last, one_row, present_every_day, reuse, weighted_percent
from fleetgauge.sources import history


def capacity_step(national: DataFrame, facility: DataFrame, before: date | Column, after: date | Column) -> DataFrame:
    """National and facility capacity on two days: one row, unavailable if a day is absent."""
    first = before if isinstance(before, Column) else F.lit(before)
    second = after if isinstance(after, Column) else F.lit(after)
    step = national.agg(
        F.max(F.when(F.col("period") == first, F.col("capacity"))).alias("national_before"),
        F.max(F.when(F.col("period") == second, F.col("capacity"))).alias("national_after"),
    )
    summary = change_summary(snapshot_change(facility, FACILITY, before, after))
    both = one_row([step, summary])
    kept = F.col("increased") + F.col("decreased") + F.col("unchanged")
    available = (
        F.col("national_before").isNotNull() & F.col("national_after").isNotNull()
        & F.col("total_before").isNotNull() & F.col("total_after").isNotNull()
    )
    return both.select(
        available.alias("available"),
        "national_before", "national_after",
        (F.col("national_after") - F.col("national_before")).cast(TOTAL).alias("national_difference"),
        (F.col("total_after") - F.col("total_before")).cast(TOTAL).alias("facility_total_difference"),
        (kept + F.col("removed")).alias("facilities_before"),
        (kept + F.col("added")).alias("facilities_after"),
        "increased", "decreased", "unchanged", "added", "removed",
    )


def observed_day_pairs(df: DataFrame, spec: GrainSpec) -> DataFrame:
    """Membership changes between consecutive *observed* days (a gap joins its two edges).

    The observed days are a calendar-sized list, so each day's successor is one small
    window, joined back by day.
    """
    days = df.select(spec.period).distinct()
    order = Window.orderBy(F.col(spec.period).asc_nulls_last())  # one row per observed day
    index = days.select(spec.period, F.row_number().over(order).alias("_i"))
    # Positions stand in for dates, so the adjacency operator sees the gaps closed.
    placed = df.join(index, spec.period).withColumn("_d", F.date_add(F.lit(date(1970, 1, 1)), F.col("_i")))
    inner = GrainSpec(spec.name, ("_d", *spec.entity), None, spec.label, spec.measures)
    last = days.agg(F.count(F.lit(1))).scalar()
    start, end = F.lit(date(1970, 1, 2)), F.date_add(F.lit(date(1970, 1, 1)), last.cast("int"))
    changes = membership_changes(day_pairs(placed, inner, "capacity", start, end), inner)
    at = index.select(F.col(spec.period).alias("after"), F.date_add(F.lit(date(1970, 1, 1)), F.col("_i")).alias("_d"))
    before = index.select(
        F.col(spec.period).alias("before"), F.date_add(F.lit(date(1970, 1, 1)), F.col("_i") + 1).alias("_d")
    )
    return changes.join(at, "_d").join(before, "_d").select("before", "after", "change", *spec.entity)


def outage_histories(facility: DataFrame, generator: DataFrame) -> DataFrame:
    """For every facility: first and last observation, gaps, full outages, unit agreement."""
    spec = FACILITY
    ends = first_and_last(facility, spec, ("capacity", "outage", "percentOutage"))
    counts = facility.groupBy("facility").agg(F.count_if(fully_out()).alias("full_days"))
    days = facility.groupBy("facility", "period").agg(F.lit(1).alias("_one")).groupBy("facility").agg(
        F.count(F.lit(1)).alias("days")
    )
    longest = longest_runs(facility, spec, fully_out())
    units = row_agreement(facility, generator, spec, ("capacity", "outage", "percentOutage"))
    joined = (
        ends.join(counts, "facility").join(days, "facility").join(longest, "facility", "left")
        .join(units.select("facility", "matching_rows", "agrees"), "facility", "left")
    )
    return joined.select(
        "facility", "records", "first_day", "last_day", "first_capacity", "first_outage", "last_capacity", "last_outage",
        (inclusive_days(F.col("first_day"), F.col("last_day")) - F.col("days")).cast("long").alias("missing_days"),
        "full_days",
        F.coalesce("run_days", F.lit(0)).alias("longest_full_days"), "run_start", "run_end",
        F.coalesce("matching_rows", F.lit(0)).alias("matching_rows"),
        F.coalesce("agrees", F.lit(False)).alias("units_agree"),
    )


def probe_counts(pages: DataFrame, rows: DataFrame, probes: DataFrame, spec: GrainSpec) -> DataFrame:
    """Advertised, returned and exported rows of every probe, and whether the rows agree.

    ``pages`` holds typed probe rows with a ``probe`` column, ``rows`` the exported rows
    with the same column, ``probes`` one row per probe (advertised_total, offset, empty_tail).
    """
    columns = [*spec.keys, "capacity", "outage", "percentOutage"]
    returned = pages.groupBy("probe").agg(F.count(F.lit(1)).alias("returned_rows"))
    exported = rows.groupBy("probe").agg(F.count(F.lit(1)).alias("exported_rows"))
    differing = multiset_difference(pages.select("probe", *columns), rows.select("probe", *columns))
    bad = differing.groupBy("probe").agg(F.count(F.lit(1)).alias("differing"))
    joined = reduce(lambda a, b: a.join(b, "probe", "left"), [probes, returned, exported, bad])
    count = lambda name: F.coalesce(F.col(name), F.lit(0))
    rows_tie = (F.col("offset") == 0) & (count("differing") == 0)
    tail_ties = (count("returned_rows") == 0) & (F.col("offset") == count("exported_rows"))
    return joined.select(
        "probe", "advertised_total", "offset",
        count("returned_rows").alias("returned_rows"), count("exported_rows").alias("exported_rows"),
        F.when(F.col("empty_tail"), tail_ties).otherwise(rows_tie).alias("agrees"),
    )


def weighted_report(facility: DataFrame, generator: DataFrame) -> DataFrame:
    """Weighted share and plain mean of every facility day beside the reported percentage."""
    shares = weighted_percent(generator, ["period", "facility"])
    return shares.join(
        facility.select("period", "facility", F.col("percentOutage").alias("reported_percent")), ["period", "facility"]
    )


def id_reuse(generator: DataFrame) -> DataFrame:
    return reuse(generator, ["period", "generator"], "facility")


def reconciliation_report(national: DataFrame, facility: DataFrame, generator: DataFrame) -> DataFrame:
    families = [
        reconcile(generator, facility, ["period", "facility"], "generator_sum_to_facility"),
        reconcile(facility, national, ["period"], "facility_sum_to_national"),
        reconcile(generator, national, ["period"], "generator_sum_to_national"),
    ]
    return stacked(families, ["period", "facility"])


def summary_columns() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("comparisons"),
        F.count_if(F.col("status") != "match").alias("nonmatching"),
        F.max(F.abs("difference")).alias("max_absolute_difference"),
    ]


def reconciliation_summary(comparisons: DataFrame) -> DataFrame:
    return comparisons.agg(*summary_columns())


def save_report(report: DataFrame, folder: str) -> None:
    """Write a reconciliation report and its summary. The summary is observed while the comparisons are written, after
    the last shuffle, so they are worked out once and stored once."""
    seen = Observation()
    schema = reconciliation_summary(report).schema

    def summary() -> DataFrame:
        found = seen.get
        return report.sparkSession.createDataFrame([tuple(found[name] for name in schema.names)], schema)

    history.write_report(report.observe(seen, *summary_columns()), summary, folder)


def claims(observed: DataFrame, expected: list[tuple[str, Column]]) -> DataFrame:
    """Named true/false claims about one row of observations; an unknown one is false."""
    return observed.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(name).alias("claim"), F.coalesce(condition, F.lit(False)).alias("holds"))
                    for name, condition in expected
                ]
            )
        )
    )


def scope_facts(tables: dict[str, DataFrame], window: DataFrame) -> DataFrame:
    """Coverage of each grain as one row of prefixed columns."""
    parts = []
    for name, df in tables.items():
        facts = coverage(df, GRAINS[name])
        defects = date_defects(df, window).agg(F.count("defect").alias("date_defects"))
        both = one_row([facts, defects])
        parts.append(both.select(*[F.col(c).alias(f"{name}_{c}") for c in both.columns]))
    return one_row(parts)


def history_of(histories: DataFrame, facility: str) -> DataFrame:
    """One facility's history as a row that is there even if the facility is not."""
    own = histories.filter(F.col("facility") == F.lit(facility))
    return own.agg(*[F.max(c).alias(c) for c in histories.columns if c != "facility"])


def finding_claims(
    tables: dict[str, DataFrame], window: DataFrame, probes: DataFrame, *, facility: str, step: tuple, weighted: tuple[date | Column, str],
    reused: tuple[date | Column, str], expected: dict[str, object],
) -> DataFrame:
    """The 16 named claims of the findings report against expected values."""
    national, facilities, generators = tables["national"], tables["facility"], tables["generator"]
    comparisons = reconciliation_report(national, facilities, generators)
    history = history_of(outage_histories(facilities, generators), facility)
    changes = observed_day_pairs(facilities, FACILITY)
    entry = changes.agg(
        F.count(F.lit(1)).alias("membership_changes"),
        F.count_if((F.col("facility") == facility) & (F.col("change") == "added")).alias("own_additions"),
    )
    always = present_every_day(facilities, FACILITY).agg(F.count(F.lit(1)).alias("always_present"))
    first_day = history.select("first_day").scalar()
    entry_step = capacity_step(national, facilities, F.date_sub(first_day, 1), first_day)
    entry_step = entry_step.select(
        F.col("national_difference").alias("entry_difference"), F.col("unchanged").alias("entry_unchanged")
    )
    share = weighted_percent(
        generators.filter((F.col("period") == weighted[0]) & (F.col("facility") == weighted[1])), ["period", "facility"]
    ).agg(F.max("weighted_percent").alias("weighted_percent"), F.max("mean_percent").alias("mean_percent"))
    owners = id_reuse(
        generators.filter((F.col("period") == reused[0]) & (F.col("generator") == reused[1]))
    ).agg(F.max("owners").alias("owners"))
    kind = F.col("kind")

    def probe(name: str, column: str, of: str) -> Column:
        return F.max(F.when((kind == name) & (F.col("dataset") == of), F.col(column)))

    probe_facts = probes.agg(
        F.bool_and("agrees").alias("probes_agree"),
        *[
            probe(name, column, of).alias(f"{of}_{name}_{column}")
            for name in ("day", "day_tail", "entity", "window_tail") for of in ("facility", "generator")
            for column in ("advertised_total", "returned_rows", "offset")
        ],
    )
    observed = one_row(
        [
            scope_facts(tables, window), window.agg(F.count(F.lit(1)).alias("window_days")),
            reconciliation_summary(comparisons), capacity_step(national, facilities, *step), history, entry, always,
            entry_step, share, owners, probe_facts,
        ]
    )
    c, e = F.col, lambda name: F.lit(expected[name])
    covered = reduce(
        lambda a, b: a & b,
        [(c(f"{g}_date_defects") == 0) & (c(f"{g}_rows") == c(f"{g}_unique_keys")) for g in GRAINS],
    )
    return claims(
        observed,
        [
            ("at_least_30_days", c("window_days") >= 30),
            ("daily_coverage_and_keys", covered),
            ("exact_reconciliation", c("nonmatching") == 0),
            ("step_in_capacity", (c("national_difference") == e("step_difference")) & (c("facility_total_difference") == e("step_difference"))),
            ("step_same_facilities", (c("facilities_before") == e("step_facilities")) & (c("facilities_after") == e("step_facilities")) & (c("added") == 0) & (c("removed") == 0)),
            ("outage_first_and_last", (c("first_day") == e("first_day")) & (c("last_day") == e("last_day")) & (c("first_capacity") == e("first_capacity")) & (c("last_capacity") == e("last_capacity"))),
            ("outage_every_day", (c("records") == e("full_days")) & (c("full_days") == e("full_days")) & (c("longest_full_days") == e("full_days")) & (c("missing_days") == 0)),
            ("outage_units_agree", c("units_agree")),
            ("outage_only_addition", (c("membership_changes") == 1) & (c("own_additions") == 1) & (c("always_present") == e("always_present"))),
            ("outage_entry_capacity", (c("entry_difference") == e("first_capacity")) & (c("entry_unchanged") == e("always_present"))),
            ("probes_match_export", c("probes_agree")),
            ("probes_one_day", (c("facility_day_advertised_total") == e("day_advertised")) & (c("facility_day_returned_rows") == e("day_returned")) & (c("generator_day_advertised_total") == c("generator_day_returned_rows"))),
            ("probes_one_entity", (c("facility_entity_advertised_total") == e("entity_advertised")) & (c("facility_entity_returned_rows") == e("entity_returned")) & (c("generator_entity_advertised_total") == c("generator_entity_returned_rows"))),
            ("probes_end_empty", (c("facility_day_tail_offset") == c("facility_day_returned_rows")) & (c("facility_window_tail_offset") == c("facility_rows")) & (c("facility_window_tail_advertised_total") == c("generator_rows"))),
            ("weighted_example", (c("weighted_percent") == e("weighted_percent")) & (c("mean_percent") == e("mean_percent"))),
            ("id_reused", c("owners") == e("owners")),
        ],
    )


