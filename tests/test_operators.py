from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fleetgauge.contracts import FACILITY, GENERATOR, NATIONAL, GrainSpec
from fleetgauge.functions.dates import calendar, resolve_range
from fleetgauge.operators import adjacency, compare, numbering, paging, runs, summary
from fleetgauge.plans import dashboard, findings
from rows import frame, frames, observation, reconciled


def test_reconcile_is_exact_and_missing_is_not_zero(spark):
    units = frame(spark, GENERATOR, [observation(capacity="0.1", outage="0.000001"), observation(generator="2", capacity="0.2")])
    plants = frame(spark, FACILITY, [observation(capacity="0.3", outage="0.000001"), observation(facility="7", capacity="0")])
    found = {(r["facility"], r["measure"]): (r["status"], r["difference"]) for r in compare.reconcile(units, plants, ["period", "facility"], "x").collect()}
    assert found == {
        ("46", "capacity"): ("match", Decimal(0)), ("46", "outage"): ("match", Decimal(0)),
        ("7", "capacity"): ("missing", None), ("7", "outage"): ("missing", None),
    }


def test_snapshot_change_keeps_added_and_removed_missing(spark):
    df = frame(spark, FACILITY, [observation("2026-09-30", "001"), observation("2026-10-01", "002", capacity="120")])
    found = {r["facility"]: (r["change"], r["difference"]) for r in compare.snapshot_change(df, FACILITY, date(2026, 9, 30), date(2026, 10, 1)).collect()}
    assert found == {"001": ("removed", None), "002": ("added", None)}


def test_capacity_step_is_unavailable_without_both_days(spark):
    t = frames(spark, reconciled())
    assert findings.capacity_step(t["national"], t["facility"], date(2026, 10, 1), date(2026, 10, 9)).first()["available"] is False
    row = findings.capacity_step(t["national"], t["facility"], date(2026, 10, 1), date(2026, 10, 2)).first()
    assert (row["available"], row["unchanged"], row["facilities_before"]) == (True, 2, 2)


def _outages(spark, days, full=()):
    return frame(
        spark, FACILITY,
        [observation(f"2026-10-{d:02}", outage="100" if d in full else "99.9", percent="100" if d in full else "99.9") for d in days],
    )


@pytest.mark.parametrize(
    "days,full,expected",
    [
        ((1, 2, 4, 5, 6), (1, 2, 4, 5, 6), (3, 4, 6)), ((1, 2, 4, 5, 6), (1, 2, 4, 6), (2, 1, 2)), ((1, 2, 3, 4), (1, 2, 4), (2, 1, 2)),
        ((1, 2, 4, 5), (1, 2, 4, 5), (2, 1, 2)), ((3,), (3,), (1, 3, 3)),
    ],
)
def test_longest_run(spark, days, full, expected):
    row = runs.longest_runs(_outages(spark, days, full), FACILITY, runs.fully_out()).first()
    assert (row["run_days"], row["run_start"].day, row["run_end"].day) == expected


def test_zero_capacity_is_no_full_outage(spark):
    df = frame(spark, FACILITY, [observation(capacity="0", outage="0", percent="100")])
    assert runs.longest_runs(df, FACILITY, runs.fully_out()).count() == 0


def test_changes_are_not_carried_over_a_gap(spark):
    days = (("2026-10-01", "200"), ("2026-10-03", "400"), ("2026-10-04", "300"))
    df = frame(spark, NATIONAL, [observation(d, capacity=c) for d, c in days])
    found = adjacency.value_changes(adjacency.day_pairs(df, NATIONAL), NATIONAL).collect()
    assert [(r["period"].day, r["previous_value"], r["value"]) for r in found] == [(4, Decimal(400), Decimal(300))]


def test_an_empty_day_removes_and_adds_every_entity(spark):
    df = frame(spark, FACILITY, [observation("2026-10-01"), observation("2026-10-03")])
    pairs = adjacency.day_pairs(df, FACILITY, "capacity", F.lit(date(2026, 10, 1)), F.lit(date(2026, 10, 3)))
    assert sorted((r["period"].day, r["change"]) for r in adjacency.membership_changes(pairs, FACILITY).collect()) == [(2, "removed"), (3, "added")]
    assert pairs.count() == 2


def test_observed_day_changes_bridge_a_gap(spark):
    df = frame(spark, FACILITY, [observation("2026-10-01"), observation("2026-10-05"), observation("2026-10-05", "7")])
    found = findings.observed_day_pairs(df, FACILITY).collect()
    assert [(r["before"].day, r["after"].day, r["change"], r["facility"]) for r in found] == [(1, 5, "added", "7")]


def test_latest_label_then_search(spark):
    rows = [
        observation("2025-01-01", "0046", label="Old"), observation("2025-01-02", "0046", label="Zulu"),
        observation("2025-01-02", "0046", "2", label="Alpha"), observation("2025-01-03", "0046", label=None), observation("2025-01-03", "46", label=None),
    ]
    df = frame(spark, GENERATOR, rows)
    assert sorted(map(tuple, paging.facility_choices(df, GENERATOR).collect())) == [("0046", "Alpha"), ("46", None)]
    assert paging.facility_choices(df, GENERATOR, "OLD").count() == 0
    assert paging.facility_choices(df, GENERATOR, "alpHA").count() == 1


def test_choices_page_in_byte_order(spark):
    ids = ["01", "1", "A", "a", "é", "😀"]
    df = frame(spark, FACILITY, [observation(facility=f) for f in reversed(ids)])
    found, after = [], None
    while True:
        rows, more = paging.choice_page(paging.facility_choices(df, FACILITY), "facility", 1, after)
        found.append(rows[0]["facility"])
        if not more:
            break
        after = found[-1]
    assert found == ids


def test_generators_belong_to_one_facility(spark):
    df = frame(spark, GENERATOR, [observation(facility="0046", generator="01"), observation("2026-10-02", "0046", "01"), observation(facility="46", generator="2")])
    assert [tuple(r) for r in paging.generator_choices(df, "0046").collect()] == [("0046", "01")]
    with pytest.raises(ValueError):
        paging.selected(df, GENERATOR, ids={"generator": "01"})


def test_page_walk_equals_sorted_scan(spark):
    df = frame(spark, GENERATOR, reconciled()["generator"])
    keys, walked, after = GENERATOR.keys, [], None
    while True:
        rows, more = paging.page(df, keys, 5, after)
        walked += [tuple(r[k] for k in keys) for r in rows]
        if not more:
            break
        after = walked[-1]
    assert walked == sorted(tuple(r[k] for k in keys) for r in df.collect())


def test_capped_result(spark):
    df = spark.range(1005)
    assert paging.capped(df, 1000)[1] and len(paging.capped(df, 1000)[0]) == 1000
    assert not paging.capped(df.limit(1000), 1000)[1]


def test_dashboard_gaps_and_metric(spark):
    rows = [observation("2026-09-29", capacity="1000", outage="123.45", percent=None), observation("2026-10-01", capacity="0", outage="0")]
    national = frame(spark, NATIONAL, rows)
    points = dashboard.dashboard(national, date(2026, 9, 29), date(2026, 10, 2)).orderBy("period").collect()
    assert [(p["offline_share_percent"], p["reason"]) for p in points] == [
        (Decimal("12.35"), None), (None, "not_reported"), (None, "zero_capacity"), (None, "not_reported")
    ]
    assert points[1]["capacity"] is None and points[0]["percentOutage"] is None
    for p in points:
        m = dashboard.metric(national, p["period"]).first()
        assert (m["value"], m["reason"]) == (p["offline_share_percent"], p["reason"])


def test_ranges():
    newest = date(2026, 10, 2)
    assert resolve_range(newest) == (date(2026, 9, 3), newest)
    assert resolve_range(newest, "1y")[0] == date(2025, 10, 3)
    for bad in (("30d", newest, newest), (None, newest, None), (None, newest, date(2026, 10, 1)), (None, date(2025, 10, 1), date(2026, 10, 2))):
        with pytest.raises(ValueError):
            resolve_range(newest, *bad)


def test_weighted_percent(spark):
    df = frame(spark, GENERATOR, [observation(capacity="1", outage="1", percent="100"), observation(generator="A", capacity="3")])
    row = summary.weighted_percent(df, ["period", "facility"]).first()
    assert (row["weighted_percent"], row["mean_percent"]) == (Decimal("25.00"), Decimal(50))
    df = frame(spark, GENERATOR, [observation(capacity="20000", outage="2469", percent=None)])
    row = summary.weighted_percent(df, ["period", "facility"]).first()
    assert (row["weighted_percent"], row["mean_percent"]) == (Decimal("12.35"), None)


def test_numbering_matches_a_window(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), F.xxhash64("id").alias("v"))
    ordered = sorted((r["g"], r["v"]) for r in df.collect())
    numbered = numbering.number_rows(df, [F.col("g"), F.col("v")], "n")
    assert [(r["g"], r["v"]) for r in numbered.orderBy("n").collect()] == ordered
    assert sorted(r["n"] for r in numbered.collect()) == list(range(1, 5001))
    ranks = numbering.rank_within(df, ["g"], [F.col("v").desc()]).collect()
    for g in range(3):
        own = sorted((r for r in ranks if r["g"] == g), key=lambda r: r["position"])
        assert [r["v"] for r in own] == sorted((v for k, v in ordered if k == g), reverse=True)


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_running_totals_across_blocks(spark, block):
    df = spark.range(100).select(F.lit("a").alias("g"), F.col("id").alias("seq"))
    odd = F.when(F.col("seq") % 10 == 3, F.col("seq"))
    found = numbering.running_before(df, ["g"], "seq", {"s": ("sum", F.col("seq")), "m": ("max", odd)}, block).orderBy("seq").collect()
    assert [r["s"] for r in found] == [sum(range(i)) for i in range(100)]
    assert [r["m"] for r in found] == [max([j for j in range(i) if j % 10 == 3], default=None) for i in range(100)]


def test_one_hot_key(spark):
    """A third of all rows under one key gives the same sums and pairs as plain Python."""
    rows = [(date(2026, 1, 1), "hot" if i % 3 == 0 else str(i % 50), Decimal(i), Decimal(1)) for i in range(3000)]
    spec = GrainSpec("t", ("period", "facility"))
    df = spark.createDataFrame(rows, "period date, facility string, capacity decimal(24,6), outage decimal(24,6)")
    sums = {r["facility"]: r["capacity"] for r in summary.group_sums(df, ["facility"]).collect()}
    assert sums["hot"] == sum(i for i in range(0, 3000, 3))
    pairs = adjacency.day_pairs(df, spec).filter("facility = 'hot'").collect()
    assert sorted((p["rows_now"], p["rows_before"]) for p in pairs) == [(0, 1000), (1000, 0)]


def test_calendar_is_inclusive(spark):
    assert calendar(spark, date(2024, 2, 28), date(2024, 3, 1)).count() == 3
