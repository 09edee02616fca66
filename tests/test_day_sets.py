from datetime import date, timedelta

import pytest

from fleetgauge.operators.day_sets import day_counts, day_sets, merged, missing_days

D = date
ROWS = [
    ("old", D(1895, 3, 1)), ("old", D(1895, 3, 4)), ("old", D(1895, 3, 4)),
    ("turn", D(1969, 12, 30)), ("turn", D(1970, 1, 1)), ("turn", D(1970, 1, 3)), ("turn", None),
    ("whole", D(2024, 2, 28)), ("whole", D(2024, 2, 29)), ("whole", D(2024, 3, 1)),
    (None, D(2059, 9, 18)), (None, D(2059, 9, 22)),  # on both sides of a bitmap's end
    ("never", None),
]


def plain(rows, start=None, end=None):
    held = {}
    for key, day in rows:
        if day:
            held.setdefault(key, set()).add(day)
    out = set()
    for key, days in held.items():
        a, b = start or min(days), end or max(days)
        out |= {(key, a + timedelta(i)) for i in range((b - a).days + 1)} - {(key, d) for d in days}
    return out


@pytest.fixture(scope="module")
def sets(spark):
    return day_sets(spark.createDataFrame([(k, d, "x") for k, d in ROWS], "id string, period date, bucket string"), ("id",))


def test_counts(sets):
    found = {r.id: (r.days, r.first_day, r.last_day, r.missing_days) for r in day_counts(sets, ("id",)).collect()}
    assert found == {
        "old": (2, D(1895, 3, 1), D(1895, 3, 4), 2), "turn": (3, D(1969, 12, 30), D(1970, 1, 3), 2),
        "whole": (3, D(2024, 2, 28), D(2024, 3, 1), 0), None: (2, D(2059, 9, 18), D(2059, 9, 22), 3),
    }


def test_missing_days(spark, sets):
    rows = missing_days(sets, ("id",)).collect()
    assert len(rows) == len(set(rows)) and {tuple(r) for r in rows} == plain(ROWS)


@pytest.mark.parametrize("start,end", [(D(1969, 12, 1), D(1970, 2, 1)), (D(2024, 2, 29), D(2024, 2, 29)), (D(2024, 3, 2), D(2024, 3, 1))])
def test_missing_days_of_a_window(sets, start, end):
    assert {tuple(r) for r in missing_days(sets, ("id",), start, end).collect()} == plain(ROWS, start, end)


def test_a_stretch_without_any_day(spark):
    ends = [("a", D(1875, 1, 1)), ("a", D(2065, 1, 1))]
    found = missing_days(day_sets(spark.createDataFrame(ends, "id string, period date"), ("id",)), ("id",))
    assert found.count() == found.distinct().count() == (ends[1][1] - ends[0][1]).days - 1


def test_sets_merge(spark, sets):
    more = day_sets(spark.createDataFrame([("old", D(1895, 3, 2)), ("whole", D(2024, 3, 1))], "id string, period date"), ("id",))
    both = merged(sets.unionByName(more), ("id",))
    assert {tuple(r) for r in missing_days(both, ("id",)).collect()} == plain([*ROWS, ("old", D(1895, 3, 2))])
    assert [r.days for r in day_counts(merged(both, ()), ()).collect()] == [11]


def test_empty(sets):
    assert day_counts(sets.where("false"), ("id",)).count() == missing_days(sets.where("false"), ()).count() == 0
