"""Day sets: coverage and missing days from bitmaps."""

from __future__ import annotations

from fleetgauge import fixtures
from fleetgauge.catalog.base import TABLES, query
from fleetgauge.operators.day_sets import day_counts, day_sets, merged, missing_days

_COUNTS = """count(distinct period) as days, min(period) as first_day, max(period) as last_day,
  date_diff('day', min(period), max(period)) + 1 - count(distinct period) as missing_days"""


@query("e07_day_counts_of_units", f"{TABLES} select facility, generator, {_COUNTS} from generator_outages group by all")
def _(spark, folder):
    unit = ("facility", "generator")
    return day_counts(day_sets(fixtures.generator_outages(spark, folder), unit), unit)


@query("e07_day_counts_merged_from_units", f"{TABLES} select facility, {_COUNTS} from generator_outages group by all")
def _(spark, folder):
    units = day_sets(fixtures.generator_outages(spark, folder), ("facility", "generator"))
    return day_counts(merged(units, ("facility",)), ("facility",))


@query("h01_missing_days_of_facilities",
       f"""{TABLES}, e as (select facility, min(period) a, max(period) b from facility_outages group by all)
       select facility, days.period from e join days on days.period between a and b
       anti join facility_outages o on o.facility = e.facility and o.period = days.period""")
def _(spark, folder):
    return missing_days(day_sets(fixtures.facility_outages(spark, folder), ("facility",)), ("facility",))


@query("h01_missing_days_of_the_nation",
       f"{TABLES}, e as (select min(period) a, max(period) b from national_outages)"
       " select days.period from days, e where days.period between a and b and days.period not in (select period from national_outages)")
def _(spark, folder):
    return missing_days(day_sets(fixtures.national_outages(spark, folder), ()), ())
