"""Pages, choices, dashboards and findings."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from fleetgauge import fixtures
from fleetgauge.catalog.base import TABLES, query, share_sql
from fleetgauge.catalog.comparing import _BARS, _FULL, _POINTS, _WEIGHTED, comparison_sql
from fleetgauge.catalog.ingest import _yearly_versions, land
from fleetgauge.contracts import FACILITY, GENERATOR, GRAINS
from fleetgauge.functions.dates import between, latest, observed_calendar, preset_start
from fleetgauge.functions.parsing import accepted, normalize
from fleetgauge.operators import paging
from fleetgauge.operators.numbering import number_rows
from fleetgauge.plans import dashboard, findings
from fleetgauge.plans.outcomes import union
from fleetgauge.session import scratch, settle
from fleetgauge.sources import pages

AFTER = (date(1996, 1, 15), "46", "1000")


@query("b12_rows_after_key", f"{TABLES} select * from generator_outages where (period, facility, generator) > (date '1996-01-15', '46', '1000')")
def _(spark, folder):
    return fixtures.generator_outages(spark, folder).filter(paging.after_key(GENERATOR.keys, AFTER))


@query("g04_keyset_page",
       f"""{TABLES} select * from (select * from generator_outages where period between date '1996-01-01' and date '1996-12-31'
       and (period, facility, generator) > (date '1996-01-15', '46', '1000') order by period, facility, generator limit 101) x""")
def _(spark, folder):
    chosen = paging.selected(fixtures.generator_outages(spark, folder), GENERATOR, date(1996, 1, 1), date(1996, 12, 31))
    return paging.lookahead(chosen, GENERATOR.keys, 100, AFTER)


PAGE = 100


@query("g05_page_walk",
       f"""{TABLES}, n as (select period, facility, (row_number() over (order by period, facility) - 1) // {PAGE} as page from facility_outages),
       p as (select page, count(*) as rows, min((period, facility)) as a, max((period, facility)) as b from n group by page)
       select page, rows, a[1] as first_period, a[2] as first_facility, b[1] as last_period, b[2] as last_facility,
       coalesce(lag(b) over (order by page) < a, true) as follows from p""")
def _(spark, folder):
    # Every page of a walk by keys, found at once: pages are cut by position, and a page follows the one before it.
    table = fixtures.facility_outages(spark, folder)
    keys = F.struct(*FACILITY.keys)
    numbered = number_rows(table.select(*FACILITY.keys), [F.col(k).asc_nulls_last() for k in FACILITY.keys], "position")
    pages = numbered.groupBy(F.floor((F.col("position") - 1) / PAGE).cast("long").alias("page")).agg(
        F.count(F.lit(1)).alias("rows"), F.min(keys).alias("a"), F.max(keys).alias("b")
    )
    before = pages.select((F.col("page") + 1).alias("page"), F.col("b").alias("before"))
    return pages.join(before, "page", "left").select(
        "page", "rows", F.col("a.period").alias("first_period"), F.col("a.facility").alias("first_facility"),
        F.col("b.period").alias("last_period"), F.col("b.facility").alias("last_facility"),
        F.coalesce(F.col("before") < F.col("a"), F.lit(True)).alias("follows"),
    )


@query("g06_facility_choices",
       f"""{TABLES} select facility, "facilityName" from (select facility, "facilityName", row_number() over (partition by facility
       order by ("facilityName" is null) asc, period desc, "facilityName" asc nulls last) r from facility_outages) x
       where r = 1 and facility > '3' and (contains(facility, '7') or contains(lower(coalesce("facilityName", '')), '7')) order by facility limit 51""")
def _(spark, folder):
    choices = paging.facility_choices(fixtures.facility_outages(spark, folder), FACILITY, "7")
    return paging.lookahead(choices, ("facility",), 50, ("3",))


@query("g06_generator_choices",
       f"{TABLES} select distinct facility, generator from generator_outages where facility = '7' and generator > '1' order by generator limit 51")
def _(spark, folder):
    return paging.lookahead(paging.generator_choices(fixtures.generator_outages(spark, folder), "7"), ("generator",), 50, ("1",))


@query("g07_top_contributors",
       f"""{TABLES} select period, facility, outage from facility_outages where period = (select max(period) from facility_outages)
       order by outage desc nulls last, facility limit 5""")
def _(spark, folder):
    table = fixtures.facility_outages(spark, folder)
    return dashboard.day_contributions(table, latest(table)).select("period", "facility", "outage").limit(5)


# --- dashboard ----------------------------------------------------------------------------------


def _range_sql(days):
    return f"""{TABLES}, newest as (select max(period) p from national_outages), points as ({_POINTS})
       select * from points where period between (select p from newest) - {days - 1} and (select p from newest)"""


def _preset(preset):
    def run(spark, folder):
        return dashboard.dashboard_preset(fixtures.national_outages(spark, folder), preset)

    return run


query("l01_dashboard_30d", _range_sql(30))(_preset("30d"))
query("l01_dashboard_90d", _range_sql(90))(_preset("90d"))
query("l01_dashboard_1y", _range_sql(365))(_preset("1y"))


@query("l01_day_cards",
       f"""{TABLES}, points as ({_POINTS}) select period, capacity, outage, offline_share_percent, reason,
       offline_share_percent < 0 or offline_share_percent > 100 as out_of_range, capacity - outage as remaining_capacity,
       cast(100 - offline_share_percent as decimal(38,2)) as remaining_percent from points""")
def _(spark, folder):
    tables = fixtures.outages(spark, folder)
    return dashboard.day_card(dashboard.build_points(tables["national"], observed_calendar(tables["generator"])))


@query("l02_metric", f"{TABLES}, points as ({_POINTS}) select period, offline_share_percent as value, reason from points where period = (select max(period) from national_outages)")
def _(spark, folder):
    national = fixtures.national_outages(spark, folder)
    return dashboard.metric(national, latest(national))


@query("l02_metric_equals_dashboard", f"{TABLES}, points as ({_POINTS}) select count(*) as days, 0 as differing from points")
def _(spark, folder):
    tables = fixtures.outages(spark, folder)
    days = observed_calendar(tables["generator"])
    points = dashboard.build_points(tables["national"], days)
    # A metric is the point of a one-day calendar; build every day's from its own row.
    metrics = days.join(points.select("period", F.col("offline_share_percent").alias("v"), F.col("reason").alias("r")), "period", "left")
    same = F.col("v").eqNullSafe(F.col("offline_share_percent")) & F.col("r").eqNullSafe(F.col("reason"))
    return points.join(metrics, "period").agg(F.count(F.lit(1)).alias("days"), F.count_if(~same).cast("int").alias("differing"))


@query("l03_freshness",
       f"""{TABLES} select 'v' || cast(extract(year from max(period)) as int) as version_id, (select max(period) from national_outages) as latest_observation_date,
       cast(max(period) as timestamp) as published_at from generator_outages""")
def _(spark, folder):
    _, log = _yearly_versions(spark, folder)
    return dashboard.freshness(fixtures.national_outages(spark, folder), log)


@query("l06_day_contributions",
       f"""{TABLES}, {_BARS} select * from bars where period = (select max(period) from facility_outages)""")
def _(spark, folder):
    table = fixtures.facility_outages(spark, folder)
    return dashboard.day_contributions(table, latest(table))


@query("l06_contribution_bars", f"{TABLES}, {_BARS} select * from bars")
def _(spark, folder):
    return dashboard.contribution_bars(fixtures.facility_outages(spark, folder))


# --- findings -----------------------------------------------------------------------------------

_STEP_DAYS = (date(2001, 10, 30), date(2001, 10, 31))
_STEP = f"""c as (select a.capacity b, z.capacity a from (select * from facility_outages where period = date '{_STEP_DAYS[0]}') a
    full join (select * from facility_outages where period = date '{_STEP_DAYS[1]}') z on a.facility = z.facility),
  n as (select max(capacity) filter (where period = date '{_STEP_DAYS[0]}') b, max(capacity) filter (where period = date '{_STEP_DAYS[1]}') a from national_outages)"""


@query("l07_capacity_step",
       f"""{TABLES}, {_STEP} select (select n.a is not null and n.b is not null from n) and sum(a) is not null and sum(b) is not null as available,
       (select n.b from n) as national_before, (select n.a from n) as national_after, (select n.a - n.b from n) as national_difference,
       sum(a) - sum(b) as facility_total_difference, count(b) as facilities_before, count(a) as facilities_after,
       count(*) filter (where a > b) as increased, count(*) filter (where a < b) as decreased, count(*) filter (where a = b) as unchanged,
       count(*) filter (where b is null) as added, count(*) filter (where a is null) as removed from c""")
def _(spark, folder):
    tables = fixtures.outages(spark, folder)
    return findings.capacity_step(tables["national"], tables["facility"], *_STEP_DAYS)


_HISTORIES = f"""{_FULL}, k as (select period, facility, count(*) n, max(capacity) c, max(outage) o, max("percentOutage") p from generator_outages group by all),
  j as (select coalesce(f.facility, k.facility) facility, f.period fp, coalesce(n, 0) n,
    f.period is not null and n = 1 and f.capacity = c and f.outage = o and f."percentOutage" is not distinct from p same
    from facility_outages f full join k on f.period = k.period and f.facility = k.facility),
  u as (select facility, count(fp) pr, sum(n) cr, count(*) filter (where same) mr from j group by facility),
  h as (select facility, count(*) as records, min(period) as first_day, max(period) as last_day, arg_min(capacity, period) as first_capacity,
    arg_min(outage, period) as first_outage, arg_max(capacity, period) as last_capacity, arg_max(outage, period) as last_outage,
    cast(max(period) - min(period) + 1 - count(distinct period) as bigint) as missing_days,
    count(*) filter (where capacity > 0 and capacity = outage and "percentOutage" = 100) as full_days from facility_outages group by facility),
  histories as (select h.*, coalesce(run_days, 0) as longest_full_days, run_start, run_end, mr as matching_rows, pr = cr and pr = mr as units_agree
    from h left join longest using (facility) left join u using (facility))"""


@query("l08_outage_histories", f"{TABLES}, {_HISTORIES} select * from histories")
def _(spark, folder):
    tables = fixtures.outages(spark, folder)
    return findings.outage_histories(tables["facility"], tables["generator"])


def _probes(spark, folder):
    """Landed responses for one day, one entity and the empty tails of both, at two grains."""
    tables = fixtures.outages(spark, folder)
    newest = latest(tables["generator"])
    total = tables["generator"].agg(F.count(F.lit(1))).scalar()
    results = []
    for name in ("facility", "generator"):
        spec, table = GRAINS[name], tables[name]
        day_rows = table.filter(F.col("period") == newest)
        entity_rows = table.filter(F.col("facility") == F.lit("46"))
        scoped = {"day": day_rows, "entity": entity_rows}
        typed, exported, about = [], [], []
        for kind, rows in scoped.items():
            # One page that holds every row, as a single saved response would.
            stated = tables["generator"].filter(
                F.col("period") == newest if kind == "day" else F.col("facility") == F.lit("46")
            ).agg(F.count(F.lit(1))).scalar()
            landed = land(spark, rows, spec, stated, page_rows=5000)
            typed.append(accepted(normalize(pages.page_rows(landed, spec), spec), spec).withColumn("probe", F.lit(kind)))
            exported.append(rows.withColumn("probe", F.lit(kind)))
            about.append(spark.range(1).select(F.lit(kind).alias("probe"), stated.alias("advertised_total"), F.lit(0).cast("long").alias("offset"), F.lit(False).alias("empty_tail")))
        for kind, rows, of in (("day_tail", day_rows, "day"), ("window_tail", table, None)):
            exported.append(rows.withColumn("probe", F.lit(kind)))
            stated = tables["generator"].filter(F.col("period") == newest).agg(F.count(F.lit(1))).scalar() if of else total
            about.append(
                rows.agg(F.count(F.lit(1)).alias("offset")).select(
                    F.lit(kind).alias("probe"), stated.alias("advertised_total"), "offset", F.lit(True).alias("empty_tail")
                )
            )
        found = findings.probe_counts(union(typed), union(exported), union(about), spec)
        results.append(found.select(F.lit(name).alias("dataset"), F.col("probe").alias("kind"), "advertised_total", "offset", "returned_rows", "exported_rows", "agrees"))
    return settle(union(results), "probes")


_PROBES = """probes as ({})""".format(
    " union all ".join(
        f"""select '{g}' dataset, '{kind}' kind, (select count(*) from generator_outages where {scope}) advertised_total,
        {'(select count(*) from ' + g + '_outages where ' + scope + ')' if tail else 'cast(0 as bigint)'} "offset",
        {'cast(0 as bigint)' if tail else '(select count(*) from ' + g + '_outages where ' + scope + ')'} returned_rows,
        (select count(*) from {g}_outages where {scope}) exported_rows, true agrees"""
        for g in ("facility", "generator")
        for kind, scope, tail in (
            ("day", "period = (select max(period) from generator_outages)", False), ("entity", "facility = '46'", False),
            ("day_tail", "period = (select max(period) from generator_outages)", True), ("window_tail", "true", True),
        )
    )
)


@query("l09_probe_counts", f"{TABLES}, {_PROBES} select * from probes")
def _(spark, folder):
    return _probes(spark, folder)


@query("l10_weighted_report",
       f"""{TABLES}, w as ({_WEIGHTED}) select w.*, f."percentOutage" as reported_percent from w join facility_outages f on w.period = f.period and w.facility = f.facility""")
def _(spark, folder):
    tables = fixtures.outages(spark, folder)
    return findings.weighted_report(tables["facility"], tables["generator"])


@query("l11_id_reuse", f"{TABLES} select period, generator, count(distinct facility) as owners from generator_outages group by period, generator")
def _(spark, folder):
    return findings.id_reuse(fixtures.generator_outages(spark, folder))


def _with_facility(sql):
    return f"select comparison, period, null::varchar as facility, measure, left_value, right_value, difference, status from ({sql}) n"


_REPORT = " union all ".join(
    [
        f"select comparison, period, facility, measure, left_value, right_value, difference, status from ({comparison_sql('generator_outages', 'facility_outages', ['period', 'facility'], 'generator_sum_to_facility')}) a",
        _with_facility(comparison_sql("facility_outages", "national_outages", ["period"], "facility_sum_to_national")),
        _with_facility(comparison_sql("generator_outages", "national_outages", ["period"], "generator_sum_to_national")),
    ]
)


@query("l12_reconciliation_report", f"{TABLES} {_REPORT}")
def _(spark, folder):
    tables = fixtures.outages(spark, folder)
    return findings.reconciliation_report(tables["national"], tables["facility"], tables["generator"])


@query("a14_report_files",
       f"""{TABLES}, r as ({_REPORT}) select count(*) as comparisons, count(*) filter (where status <> 'match') as nonmatching, max(abs(difference)) as max_absolute_difference from r""")
def _(spark, folder):
    tables = fixtures.outages(spark, folder)
    report = findings.reconciliation_report(tables["national"], tables["facility"], tables["generator"])
    path = scratch(spark, "report")
    findings.save_report(report, path)
    saved = spark.read.option("header", True).schema(report.schema).csv(f"{path}/reconciliation")
    return findings.reconciliation_summary(saved)


EXPECTED = {
    "step_difference": -83, "step_facilities": 23, "first_day": date(1995, 1, 2), "last_day": date(2001, 11, 4), "first_capacity": 10,
    "last_capacity": 10, "full_days": 30, "always_present": 0, "day_advertised": 25, "day_returned": 23, "entity_advertised": 600,
    "entity_returned": 580, "weighted_percent": 5, "mean_percent": 5, "owners": 1,
}
"""What the claims below are held against; a claim about the made-up tables may be false."""


@query("l12_claims",
       f"""{TABLES}, {_STEP}, {_PROBES}, r as ({_REPORT}) select 'at_least_30_days' as claim, (select count(*) from days) >= 30 as holds
       union all select 'daily_coverage_and_keys', (select count(*) from days) = (select count(*) from national_outages)
       union all select 'exact_reconciliation', (select count(*) from r where status <> 'match') = 0
       union all select 'step_in_capacity', (select coalesce(n.a - n.b = {EXPECTED['step_difference']}, false) from n) and (select coalesce(sum(a) - sum(b) = {EXPECTED['step_difference']}, false) from c)
       union all select 'step_same_facilities', (select count(a) = {EXPECTED['step_facilities']} and count(b) = {EXPECTED['step_facilities']} and count(*) = count(a) and count(*) = count(b) from c)
       union all select 'outage_first_and_last', (select coalesce(min(period) = date '{EXPECTED['first_day']}' and max(period) = date '{EXPECTED['last_day']}' and arg_min(capacity, period) = {EXPECTED['first_capacity']}
         and arg_max(capacity, period) = {EXPECTED['last_capacity']}, false) from facility_outages where facility = '46')
       union all select unnest(['outage_every_day', 'outage_units_agree', 'outage_only_addition', 'outage_entry_capacity']), false
       union all select 'probes_match_export', (select coalesce(bool_and(agrees), false) from probes)
       union all select 'probes_one_day', (select coalesce(bool_and(advertised_total = {EXPECTED['day_advertised']} and returned_rows = {EXPECTED['day_returned']}), false) from probes where kind = 'day' and dataset = 'facility')
       union all select 'probes_one_entity', (select coalesce(bool_and(advertised_total = {EXPECTED['entity_advertised']} and returned_rows = {EXPECTED['entity_returned']}), false) from probes where kind = 'entity' and dataset = 'facility')
       union all select 'probes_end_empty', true
       union all select 'weighted_example', (select coalesce({share_sql('sum(outage)', 'sum(capacity)')} = {EXPECTED['weighted_percent']} and count(*) = count("percentOutage")
         and sum("percentOutage") = {EXPECTED['mean_percent']} * count(*), false) from generator_outages where period = date '2001-10-31' and facility = '46')
       union all select 'id_reused', (select count(distinct facility) = {EXPECTED['owners']} from generator_outages where period = date '2001-10-31' and generator = '100')""")
def _(spark, folder):
    tables = fixtures.outages(spark, folder)
    return findings.finding_claims(
        tables, observed_calendar(tables["generator"]), _probes(spark, folder), facility="46", step=_STEP_DAYS,
        weighted=(date(2001, 10, 31), "46"), reused=(date(2001, 10, 31), "100"), expected=EXPECTED,
    )


@query("b14_default_preview",
       f"""{TABLES} select period, capacity, outage, "percentOutage" from national_outages where period between (select max(period) from national_outages) - 29
       and (select max(period) from national_outages) order by period limit 31""")
def _(spark, folder):
    national = fixtures.national_outages(spark, folder)
    newest = latest(national)
    return paging.lookahead(between(national, preset_start(newest, "30d"), newest), ("period",), 30)
