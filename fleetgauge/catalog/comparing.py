"""Joins, group sums, windows, set comparisons and numbering."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetgauge import fixtures
from fleetgauge.catalog.base import TABLES, mean_sql, query, share_sql
from fleetgauge.contracts import FACILITY, GENERATOR, NATIONAL, GrainSpec
from fleetgauge.functions.dates import observed_calendar
from fleetgauge.operators import adjacency, compare, paging, runs, summary
from fleetgauge.plans import dashboard, findings

_STATUS = "case when a is null or b is null then 'missing' when a = b then 'match' else 'mismatch' end"


def comparison_sql(left: str, right: str, keys: list[str], name: str, measures: tuple[str, ...] = ("capacity", "outage")) -> str:
    """One row per group and measure over a full outer join of sums."""
    on = " and ".join(f"l.{k} = r.{k}" for k in keys)
    key = ", ".join(f"coalesce(l.{k}, r.{k}) {k}" for k in keys)
    plain = ", ".join(keys)
    sums = ", ".join(f"sum({m}) {m}" for m in measures)
    values = ", ".join(f"l.{m} a_{m}, r.{m} b_{m}" for m in measures)
    joined = (
        f"select {key}, {values} from (select {plain}, {sums} from {left} group by {plain}) l "
        f"full join (select {plain}, {sums} from {right} group by {plain}) r on {on}"
    )
    parts = [
        f"select '{name}' comparison, {plain}, '{m}' measure, a_{m} a, b_{m} b from ({joined}) j_{m}" for m in measures
    ]
    return (
        f"select comparison, {plain}, measure, a as left_value, b as right_value, a - b as difference, {_STATUS} as status "
        f"from ({' union all '.join(parts)}) u_{name}"
    )


@query("j01_reconcile_generator_facility",
       f"{TABLES} {comparison_sql('generator_outages', 'facility_outages', ['period', 'facility'], 'generator_sum_to_facility')}")
def _(spark, folder):
    t = fixtures.outages(spark, folder)
    return compare.reconcile(t["generator"], t["facility"], ["period", "facility"], "generator_sum_to_facility")


_LINES = ("(select l_orderkey as order_key, cast(l_extendedprice as decimal(24,6)) as price from lineitem)",
          "(select o_orderkey as order_key, cast(o_totalprice as decimal(24,6)) as price from orders)")


@query("j01_reconcile_orders_lines", comparison_sql(f"{_LINES[0]} ll", f"{_LINES[1]} oo", ["order_key"], "lines_to_orders", ("price",)))
def _(spark, folder):
    money = lambda c: F.col(c).cast("decimal(24,6)").alias("price")
    lines = fixtures.table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("order_key"), money("l_extendedprice"))
    orders = fixtures.table(spark, folder, "orders").select(F.col("o_orderkey").alias("order_key"), money("o_totalprice"))
    return compare.reconcile(lines, orders, ["order_key"], "lines_to_orders", ("price",))


@query("j02_missing_counterparts",
       f"""{TABLES} select period, facility, 'facility' as missing_in from (select period, facility from generator_outages except select period, facility from facility_outages) a
       union all select period, facility, 'generator' from (select period, facility from facility_outages except select period, facility from generator_outages) b""")
def _(spark, folder):
    t = fixtures.outages(spark, folder)
    return compare.one_sided(t["generator"], t["facility"], ["period", "facility"], ("generator", "facility"))


_POINTS = f"""select d.period, capacity, outage, "percentOutage", {share_sql('outage', 'capacity')} as offline_share_percent,
  case when n.period is null then 'not_reported' when capacity = 0 then 'zero_capacity' end as reason
  from days d left join national_outages n on d.period = n.period"""


@query("j03_calendar_points", f"{TABLES} {_POINTS}")
def _(spark, folder):
    t = fixtures.outages(spark, folder)
    return dashboard.build_points(t["national"], observed_calendar(t["generator"]))


_PAIRS = """pairs as (select coalesce(a.facility, b.facility) facility, coalesce(a.period, cast(b.period + 1 as date)) period,
    a.facility is not null is_now, b.facility is not null was, b.capacity previous_value, a.capacity as value
  from facility_outages a full join facility_outages b on a.facility = b.facility and a.period = b.period + 1)"""


@query("j04_consecutive_days",
       f"""{TABLES}, {_PAIRS} select period, cast(period - 1 as date) as previous_period, facility,
       case when is_now and not was then 'added' when was and not is_now then 'removed' else 'changed' end as change,
       previous_value, value from pairs where is_now <> was or previous_value <> value""")
def _(spark, folder):
    pairs = adjacency.day_pairs(fixtures.facility_outages(spark, folder), FACILITY)
    changed = pairs.filter(adjacency.member_changed() | adjacency.value_changed())
    return changed.select(
        "period", F.date_sub("period", 1).alias("previous_period"), "facility",
        F.coalesce(adjacency.member_change(), F.lit("changed")).alias("change"), "previous_value", "value",
    )


_SNAPSHOT = """changes as (select coalesce(a.facility, b.facility) facility, coalesce(b."facilityName", a."facilityName") "facilityName",
    a.capacity before_value, b.capacity after_value
  from (select * from facility_outages where period = (select min(period) from facility_outages)) a
  full join (select * from facility_outages where period = (select max(period) from facility_outages)) b on a.facility = b.facility)"""
_CHANGE = """case when before_value is null then 'added' when after_value is null then 'removed'
  when after_value > before_value then 'increased' when after_value < before_value then 'decreased' else 'unchanged' end"""


def _snapshot(spark, folder):
    table = fixtures.facility_outages(spark, folder)
    return compare.snapshot_change(
        table, FACILITY, table.agg(F.min("period")).scalar(), table.agg(F.max("period")).scalar()
    )


@query("j05_snapshot_change",
       f"""{TABLES}, {_SNAPSHOT} select facility, "facilityName", before_value, after_value, after_value - before_value as difference, {_CHANGE} as change from changes""")
def _(spark, folder):
    return _snapshot(spark, folder)


@query("j06_row_agreement",
       f"""{TABLES}, kids as (select period, facility, count(*) n, max(capacity) c, max(outage) o, max("percentOutage") p from generator_outages group by all),
       j as (select coalesce(f.facility, k.facility) facility, f.period fp, coalesce(n, 0) n,
         f.period is not null and n = 1 and f.capacity = c and f.outage = o and f."percentOutage" is not distinct from p same
         from facility_outages f full join kids k on f.period = k.period and f.facility = k.facility),
       g as (select facility, count(fp) parent_rows, cast(sum(n) as bigint) child_rows, count(*) filter (where same) matching_rows from j group by facility)
       select facility, parent_rows, child_rows, matching_rows, parent_rows = child_rows and parent_rows = matching_rows as agrees from g""")
def _(spark, folder):
    t = fixtures.outages(spark, folder)
    return compare.row_agreement(t["facility"], t["generator"], FACILITY, ("capacity", "outage", "percentOutage"))


_PREVIOUS = f"""points as ({_POINTS}) select a.period, a.offline_share_percent, a.reason, b.offline_share_percent as previous_offline_share_percent,
  case when b.period is null then 'not_reported' else b.reason end as previous_reason,
  a.offline_share_percent - b.offline_share_percent as change_points
  from points a left join points b on b.period = a.period - 1"""


def _previous(spark, folder):
    t = fixtures.outages(spark, folder)
    return dashboard.previous_day_line(dashboard.build_points(t["national"], observed_calendar(t["generator"])))


@query("j07_previous_day", f"{TABLES}, {_PREVIOUS}")
def _(spark, folder):
    return _previous(spark, folder)


@query("f07_change_in_points", f"{TABLES}, q as (with {_PREVIOUS}) select period, change_points, previous_reason from q")
def _(spark, folder):
    return _previous(spark, folder).select("period", "change_points", "previous_reason")


# --- group sums and summaries -----------------------------------------------------------------


@query("e05_sums_at_coarser_grain",
       f"{TABLES} select period, facility, sum(capacity) as capacity, sum(outage) as outage from generator_outages group by period, facility")
def _(spark, folder):
    return summary.group_sums(fixtures.generator_outages(spark, folder), ["period", "facility"])


@query("e06_duplicate_keys",
       """select cast(sum(n) as bigint) as checked_count, cast(sum(n - 1) as bigint) as failed_count
       from (select count(*) n from lineitem group by l_orderkey, l_linenumber) k""")
def _(spark, folder):
    return summary.surplus_rows(fixtures.table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("e07_coverage",
       f"""{TABLES} {' union all '.join(f'''select '{g}' as grain, count(*) as rows, count(distinct ({k})) as unique_keys, count(distinct period) as days,
       min(period) as first_day, max(period) as last_day from {g}_outages''' for g, k in (('national', 'period'), ('facility', 'period, facility'), ('generator', 'period, facility, generator')))}""")
def _(spark, folder):
    t = fixtures.outages(spark, folder)
    parts = [summary.coverage(t[s.name], s).select(F.lit(s.name).alias("grain"), "*") for s in (NATIONAL, FACILITY, GENERATOR)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("e08_change_summary",
       f"""{TABLES}, {_SNAPSHOT}, c as (select *, {_CHANGE} as change from changes)
       select {', '.join(f"count(*) filter (where change = '{k}') as {k}" for k in ('increased', 'decreased', 'unchanged', 'added', 'removed'))},
       sum(before_value) as total_before, sum(after_value) as total_after from c""")
def _(spark, folder):
    return compare.change_summary(_snapshot(spark, folder))


_WEIGHTED = f"""select period, facility, count(*) as units, sum(capacity) as capacity, sum(outage) as outage,
  {share_sql('sum(outage)', 'sum(capacity)')} as weighted_percent, case when sum(capacity) = 0 then 'zero_capacity' end as ratio_reason,
  case when count(*) = count("percentOutage") then {mean_sql('sum("percentOutage")', 'count(*)')} end as mean_percent
  from generator_outages group by period, facility"""


@query("e09_weighted_percent", f"{TABLES} {_WEIGHTED}")
def _(spark, folder):
    return summary.weighted_percent(fixtures.generator_outages(spark, folder), ["period", "facility"])


@query("e10_owners_of_an_id",
       f"{TABLES} select generator, count(distinct facility) as owners from generator_outages group by generator")
def _(spark, folder):
    return summary.reuse(fixtures.generator_outages(spark, folder), ["generator"], "facility")


@query("e11_present_every_day",
       """with u as (select distinct user_id, cast(ts as date) as day from events)
       select user_id, count(*) as days from u group by user_id having count(*) = (select count(distinct day) from u)""")
def _(spark, folder):
    events = fixtures.table(spark, folder, "events").select("user_id", F.to_date("ts").alias("day"))
    return summary.present_every_day(events, GrainSpec("events", ("day", "user_id"), measures=()))


@query("e12_largest_difference",
       f"""{TABLES}, c as ({comparison_sql('generator_outages', 'facility_outages', ['period', 'facility'], 'x')})
       select count(*) as comparisons, count(*) filter (where status <> 'match') as nonmatching, max(abs(difference)) as max_absolute_difference from c""")
def _(spark, folder):
    t = fixtures.outages(spark, folder)
    return findings.reconciliation_summary(compare.reconcile(t["generator"], t["facility"], ["period", "facility"], "x"))


@query("e13_facility_total_vs_national",
       f"""{TABLES}, f as (select period, count(*) facilities, sum(outage) facility_total from facility_outages group by period)
       select coalesce(f.period, n.period) as period, facilities, facility_total, outage as national_outage, facility_total - outage as difference
       from f full join national_outages n on f.period = n.period""")
def _(spark, folder):
    t = fixtures.outages(spark, folder)
    return dashboard.contribution_totals(t["facility"], t["national"])


# --- windows ------------------------------------------------------------------------------------


@query("f01_latest_label",
       f"""{TABLES} select facility, "facilityName" from (select facility, "facilityName", row_number() over (partition by facility
       order by ("facilityName" is null) asc, period desc, "facilityName" asc nulls last) r from generator_outages) x where r = 1""")
def _(spark, folder):
    return paging.latest_labels(fixtures.generator_outages(spark, folder), GENERATOR)


_RUNS = """runs as (select facility, count(*) n, min(period) s, max(period) e from
    (select facility, period, period - cast(row_number() over (partition by facility order by period) as int) g
     from (select distinct facility, period from facility_outages where {condition}) x) y group by facility, g),
  longest as (select facility, n as run_days, s as run_start, e as run_end from
    (select *, row_number() over (partition by facility order by n desc, s asc) r from runs) z where r = 1)"""
_BUSY = _RUNS.format(condition="outage > 1")
_FULL = _RUNS.format(condition="""capacity > 0 and capacity = outage and "percentOutage" = 100""")


@query("f02_longest_run", f"{TABLES}, {_BUSY} select * from longest")
def _(spark, folder):
    return runs.longest_runs(fixtures.facility_outages(spark, folder), FACILITY, F.col("outage") > 1)


@query("f02_longest_full_outage", f"{TABLES}, {_FULL} select * from longest")
def _(spark, folder):
    return runs.longest_runs(fixtures.facility_outages(spark, folder), FACILITY, runs.fully_out())


@query("f03_first_and_last",
       f"""{TABLES} select facility, min(period) as first_day, max(period) as last_day, arg_min(capacity, period) as first_capacity,
       arg_max(capacity, period) as last_capacity, arg_min(outage, period) as first_outage, arg_max(outage, period) as last_outage,
       count(*) as records from facility_outages group by facility""")
def _(spark, folder):
    return summary.first_and_last(fixtures.facility_outages(spark, folder), FACILITY)


@query("f06_capacity_change",
       f"""{TABLES} select period, cast(period - 1 as date) as previous_period, facility, generator, previous_value, capacity as value, capacity - previous_value as difference
       from (select *, lag(capacity) over w previous_value, lag(period) over w p from generator_outages window w as (partition by facility, generator order by period)) x
       where p = period - 1 and previous_value <> capacity""")
def _(spark, folder):
    return adjacency.value_changes(adjacency.day_pairs(fixtures.generator_outages(spark, folder), GENERATOR), GENERATOR)


_BARS = f"""bars as (select period, facility, "facilityName", outage, coalesce({share_sql('outage', 'm')}, 0) as bar_percent
  from (select *, max(outage) over (partition by period) m from facility_outages) x)"""


@query("f08_ranked_contributions",
       f"""{TABLES}, {_BARS} select *, row_number() over (partition by period order by outage desc, facility asc) as position from bars""")
def _(spark, folder):
    return dashboard.ranked_contributions(fixtures.facility_outages(spark, folder))


@query("f09_trailing_series",
       f"""{TABLES}, last as (select max(period) p from facility_outages),
       slots as (select facility, cast(p - cast(n as int) as date) period from (select distinct facility from facility_outages, last where period > p - 8) f, last, range(8) r(n))
       select s.period, s.facility, outage from slots s left join facility_outages f on s.period = f.period and s.facility = f.facility""")
def _(spark, folder):
    table = fixtures.facility_outages(spark, folder)
    return dashboard.trailing_series(table, FACILITY, table.agg(F.max("period")).scalar())


# --- set comparisons ---------------------------------------------------------------------------


@query("h01_date_defects",
       f"""{TABLES} select coalesce(d.period, n.period) as period, case when n.period is null then 'missing' when d.period is null then 'extra' end as defect
       from days d full join national_outages n on d.period = n.period where n.period is null or d.period is null""")
def _(spark, folder):
    t = fixtures.outages(spark, folder)
    return compare.date_defects(t["national"], observed_calendar(t["generator"])).filter("defect is not null").drop("rows")


@query("h02_entity_set_changes",
       f"""{TABLES}, {_PAIRS} select period, cast(period - 1 as date) as previous_period, facility, case when is_now then 'added' else 'removed' end as change
       from pairs where is_now <> was""")
def _(spark, folder):
    pairs = adjacency.day_pairs(fixtures.facility_outages(spark, folder), FACILITY)
    return adjacency.membership_changes(pairs, FACILITY)


@query("h02_observed_day_changes",
       f"""{TABLES}, o as (select period, lead(period) over (order by period) nxt
         from (select distinct period from national_outages where period in (select period from facility_outages)) x),
       a as (select period as before, nxt as after, 'removed' as change, facility from o join facility_outages using (period)
         where nxt is not null and (nxt, facility) not in (select (period, facility) from facility_outages)),
       b as (select o.period as before, o.nxt as after, 'added' as change, f.facility from o join facility_outages f on f.period = o.nxt
         where (o.period, f.facility) not in (select (period, facility) from facility_outages))
       select * from a union all select * from b""")
def _(spark, folder):
    t = fixtures.outages(spark, folder)
    reported = t["facility"].join(t["national"].select("period"), "period", "left_semi")
    return findings.observed_day_pairs(reported, FACILITY)


@query("h03_distinct_generators", f"{TABLES} select distinct facility, generator from generator_outages where facility = '7'")
def _(spark, folder):
    return paging.generator_choices(fixtures.generator_outages(spark, folder), "7")


@query("h04_multiset_difference",
       """with l as (select l_suppkey as id, l_returnflag as flag, l_linestatus as status, count(*) n from lineitem where l_linestatus = 'F' group by all),
       r as (select l_suppkey as id, l_returnflag as flag, l_linestatus as status, count(*) n from lineitem where l_returnflag = 'A' group by all)
       select coalesce(l.id, r.id) as id, coalesce(l.flag, r.flag) as flag, coalesce(l.status, r.status) as status,
       coalesce(l.n, 0) as left_copies, coalesce(r.n, 0) as right_copies
       from l full join r on l.id = r.id and l.flag = r.flag and l.status = r.status where coalesce(l.n, 0) <> coalesce(r.n, 0)""")
def _(spark, folder):
    lines = fixtures.table(spark, folder, "lineitem")
    row = [F.col("l_suppkey").alias("id"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")]
    finished = lines.filter(F.col("l_linestatus") == "F").select(*row)
    return compare.multiset_difference(finished, lines.filter(F.col("l_returnflag") == "A").select(*row))


@query("h05_stacked_families",
       f"""{TABLES} {comparison_sql('facility_outages', 'national_outages', ['period'], 'facility_sum_to_national')}
       union all {comparison_sql('generator_outages', 'national_outages', ['period'], 'generator_sum_to_national')}""")
def _(spark, folder):
    t = fixtures.outages(spark, folder)
    return compare.stacked(
        [compare.reconcile(t[n], t["national"], ["period"], f"{n}_sum_to_national") for n in ("facility", "generator")], ["period"]
    )
