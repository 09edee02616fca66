"""Required checks, diagnostics and the gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetgauge import fixtures
from fleetgauge.catalog.base import CLEAN, DISAGREES_SQL, TABLES, query
from fleetgauge.catalog.ingest import land_all, routes_for, window_of
from fleetgauge.contracts import (
    DIAGNOSTIC_MESSAGES,
    DIAGNOSTIC_PAIRS,
    DIAGNOSTIC_SCOPES,
    GRAINS,
    REQUIRED_PAIRS,
    REQUIRED_SCOPES,
    severity,
)
from fleetgauge.functions.dates import observed_calendar
from fleetgauge.functions.digests import SLICE, WIDE
from fleetgauge.operators import adjacency
from fleetgauge.operators.summary import one_row
from fleetgauge.plans import checks, details, diagnostics, gate, refresh
from fleetgauge.plans.outcomes import union
from fleetgauge.session import scratch, settle

COLUMNS = ("check_code", "dataset_key", "required", "severity", "status", "checked_count", "failed_count")


def row_sql(code: str, scope: str, checked: str, failed: str, source: str) -> str:
    return (
        f"select '{code}' as check_code, '{scope}' as dataset_key, {str(code in REQUIRED_SCOPES).lower()} as required, "
        f"'{severity(code)}' as severity, case when ({failed}) > 0 then 'fail' else 'pass' end as status, "
        f"cast({checked} as bigint) as checked_count, cast({failed} as bigint) as failed_count from {source}"
    )


def _v03_sql():
    return [
        row_sql("V03", g, "coalesce(sum(n), 0)", "coalesce(sum(n - 1), 0)",
                f"(select count(*) n from {g}_outages group by {', '.join(spec.keys)}) k_{g}")
        for g, spec in GRAINS.items()
    ]


def _v04_sql():
    parts = []
    for g in GRAINS:
        extra = " or c <> 1" if g == "national" else ""
        parts.append(
            f"select count(*) filter (where d.period is null or x.period is null{extra}) defects from days d "
            f"full join (select period, count(*) c from {g}_outages group by period) x on d.period = x.period"
        )
    return [row_sql("V04", "all", "count(*)", "count(*) filter (where defects > 0)", f"({' union all '.join(parts)}) d4")]


_SUMS = "(select {k}, sum(capacity) c, sum(outage) o from {g}_outages group by {k})"


def _joined(left, right, keys):
    on = " and ".join(f"l.{k} = r.{k}" for k in keys)
    k = ", ".join(keys)
    return (
        f"(select l.{keys[0]} lk, r.{keys[0]} rk, coalesce(l.c = r.c, false) same_c, coalesce(l.o = r.o, false) same_o "
        f"from {_SUMS.format(k=k, g=left)} l full join {_SUMS.format(k=k, g=right)} r on {on})"
    )


_BAD = "count(*) filter (where not same_c) + count(*) filter (where not same_o)"


def _v05_sql():
    return [row_sql("V05", "all", "count(*)", "count(*) filter (where lk is null or rk is null)", f"{_joined('generator', 'facility', ['period', 'facility'])} j5")]


def _v06_sql():
    return [row_sql("V06", "all", "2 * count(*)", _BAD, f"{_joined('generator', 'facility', ['period', 'facility'])} j6")]


def _v07_sql():
    both = f"(select * from {_joined('facility', 'national', ['period'])} a union all select * from {_joined('generator', 'national', ['period'])} b)"
    return [row_sql("V07", "all", "2 * count(*)", _BAD, f"{both} j7")]


CONDITIONS = {
    "D01": '"facilityName" is null',
    "D02": '"percentOutage" is null',
    "D03": "outage < 0",
    "D04": "outage > capacity",
    "D05": '"percentOutage" < 0 or "percentOutage" > 100',
    "D06": DISAGREES_SQL,
}


def _row_diagnostic_sql(code):
    return [
        row_sql(code, g, "count(*)", f"count(*) filter (where {CONDITIONS[code]})", f"{g}_outages") for g in DIAGNOSTIC_SCOPES[code]
    ]


def _pairs_sql(g):
    spec = GRAINS[g]
    on = " and ".join(["a.period = b.period + 1", *[f"a.{k} = b.{k}" for k in spec.entity]])
    return (
        f"(select a.period ap, b.period bp, a.capacity ac, b.capacity bc from {g}_outages a full join {g}_outages b on {on} "
        f"where coalesce(a.period, b.period + 1) > (select min(period) from days) and coalesce(a.period, b.period + 1) <= (select max(period) from days))"
    )


def _change_sql(code):
    rows = []
    for g in DIAGNOSTIC_SCOPES[code]:
        both = "ap is not null and bp is not null"
        if code == "D07":
            rows.append(row_sql(code, g, "count(*)", "count(*) filter (where ap is null or bp is null)", f"{_pairs_sql(g)} p_{g}"))
        else:
            rows.append(row_sql(code, g, f"count(*) filter (where {both})", f"count(*) filter (where {both} and ac <> bc)", f"{_pairs_sql(g)} p_{g}"))
    return rows


def _all(rows):
    return " union all ".join(rows)


def _tables(spark, folder, clean=False):
    tables = fixtures.outages(spark, folder, clean)
    return tables, observed_calendar(tables["generator"])


@query("v03_unique_keys", f"{TABLES} {_all(_v03_sql())}")
def _(spark, folder):
    tables, _ = _tables(spark, folder)
    return union([checks.unique_keys(checks.profile(tables[n], s), s) for n, s in GRAINS.items()]).select(*COLUMNS)


@query("v04_date_coverage", f"{TABLES} {_all(_v04_sql())}")
def _(spark, folder):
    tables, window = _tables(spark, folder)
    return checks.date_coverage(tables, window).select(*COLUMNS)


@query("v05_facility_coverage", f"{TABLES} {_all(_v05_sql())}")
def _(spark, folder):
    tables, _ = _tables(spark, folder)
    return checks.cross_grain(tables["generator"], tables["facility"]).filter("check_code = 'V05'").select(*COLUMNS)


@query("v06_facility_reconciliation", f"{TABLES} {_all(_v06_sql())}")
def _(spark, folder):
    tables, _ = _tables(spark, folder)
    return checks.cross_grain(tables["generator"], tables["facility"]).filter("check_code = 'V06'").select(*COLUMNS)


@query("v07_national_reconciliation", f"{TABLES} {_all(_v07_sql())}")
def _(spark, folder):
    tables, _ = _tables(spark, folder)
    return checks.national_reconciliation(tables["national"], tables["facility"], tables["generator"]).select(*COLUMNS)


@query("v03_v07_clean_tables", f"{CLEAN} {_all(_v03_sql() + _v04_sql() + _v05_sql() + _v06_sql() + _v07_sql())}")
def _(spark, folder):
    tables, window = _tables(spark, folder, clean=True)
    return union(checks.table_checks(tables, window)).select(*COLUMNS)


def _row_query(code):
    def run(spark, folder):
        tables, _ = _tables(spark, folder)
        return union([diagnostics.row_diagnostics(tables[g], GRAINS[g], (code,)) for g in DIAGNOSTIC_SCOPES[code]]).select(*COLUMNS)

    return run


_NAMES = {
    "D01": "missing_label", "D02": "missing_percent", "D03": "negative_outage", "D04": "outage_above_capacity",
    "D05": "percent_out_of_range", "D06": "percent_disagrees",
}
for _code, _name in _NAMES.items():
    query(f"{_code.lower()}_{_name}", f"{TABLES} {_all(_row_diagnostic_sql(_code))}")(_row_query(_code))


@query("d06_affected_rows", f"{TABLES} select period, facility, generator, capacity, outage, \"percentOutage\" from generator_outages where {DISAGREES_SQL}")
def _(spark, folder):
    return diagnostics.affected_rows(fixtures.generator_outages(spark, folder), GRAINS["generator"], "D06")


@query("d06_not_applicable",
       f"""{TABLES} select case when "percentOutage" is null and capacity = 0 then 'missing_source_percentage,zero_capacity'
       when "percentOutage" is null then 'missing_source_percentage' when capacity = 0 then 'zero_capacity' else '' end as reasons, count(*) as rows
       from generator_outages group by 1""")
def _(spark, folder):
    reasons = F.concat_ws(",", diagnostics.not_applicable()).alias("reasons")
    return fixtures.generator_outages(spark, folder).groupBy(reasons).agg(F.count(F.lit(1)).alias("rows"))


def _change_query(code):
    def run(spark, folder):
        tables, _ = _tables(spark, folder)
        start, end = window_of(spark, folder)
        parts = [diagnostics.change_diagnostics(tables[g], GRAINS[g], start, end, (code,)) for g in DIAGNOSTIC_SCOPES[code]]
        return union(parts).select(*COLUMNS)

    return run


query("d07_membership_changes", f"{TABLES} {_all(_change_sql('D07'))}")(_change_query("D07"))
query("d08_capacity_changes", f"{TABLES} {_all(_change_sql('D08'))}")(_change_query("D08"))


@query("d07_affected_rows",
       f"""{TABLES}, p as (select coalesce(a.facility, b.facility) facility, coalesce(a.generator, b.generator) generator,
         coalesce(a.period, cast(b.period + 1 as date)) period, a.period is not null now, b.period is not null was
         from generator_outages a full join generator_outages b on a.facility = b.facility and a.generator = b.generator and a.period = b.period + 1)
       select period, cast(period - 1 as date) as previous_period, facility, generator, case when now then 'added' else 'removed' end as change from p
       where now <> was and period > (select min(period) from days) and period <= (select max(period) from days)""")
def _(spark, folder):
    spec = GRAINS["generator"]
    start, end = window_of(spark, folder)
    pairs = adjacency.day_pairs(fixtures.generator_outages(spark, folder), spec, "capacity", start, end)
    return adjacency.membership_changes(pairs, spec)


# --- gate over the results of these tables -----------------------------------------------------

_TABLE_CHECKS = _v03_sql() + _v04_sql() + _v05_sql() + _v06_sql() + _v07_sql()
_DIAGNOSTICS = [row for code in _NAMES for row in _row_diagnostic_sql(code)] + _change_sql("D07") + _change_sql("D08")
_RESULTS = f"results as ({_all(_TABLE_CHECKS + _DIAGNOSTICS)})"


def table_results(spark, folder, clean=False, width=SLICE):
    """Every check and diagnostic that needs the tables alone, as one lazy union."""
    tables, window = _tables(spark, folder, clean)
    start, end = window_of(spark, folder)
    parts = checks.table_checks(tables, window)
    parts += [diagnostics.row_diagnostics(tables[n], s, width=width) for n, s in GRAINS.items()]
    parts += [diagnostics.change_diagnostics(tables[n], s, start, end, width=width) for n, s in GRAINS.items()]
    return union(parts)


@query("q01_required_gate",
       f"""{TABLES}, {_RESULTS}, r as (select unnest({[f'{c}/{s}' for c, s in REQUIRED_PAIRS]}) pair)
       select count(*) as pairs, count(*) filter (where coalesce(status, '') <> 'pass') as blocking, count(*) filter (where coalesce(status, '') <> 'pass') = 0 as passed
       from r left join results on pair = check_code || '/' || dataset_key""")
def _(spark, folder):
    return gate.required_pass(table_results(spark, folder))


@query("q02_diagnostics_complete",
       f"""{TABLES}, {_RESULTS}, r as (select unnest({[f'{c}/{s}' for c, s in DIAGNOSTIC_PAIRS]}) pair)
       select count(*) as pairs, count(*) filter (where status is null) as open, count(*) filter (where status is null) = 0 as complete
       from r left join results on pair = check_code || '/' || dataset_key""")
def _(spark, folder):
    return gate.diagnostics_complete(table_results(spark, folder))


_MESSAGE_SQL = "case check_code {} end".format(" ".join(f"when '{c}' then '{m}'" for c, m in DIAGNOSTIC_MESSAGES.items()))


@query("e14_diagnostic_summaries",
       f"{TABLES}, {_RESULTS} select check_code as code, dataset_key, severity, failed_count as affected_count, {_MESSAGE_SQL} as message from results where not required")
def _(spark, folder):
    return gate.warning_summaries(table_results(spark, folder)).drop("details_hash")


@query("q04_warning_count",
       f"""{TABLES}, {_RESULTS} select count(*) filter (where severity = 'warning' and failed_count > 0) as warning_count,
       count(*) filter (where severity = 'warning' and failed_count > 0) > 0 as approval_required from results where not required""")
def _(spark, folder):
    counted = gate.warning_summaries(table_results(spark, folder)).agg(gate.warning_count().alias("warning_count"))
    return counted.withColumn("approval_required", F.col("warning_count") > 0)


def change_source_sql(g):
    """Pairs of days with both values, and the condition that a pair lies in the window."""
    spec = GRAINS[g]
    on = " and ".join(["a.period = b.period + 1", *[f"a.{k} = b.{k}" for k in spec.entity]])
    ids = "".join(f"coalesce(a.{k}, b.{k}) {k}, " for k in spec.entity)
    source = (
        f"(select cast(coalesce(a.period, b.period + 1) as date) period, {ids} b.capacity previous_value, a.capacity as value, a.period ap, b.period bp "
        f"from {g}_outages a full join {g}_outages b on {on}) p"
    )
    return source, "period > (select min(period) from days) and period <= (select max(period) from days)"


def details_sql(code, g, width=SLICE):
    """Number and digest of a diagnostic's affected rows, as the plan defines it."""
    spec = GRAINS[g]
    if code in ("D07", "D08"):
        source, inside = change_source_sql(g)
        condition = f"{inside} and " + ("(ap is null or bp is null)" if code == "D07" else "value <> previous_value")
        columns = [*spec.keys, "previous_value", "value"]
    else:
        source, condition, columns = f"{g}_outages", CONDITIONS[code], [*spec.keys, *spec.measures, '"percentOutage"']
    text = "concat_ws('|', {})".format(", ".join(f"coalesce(cast({c} as varchar), '-')" for c in columns))
    sums = ", ".join(f"cast(coalesce(sum(('0x' || substr(h, {1 + width * i}, {width}))::hugeint), 0) as varchar)" for i in range(4))
    return f"select '{code}' c, '{g}' g, count(*) n, sha256(concat_ws(':', cast(count(*) as varchar), {sums})) d from (select sha256({text}) h from {source} where {condition}) x"


_DETAILS = " union all ".join(details_sql(code, g, WIDE) for code in [*_NAMES, "D07", "D08"] for g in DIAGNOSTIC_SCOPES[code])


@query("q03_warning_digest",
       f"""{TABLES}, {_RESULTS}, details as ({_DETAILS}), summaries as (select *, {_MESSAGE_SQL} m from results join details on check_code = c and dataset_key = g)
       select count(*) filter (where severity = 'warning' and failed_count > 0) as warning_count, sha256('warnings-v1' || chr(10) || '[' || string_agg(
         concat('{{"code":"', c, '","dataset_key":"', g, '","severity":"', severity, '","affected_count":', failed_count, ',"message":"', m,
           '","details_hash":"', d, '"}}'), ',' order by c, g) || ']') as warning_digest from summaries""")
def _(spark, folder):
    return gate.warning_identity(table_results(spark, folder, width=WIDE))


@query("l05_quality_notes",
       f"""{TABLES}, {_RESULTS} select check_code as code, severity, dataset_key as scope, {_MESSAGE_SQL} as message, cast(failed_count as varchar) as affected_count
       from results where not required and failed_count > 0 and dataset_key = 'facility'""")
def _(spark, folder):
    return diagnostics.notes(table_results(spark, folder), "facility")


@query("q05_attempts_are_kept_apart",
       f"""{TABLES}, {_RESULTS} select attempt, count(*) as results, true as single from results, (values ('a1'), ('a2')) a(attempt) group by attempt""")
def _(spark, folder):
    from fleetgauge.sources import history

    path = scratch(spark, "history")
    results = settle(table_results(spark, folder), "results")
    for attempt in ("a1", "a2"):
        history.append_checks(results, path, "v1", attempt, "m")
    saved = history.attempts_of(spark, path, "v1")
    parts = []
    for attempt in ("a1", "a2"):
        own = saved.filter(F.col("attempt_id") == attempt)
        count = own.agg(F.count(F.lit(1)).alias("results"), F.lit(attempt).alias("attempt"))
        parts.append(one_row([count, gate.one_attempt(own)]))
    return union(parts)


def _refreshed(spark, folder):
    """Land clean tables, then write, check, gate, verify and publish one version."""
    tables = fixtures.outages(spark, folder, clean=True)
    attempts = land_all(spark, tables)
    start, end = window_of(spark, folder)
    routes = routes_for(spark, attempts, start, end)
    bounds = spark.range(1).select(start.alias("s"), end.alias("e")).first()
    root = scratch(spark, "store")
    window = refresh.Window(bounds["s"], bounds["e"])
    receipt = refresh.refresh(spark, root, "v1", "a1", 1, attempts, routes, window, fixtures.ROUTES, approved=True)
    return root, receipt


@query("q06_refreshed_and_verified",
       f"""{CLEAN}, {_RESULTS}, verdict as (select case when count(*) filter (where required and status <> 'pass') = 0 then 'passed' else 'failed' end v from results)
       select 'verdict' as check_code, case v when 'passed' then 'published' else 'not_eligible' end as dataset_key, v as status,
         cast(0 as bigint) as checked_count, cast(0 as bigint) as failed_count from verdict
       union all select check_code, dataset_key, status, checked_count, failed_count from results
       union all select code, g, case when code = 'D09' and (select count(*) from facility_outages) <> (select count(*) from generator_outages) then 'fail' else 'pass' end,
         cast(1 as bigint), case when code = 'D09' then cast((select count(*) from facility_outages) <> (select count(*) from generator_outages) as bigint) else 0 end
       from (values ('V01', 'national'), ('V01', 'facility'), ('V01', 'generator'), ('V02', 'national'), ('V02', 'facility'), ('V02', 'generator'),
         ('V08', 'national'), ('V08', 'facility'), ('V08', 'generator'), ('D09', 'facility')) x(code, g)""")
def _(spark, folder):
    from fleetgauge.sources import history

    root, receipt = _refreshed(spark, folder)
    results = history.attempts_of(spark, f"{root}/check_results", "v1").select("check_code", "dataset_key", "status", "checked_count", "failed_count")
    verdict = spark.range(1).select(
        F.lit("verdict").alias("check_code"), F.lit(receipt["published"]).alias("dataset_key"), F.lit(receipt["status"]).alias("status"),
        F.lit(0).cast("long").alias("checked_count"), F.lit(0).cast("long").alias("failed_count"),
    )
    return results.unionByName(verdict)


@query("q06_reverified_later",
       f"""{CLEAN}, details as ({" union all ".join(details_sql(code, g) for code in [*_NAMES, "D07", "D08"] for g in DIAGNOSTIC_SCOPES[code])})
       select c as check_code, g as dataset_key, n as failures, d as details_hash, true as verified from details""")
def _(spark, folder):
    """A refreshed version held against its receipt by another session, and the digests of its stored failures."""
    root, _ = _refreshed(spark, folder)
    later = spark.newSession()
    verified = not refresh.reverify(later, root, "v1").limit(1).count()
    stored = details.DetailStore(later, f"{root}/check_details", "v1", "a1").rows()
    found = details.digests(stored, [(c, s) for c, s in DIAGNOSTIC_PAIRS if c != "D09"])
    return found.withColumn("verified", F.lit(verified))
