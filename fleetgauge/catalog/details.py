"""Which rows failed: queries over the stored failures of all checks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgauge import fixtures
from fleetgauge.catalog.base import DISAGREES_SQL, TABLES, query
from fleetgauge.catalog.checks import CONDITIONS, change_source_sql, details_sql, row_sql
from fleetgauge.catalog.ingest import window_of
from fleetgauge.contracts import DIAGNOSTIC_SCOPES, GRAINS, severity
from fleetgauge.functions.dates import observed_calendar
from fleetgauge.functions.digests import fingerprint, row_digest
from fleetgauge.plans import details
from fleetgauge.plans.outcomes import union
from fleetgauge.session import scratch, settle
from fleetgauge.sources import digest_tree

# Per session and folder: the store's path, profiles, and the results of the jobs that have run.
_STORED: dict[tuple[str, str], tuple[str, dict[str, DataFrame], dict[tuple[str, ...], DataFrame]]] = {}
DOUBLED = "outage > capacity"  # rows that the second attempt sees twice


def stored(spark: SparkSession, folder: str, codes: Iterable[str]) -> tuple[details.DetailStore, DataFrame]:
    """The failures of the jobs that judge ``codes``, each job run once a session, and the results of these jobs."""
    known = (spark.sparkContext.applicationId, folder)
    path, profiles, results = _STORED.setdefault(known, (scratch(spark, "check-details"), {}, {}))
    store = details.DetailStore(spark, path, "v1", "a1")
    asked = [job for job in details.JOBS if not set(job).isdisjoint(codes)]
    new = [job for job in asked if job not in results]
    if new:
        tables = fixtures.outages(spark, folder)
        start, end = window_of(spark, folder)
        judged = [code for job in new for code in job]
        found = settle(details.check_tables(store, tables, observed_calendar(tables["generator"]), start, end, judged, profiles), "results")
        results.update({job: found.filter(F.col("check_code").isin(*job)) for job in new})
    return store, union([results[job] for job in asked])


def doubled(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: df.unionByName(df.filter(DOUBLED)) for name, df in fixtures.outages(spark, folder).items()}


def _ids(g: str) -> str:
    return ", ".join(f"cast({k if k in GRAINS[g].keys else 'null'} as varchar) {k}" for k in ("facility", "generator"))


def _rows_sql(code: str, g: str) -> str:
    values = f'period, {_ids(g)}, capacity, outage, "percentOutage"'
    found = f"select '{g}' dataset_key, 'affected' kind, {values}, cast(null as varchar) note from {g}_outages where {CONDITIONS[code]}"
    if code != "D06":
        return found
    reasons = """concat_ws(',', case when "percentOutage" is null then 'missing_source_percentage' end, case when capacity = 0 then 'zero_capacity' end)"""
    return f"""{found} union all select '{g}', 'not_applicable', {values}, {reasons} from {g}_outages where "percentOutage" is null or capacity = 0"""


def _changes_sql(code: str, g: str) -> str:
    source, inside = change_source_sql(g)
    kind, changed = {
        "D07": ("case when ap is not null then 'added' else 'removed' end", "(ap is null or bp is null)"),
        "D08": ("'changed'", "value <> previous_value"),
    }[code]
    return (
        f"select '{g}' dataset_key, {kind} kind, period, {_ids(g)}, cast(previous_value as decimal(34,6)) expected, "
        f"cast(value as decimal(34,6)) observed from {source} where {inside} and {changed}"
    )


def _details_query(code: str, columns: list[str]):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        store, _ = stored(spark, folder, [code])
        return store.rows(code).select(*columns)

    return run


_ROW = ["dataset_key", "kind", "period", "facility", "generator", "capacity", "outage", "percentOutage", "note"]
_CHANGE = ["dataset_key", "kind", "period", "facility", "generator", "expected", "observed"]
for _code in ("D01", "D02", "D03", "D04", "D05", "D06"):
    _sql = " union all ".join(_rows_sql(_code, g) for g in DIAGNOSTIC_SCOPES[_code])
    query(f"{_code.lower()}_details", f"{TABLES} {_sql}")(_details_query(_code, _ROW))
for _code in ("D07", "D08"):
    _sql = " union all ".join(_changes_sql(_code, g) for g in DIAGNOSTIC_SCOPES[_code])
    query(f"{_code.lower()}_details", f"{TABLES} {_sql}")(_details_query(_code, _CHANGE))


def _days_sql() -> str:
    parts = []
    for g in GRAINS:
        both = f"days d full join (select period p, count(*) c from {g}_outages group by 1) x on d.period = x.p"
        parts.append(f"select '{g}' dataset, case when p is null then 'missing' else 'extra' end kind, coalesce(d.period, p) period, c copies from {both} where p is null or d.period is null")
    parts.append("select 'national', 'repeated', period, count(*) from national_outages group by period having count(*) > 1")
    return " union all ".join(parts)


query("v04_details", f"{TABLES} {_days_sql()}")(_details_query("V04", ["dataset", "kind", "period", "copies"]))

_GROUPS = "(select period, facility, sum(capacity) c, sum(outage) o from {g}_outages group by all)"
_BOTH = f"{_GROUPS.format(g='facility')} f full join {_GROUPS.format(g='generator')} g using (period, facility)"
query(
    "v05_details",
    f"{TABLES} select case when g.c is null then 'missing_generator' else 'missing_facility' end kind, period, facility from {_BOTH} where f.c is null or g.c is null",
)(_details_query("V05", ["kind", "period", "facility"]))


def _sums_sql(kind: str, left: str, right: str, source: str, facility: str) -> str:
    rows = [
        f"select '{kind}' kind, period, {facility} facility, '{m}' measure, cast({left}.{m[0]} as decimal(34,6)) expected, cast({right}.{m[0]} as decimal(34,6)) observed from {source}"
        for m in ("capacity", "outage")
    ]
    return (
        f"select *, case when expected is null or observed is null then 'missing' else 'mismatch' end note from ({' union all '.join(rows)}) "
        "where expected is distinct from observed"
    )


_SUM = ["kind", "period", "facility", "measure", "expected", "observed", "note"]
query("v06_details", f"{TABLES} {_sums_sql('generator_to_facility', 'f', 'g', _BOTH, 'facility')}")(_details_query("V06", _SUM))
_DAY = "(select period, sum(capacity) c, sum(outage) o from {g}_outages group by all)"
query(
    "v07_details",
    TABLES + " " + " union all ".join(
        _sums_sql(f"{g}_to_national", "n", "x", f"{_DAY.format(g='national')} n full join {_DAY.format(g=g)} x using (period)", "cast(null as varchar)")
        for g in ("facility", "generator")
    ),
)(_details_query("V07", _SUM))


# --- a faulted attempt: some rows twice ----------------------------------------------

_TWICE = {g: f"(select * from {g}_outages union all select * from {g}_outages where {DOUBLED})" for g in GRAINS}


@query(
    "v03_details",
    TABLES + " " + " union all ".join(
        f"select '{g}' dataset_key, period, {_ids(g)}, count(*) copies from {_TWICE[g]} group by {', '.join(s.keys)} having count(*) > 1"
        for g, s in GRAINS.items()
    ),
)
def _(spark: SparkSession, folder: str) -> DataFrame:
    store = details.DetailStore(spark, scratch(spark, "check-details"), "v1", "a2")
    _judge_keys(store, folder)
    return store.rows("V03").select("dataset_key", "period", "facility", "generator", "copies")


def _judge_keys(store: details.DetailStore, folder: str, changes: bool = False) -> DataFrame:
    from fleetgauge.plans.checks import profile

    tables, rows = doubled(store.spark, folder), []
    start, end = window_of(store.spark, folder)
    for name, spec in GRAINS.items():
        rows += details.repeated_keys(store, tables[name], settle(profile(tables[name], spec), "profile"), spec)
        if changes:
            rows += details.change_failures(store, tables[name], spec, start, end)
    return details.as_results(store.spark, rows)


_SHOWN = ["check_code", "dataset_key", "required", "severity", "status", "checked_count", "failed_count"]


def _twice_sql() -> str:
    keys = [
        row_sql("V03", g, "coalesce(sum(n), 0)", "coalesce(sum(n - 1), 0)", f"(select count(*) n from {_TWICE[g]} group by {', '.join(s.keys)}) k_{g}")
        for g, s in GRAINS.items()
    ]
    # Capacity changes of a table with repeated keys are ambiguous: an error that counts nothing.
    ambiguous = [
        f"select 'D08', '{g}', false, '{severity('D08')}', case when again then 'error' else status end, case when again then 0 else checked_count end, "
        f"case when again then 0 else failed_count end from ({row_sql('D08', g, *_change_counts(g))}) r, "
        f"(select count(*) > 0 again from {g}_outages where {DOUBLED}) t"
        for g in DIAGNOSTIC_SCOPES["D08"]
    ]
    return " union all ".join([*keys, *ambiguous])


def _change_counts(g: str) -> tuple[str, str, str]:
    source, inside = change_source_sql(g)
    both = f"{inside} and ap is not null and bp is not null"
    return f"count(*) filter (where {both})", f"count(*) filter (where {both} and value <> previous_value)", source


@query("v03_d08_repeated_observations", f"{TABLES} {_twice_sql()}")
def _(spark: SparkSession, folder: str) -> DataFrame:
    store = details.DetailStore(spark, scratch(spark, "check-details"), "v1", "a2")
    return _judge_keys(store, folder, changes=True).filter("check_code <> 'D07'").select(*_SHOWN)


@query(
    "d06_eligible_rows",
    TABLES + " " + " union all ".join(
        f"""select '{g}' dataset_key, count(*) filter (where "percentOutage" is not null and capacity <> 0) eligible_count from {g}_outages""" for g in GRAINS
    ),
)
def _(spark: SparkSession, folder: str) -> DataFrame:
    store, results = stored(spark, folder, ["D06"])
    return details.eligible(store.rows("D06"), results)


_PAIRS = [(code, g) for code in ("D01", "D02", "D03", "D04", "D05", "D06", "D07", "D08") for g in DIAGNOSTIC_SCOPES[code]]


@query(
    "q03_digests_of_stored_failures",
    TABLES + " select c check_code, g dataset_key, n failures, d details_hash from ("
    + " union all ".join(details_sql(code, g) for code, g in _PAIRS) + ")",
)
def _(spark: SparkSession, folder: str) -> DataFrame:
    """Worked out again from the store alone, as a later session does."""
    store, _ = stored(spark, folder, [code for code, _ in _PAIRS])
    return details.digests(store.rows(), _PAIRS)


# --- digest trees -------------------------------------------------------------------

_PARTS = (
    "(select facility || '/' || substr(cast(period as varchar), 1, 7) storage_path, string_agg(concat_ws('|', period, c, o), ',' order by period) t "
    "from (select period, facility, sum(capacity) c, sum(outage) o from {g}_outages group by all) group by 1)"
)


@query(
    "a10_differing_parts",
    f"""{TABLES} select 'facility' dataset_key, storage_path, case when a.t is null then 'extra' when b.t is null then 'missing' else 'changed' end state
      from {_PARTS.format(g="generator")} a full join {_PARTS.format(g="facility")} b using (storage_path) where a.t is distinct from b.t""",
)
def _(spark: SparkSession, folder: str) -> DataFrame:
    """Months of facilities in which the generators' sums and the facility table differ, found from the root of two trees down."""
    tables = fixtures.outages(spark, folder)

    def parts(name: str) -> DataFrame:
        days = tables[name].groupBy("period", "facility").agg(*[F.sum(m).cast("decimal(34,6)").alias(m) for m in ("capacity", "outage")])
        named = days.select("period", F.concat("facility", F.lit("/"), F.date_format("period", "yyyy-MM")).alias("storage_path"), row_digest(days.columns).alias("_digest"))
        return named.groupBy("storage_path").agg(
            F.lit("facility").alias("dataset_key"), fingerprint(F.lit(True)).alias("sha256"), F.lit("day,facility,sums").alias("schema_fingerprint"),
            F.lit(0).cast("long").alias("byte_size"), F.count(F.lit(1)).alias("row_count"), F.min("period").alias("min_period"), F.max("period").alias("max_period"),
        )

    return digest_tree.differing_files(settle(parts("generator"), "parts"), settle(parts("facility"), "parts"))
