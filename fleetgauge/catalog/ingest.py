"""Sources, sinks, strict parsing and source checks.

Raw text is made from the given tables, so the SQL side is the source projection.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from fleetgauge import fixtures
from fleetgauge.catalog.base import CLEAN, TABLES, query
from fleetgauge.contracts import FACILITY, GENERATOR, GRAINS, NATIONAL
from fleetgauge.functions.exact import fixed_text
from fleetgauge.functions.parsing import (
    accepted,
    kept_text,
    normalize,
    parse_date,
    parse_decimal,
    parse_text,
    refused,
)
from fleetgauge.operators.compare import multiset_difference
from fleetgauge.operators.summary import one_row
from fleetgauge.plans import checks
from fleetgauge.plans.outcomes import union
from fleetgauge.session import scratch, settle, together
from fleetgauge.sources import exports, history, pages, parquet

PAGE_ROWS = 500
FILE_PAGES = 500  # pages a landed file: a compressed file is read by one task


def land(spark, df, spec, advertised=None, page_rows=PAGE_ROWS, path=None, sorted_files=False):
    """Write landed attempts as JSON, a folder for each dataset, and read them back as a source would be read."""
    path = path or scratch(spark, "landed")
    landed = fixtures.landed_attempts(df, spec, "v1", page_rows, advertised, sorted_files).drop("dataset")
    landed.write.option("maxRecordsPerFile", FILE_PAGES).json(f"{path}/dataset={spec.name}", compression="gzip")
    return pages.read_attempts(spark, path)


def land_all(spark, tables):
    """Land all three stored tables in one folder; the facility pages advertise the number of generator rows."""
    total, path = tables["generator"].agg(F.count(F.lit(1))).scalar(), scratch(spark, "landed")
    together([
        partial(land, spark, tables[name], spec, total if name == "facility" else None, path=path, sorted_files=True)
        for name, spec in GRAINS.items()
    ])
    return pages.read_attempts(spark, path)


def window_of(spark, folder):
    dates = fixtures.table(spark, folder, "lineitem").select(F.to_date("l_shipdate").alias("p"))
    return dates.agg(F.min("p")).scalar(), dates.agg(F.max("p")).scalar()


def routes_for(spark, attempts, start, end):
    return settle(union([fixtures.landed_route(attempts, spec, "v1", start, end) for spec in GRAINS.values()]), "routes")


def stored(spark, df, spec):
    path = scratch(spark, spec.table)
    parquet.write_sorted(df, spec, path)
    return path


# --- sources and sinks ------------------------------------------------------------------


@query("a01_scan_declared_schema", f"{TABLES} select * from generator_outages")
def _(spark, folder):
    return parquet.scan(spark, GENERATOR, stored(spark, fixtures.generator_outages(spark, folder), GENERATOR))


_AS_TEXT = """select cast(period as varchar) period, facility, generator, "facilityName", cast(capacity as varchar) capacity,
  cast(outage as varchar) outage, cast("percentOutage" as varchar) "percentOutage" from generator_outages"""


@query("a02_landed_page_rows", f"{TABLES} {_AS_TEXT}")
def _(spark, folder):
    attempts = land(spark, fixtures.generator_outages(spark, folder), GENERATOR, sorted_files=True)
    return pages.page_rows(attempts, GENERATOR).select(*GENERATOR.schema.names)


FAULTY_PAGE = 50
# What happens to page p: cut short, emptied, replaced, given an error, changed after it was sealed; every sixth stays.
_BROKEN = {1: "unreadable_body", 2: "unreadable_body", 3: "unreadable_body", 4: "error_member", 5: "response_checksum"}


def broken_pages(attempts):
    """Landed attempts with five of six bodies damaged, each in its own way."""
    page, body = F.floor(F.col("offset") / FAULTY_PAGE) % 6, F.col("sanitized_response")
    damaged = (
        F.when(page == 1, F.substring(body, 1, 40)).when(page == 2, F.lit('{"response":{}}')).when(page == 3, F.lit("no page"))
        .when(page == 4, F.regexp_replace(body, r"^\{", '{"error":{"code":1},'))
    )
    changed = attempts.withColumn("sanitized_response", F.when(body.isNotNull(), F.coalesce(damaged, body)))
    sealed = changed.withColumn("response_sha256", F.sha2("sanitized_response", 256))
    late = F.when(page == 5, F.concat("sanitized_response", F.lit(" "))).otherwise(F.col("sanitized_response"))
    return sealed.withColumn("sanitized_response", late)


@query("a02_refused_bodies",
       f"""{TABLES}, n as (select row_number() over (order by period) - 1 i from national_outages),
       pages as (select i // {FAULTY_PAGE} p, count(*) n from n group by 1),
       codes as (values {', '.join(f"({p}, '{code}')" for p, code in _BROKEN.items())}),
       last as (select (select count(*) from n) // {FAULTY_PAGE} p where (select count(*) from n) % {FAULTY_PAGE} = 0
         union all select (select count(*) from n) // {FAULTY_PAGE} where (select count(*) from n) % {FAULTY_PAGE} <> 0),
       every as (select p, true has_rows from pages union all select p, false from last)
       select c.col1 as error_code, 'sanitized_response' as error_field, count(*) as rows from every join codes c on c.col0 = p % 6 group by 1
       union all select null, null, cast(sum(n) as bigint) from pages where p % 6 = 0""")
def _(spark, folder):
    landed = land(spark, fixtures.national_outages(spark, folder), NATIONAL, page_rows=FAULTY_PAGE, sorted_files=True)
    log = broken_pages(landed).unionByName(landed.withColumn("version_id", F.lit("v2")))
    typed = normalize(pages.page_rows(pages.of_version(log, "v1"), NATIONAL), NATIONAL)
    return typed.groupBy("error_code", "error_field").agg(F.count(F.lit(1)).alias("rows"))


@query("a03_csv_export", f"""{TABLES} select period, facility, capacity, outage, "percentOutage", "facilityName" from facility_outages""")
def _(spark, folder):
    path, names = scratch(spark, "export"), FACILITY.schema.names
    fixtures.facility_outages(spark, folder).write.option("header", True).option("nullValue", "").csv(path)
    return exports.load_export(spark, path, FACILITY, names).withColumn("facilityName", kept_text(F.col("facilityName")))


# Number text by line number: places beyond the sixth are refused as written, even zeros and by exponent.
_NUMBERS = {1: ".0000000000001", 2: ".0000000", 3: ".000000", 4: "e-7", 5: "0e-7", 6: "e2", 7: ".25e-4"}


@query("a03_refused_numbers",
       """select l_linenumber, case when l_linenumber in (1, 2, 4, 5) then 'invalid_number' end as refused, count(*) as rows,
       sum(case l_linenumber when 3 then l_quantity::int::decimal(24,6) when 6 then (l_quantity::int * 100)::decimal(24,6)
         when 7 then l_quantity::int * 0.0001::decimal(24,6) + 0.000025::decimal(24,6) end)::decimal(34,6) as capacity
       from lineitem where l_linenumber <= 7 group by l_linenumber""")
def _(spark, folder):
    lines = fixtures.table(spark, folder, "lineitem").filter("l_linenumber <= 7")
    suffix = F.element_at(F.create_map(*[F.lit(x) for pair in _NUMBERS.items() for x in pair]), F.col("l_linenumber").cast("int"))
    export = lines.select(
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("period"), F.col("l_linenumber").cast("string").alias("facility"),
        F.concat(F.col("l_quantity").cast("int"), suffix).alias("capacity"), F.lit("0").alias("outage"), F.lit("").alias("percentOutage"),
    )
    checked = exports.check_export(export, FACILITY)
    return checked.groupBy(F.col("facility").cast(lines.schema["l_linenumber"].dataType).alias("l_linenumber"), "refused").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("capacity").alias("capacity")
    ).withColumn("capacity", F.when(F.col("refused").isNull(), F.col("capacity")))


@query("a04_verified_inputs",
       f"""{TABLES} select * from (values ('00001', 'changed'), ('00002', 'missing'), ('00003', 'repeated_role')) t(role, problem)
       where (select count(*) from facility_outages) > 0""")
def _(spark, folder):
    # Four files: one as registered, one changed since, one gone, one registered twice.
    path = scratch(spark, "inputs")
    fixtures.facility_outages(spark, folder).repartition(4).write.option("header", True).csv(path)
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    role = F.regexp_extract(name, r"part-([0-9]+)", 1)
    files = settle(found.select(name.alias("file"), role.alias("role"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")), "registry")
    registry = files.withColumns({
        "sha256": F.when(F.col("role") == "00001", F.sha2("sha256", 256)).otherwise(F.col("sha256")),
        "file": F.when(F.col("role") == "00002", F.concat(F.lit("gone-"), "file")).otherwise(F.col("file")),
    }).withColumn("copy", F.explode(F.when(F.col("role") == "00003", F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    return exports.verify_inputs(spark, path, registry.drop("copy")).select("role", "problem")


@query("a05_sorted_files",
       f"""{TABLES} select count(*) as rows, min(period) as first_day, max(period) as last_day, 0 as out_of_order from generator_outages""")
def _(spark, folder):
    path = stored(spark, fixtures.generator_outages(spark, folder), GENERATOR)
    table = parquet.scan(spark, GENERATOR, path)
    return table.agg(
        F.count(F.lit(1)).alias("rows"), F.min("period").alias("first_day"), F.max("period").alias("last_day"),
    ).withColumn("out_of_order", parquet.overlapping_files(table, GENERATOR).scalar().cast("int"))


@query("a06_version_is_not_reused", f"{TABLES} select count(*) as rows, true as second_write_refused from national_outages")
def _(spark, folder):
    root = scratch(spark, "versions")
    table = fixtures.national_outages(spark, folder)
    path = parquet.freeze_version(table, NATIONAL, root, "v1")
    try:
        parquet.freeze_version(table, NATIONAL, root, "v1")
        again = False
    except Exception as error:
        again = "PATH_ALREADY_EXISTS" in str(error)
    return parquet.scan(spark, NATIONAL, path).agg(F.count(F.lit(1)).alias("rows"), F.lit(again).alias("second_write_refused"))


@query("a07_readback_difference", f"{TABLES} select count(*) as rows, 0 as differing from facility_outages")
def _(spark, folder):
    table = fixtures.facility_outages(spark, folder)
    path = stored(spark, table, FACILITY)
    differing = parquet.readback_difference(spark, FACILITY, path, table).agg(F.count(F.lit(1))).scalar()
    return parquet.scan(spark, FACILITY, path).agg(F.count(F.lit(1)).alias("rows")).withColumn("differing", differing.cast("int"))


_MEASURED = " union all ".join(
    f"""select '{g}' as dataset_key, cast(count(*) as bigint) as row_count, min(period) as min_period, max(period) as max_period, 0 as required_nulls from {g}_outages"""
    for g in GRAINS
)


def _measured(spark, folder, root):
    parts = []
    for name, df in fixtures.outages(spark, folder).items():
        parquet.write_sorted(df, GRAINS[name], parquet.version_path(root, GRAINS[name], "v1"))
        parts.append(parquet.measure_version(spark, GRAINS[name], root, "v1"))
    return union(parts)


@query("a08_measured_files", f"{TABLES} {_MEASURED}")
def _(spark, folder):
    measured = _measured(spark, folder, scratch(spark, "versions"))
    return measured.groupBy("dataset_key").agg(
        F.sum("row_count").alias("row_count"), F.min("min_period").alias("min_period"), F.max("max_period").alias("max_period"),
        F.sum("required_nulls").cast("int").alias("required_nulls"),
    )


@query("a09_frozen_manifest", f"{TABLES} select count(*) filter (where n = 0) as faults, 64 as digest_length from (select count(*) n from generator_outages) x")
def _(spark, folder):
    measured = settle(_measured(spark, folder, scratch(spark, "versions")), "measured")
    start, end = window_of(spark, folder)
    bounds = spark.range(1).select(start.alias("s"), end.alias("e")).first()
    faults = parquet.manifest_faults(measured, bounds["s"], bounds["e"]).agg(F.count(F.lit(1)).alias("faults"))
    digest = parquet.manifest_digest(measured).select(F.length("manifest_sha256").alias("digest_length"))
    return one_row([faults, digest])


@query("a10_changed_files",
       f"{TABLES} select 'facility' as dataset_key, 'changed' as state from generator_outages having count(*) > 0 union all select 'national', 'missing'")
def _(spark, folder):
    measured = settle(_measured(spark, folder, scratch(spark, "versions")), "measured")
    # Against a version whose facility files changed and whose national files are gone.
    later = measured.filter(F.col("dataset_key") != "national").withColumn(
        "sha256", F.when(F.col("dataset_key") == "facility", F.reverse("sha256")).otherwise(F.col("sha256"))
    )
    return parquet.inspect(measured, later).select("dataset_key", "state").distinct()


def _yearly_versions(spark, folder):
    """One version per year of observations, each published by a later run than the last."""
    root = scratch(spark, "versions")
    year = F.year("period")
    rows = fixtures.generator_outages(spark, folder).withColumn("version_id", F.concat(F.lit("v"), year))
    rows.write.partitionBy("version_id").parquet(parquet.table_path(root, GENERATOR))
    versions = parquet.scan_versions(spark, GENERATOR, root)
    log = versions.groupBy("version_id").agg(F.min("period").alias("coverage_start"), F.max("period").alias("coverage_end"))
    log = log.select(
        F.sha2("version_id", 256).alias("event_id"), "version_id", F.year("coverage_end").cast("long").alias("run_seq"),
        "coverage_start", "coverage_end", F.col("coverage_end").alias("latest_observation_date"),
        F.col("coverage_end").cast("timestamp_ntz").alias("published_at"), F.lit("automatic").alias("mode"),
    )
    log.write.parquet(f"{root}/publication_log")
    return versions, history.read_log(spark, f"{root}/publication_log")


@query("a13_active_version_rows",
       f"{TABLES} select * from generator_outages where extract(year from period) = (select max(extract(year from period)) from generator_outages)")
def _(spark, folder):
    versions, log = _yearly_versions(spark, folder)
    return history.read_active(versions, log)


@query("a13_pinned_version_rows",
       f"{TABLES} select * from generator_outages where extract(year from period) = 1996 union all select * from generator_outages where false")
def _(spark, folder):
    versions, log = _yearly_versions(spark, folder)
    published = log.filter(F.col("version_id") != "v1997")
    return union([history.read_published(versions, published, v) for v in ("v1996", "v1997")])


@query("a12_publication_decisions",
       f"""{TABLES}, y as (select extract(year from period) y, min(period) s, max(period) e from generator_outages group by 1),
       l as (select max(y) m, arg_max(s, y) s, arg_max(e, y) e from y)
       select 'known' as candidate, 'already_published' as decision from l where m > 0 union all select 'older', 'superseded' union all select 'narrower', 'coverage_regression' union all select 'wider', 'publish'""")
def _(spark, folder):
    from datetime import timedelta

    _, log = _yearly_versions(spark, folder)
    active = history.active_event(log).first()
    day = timedelta(days=1)
    base = (active["coverage_start"], active["coverage_end"], active["latest_observation_date"])
    candidates = {
        "known": history.Candidate(active["version_id"], active["run_seq"] + 1, *base),
        "older": history.Candidate("x", active["run_seq"] - 1, *base),
        "narrower": history.Candidate("x", active["run_seq"] + 1, base[0] + day, base[1], base[2]),
        "wider": history.Candidate("x", active["run_seq"] + 1, base[0] - day, base[1] + day, base[2]),
    }
    rows = [(name, history.decide(log, c)) for name, c in candidates.items()]
    return spark.createDataFrame(rows, "candidate STRING, decision STRING")


@query("a15_fixed_text",
       f"""{TABLES} select strftime(period, '%Y-%m-%d') as period, facility, cast(capacity as varchar) as capacity, cast(outage as varchar) as outage,
       cast("percentOutage" as varchar) as "percentOutage" from facility_outages""")
def _(spark, folder):
    table = fixtures.facility_outages(spark, folder)
    return table.select(
        F.date_format("period", "yyyy-MM-dd").alias("period"), "facility", *[fixed_text(c).alias(c) for c in ("capacity", "outage", "percentOutage")]
    )


# --- strict parsing: texts with every kind of fault, made from lineitem ------------------------

_D = "cast(cast(l_shipdate as date) as string)"
_Q = "cast(cast(l_quantity as int) as string)"
RAW_COLUMNS = {
    "period": f"""case l_linenumber when 2 then concat(substr({_D}, 1, 5), cast(cast(substr({_D}, 6, 2) as int) as string), substr({_D}, 8))
        when 3 then concat({_D}, ' ') when 4 then concat(substr({_D}, 1, 4), '-02-', substr({_D}, 9)) when 5 then ''
        when 6 then concat('0000', substr({_D}, 5)) else {_D} end""",
    "facility": "case when l_tax = 0.07 then concat(' ', chr(160)) else concat(' ', cast(l_suppkey as string)) end",
    "generator": "case when l_tax = 0.06 then null else cast(l_partkey as string) end",
    "facilityName": "case l_returnflag when 'A' then concat('Unit ', l_linestatus, ' ') when 'R' then chr(9) else null end",
    "capacity": f"""case cast(l_discount as decimal(3,2)) when 0.01 then concat({_Q}, '.') when 0.02 then concat(' ', {_Q})
        when 0.03 then concat({_Q}, 'e1') when 0.04 then concat('-', {_Q}) when 0.05 then concat('.', {_Q})
        when 0.06 then concat({_Q}, '.1234567') when 0.07 then concat('+', {_Q}, '.1000000') when 0.08 then repeat({_Q}, 19)
        when 0.09 then concat(repeat('0', 30), {_Q}) when 0.10 then '' else {_Q} end""",
    "outage": f"case l_linenumber when 7 then 'NaN' else concat('-', {_Q}, '.5') end",
    "percentOutage": f"case when l_quantity < 5 then '  ' when l_quantity < 10 then '1,5' else {_Q} end",
    "capacity-units": "case when l_tax = 0.05 then 'kilowatts' else 'megawatts' end",
    "outage-units": "case when l_tax = 0.04 then null else 'megawatts' end",
    "percentOutage-units": "case when l_tax = 0.03 then 'fraction' else 'percent' end",
}
RAW_SQL = "raw as (select l_orderkey, l_linenumber, {} from lineitem)".format(
    ", ".join(f'{text} as "{name}"' for name, text in RAW_COLUMNS.items())
)


def raw_rows(spark, folder):
    lines = fixtures.table(spark, folder, "lineitem")
    return lines.select("l_orderkey", "l_linenumber", *[F.expr(text).alias(name) for name, text in RAW_COLUMNS.items()])


def _blank(c):
    return f"({c} is null or regexp_full_match({c}, '[\\s\\pZ]*'))"


def _bad_date(c):
    return (
        f"case when {_blank(c)} then 'required_text' when not regexp_full_match({c}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') "
        f"or {c} like '0000%' or try_cast({c} as date) is null then 'invalid_date' end"
    )


def _bad_decimal(c, capacity=False):
    digits = f"ltrim({c}, '+-')"
    negative = f" when try_cast({c} as decimal(24,6)) < 0 then 'negative_capacity'" if capacity else ""
    return (
        f"case when {_blank(c)} then 'required_text' when not regexp_full_match({c}, '[+-]?([0-9]+(\\.[0-9]+)?|\\.[0-9]+)') then 'invalid_decimal' "
        f"when length(ltrim(split_part({digits}, '.', 1), '0')) > 18 then 'decimal_overflow' "
        f"when length(rtrim(split_part({digits}, '.', 2), '0')) > 6 then 'decimal_scale'{negative} end"
    )


@query("c09_strict_date",
       f"""with {RAW_SQL} select l_orderkey, l_linenumber, case when e is null then cast(period as date) end as day, e as error_code
       from (select *, {_bad_date('period')} e from raw) x""")
def _(spark, folder):
    parsed = parse_date(F.col("period"))
    return raw_rows(spark, folder).select("l_orderkey", "l_linenumber", parsed.value.alias("day"), parsed.error.alias("error_code"))


@query("c10_strict_decimal",
       f"""with {RAW_SQL} select l_orderkey, l_linenumber, capacity as text, case when e is null then cast(capacity as decimal(24,6)) end as value, e as error_code
       from (select *, {_bad_decimal('capacity', True)} e from raw) x""")
def _(spark, folder):
    parsed = parse_decimal(F.col("capacity"), nonnegative=True)
    return raw_rows(spark, folder).select("l_orderkey", "l_linenumber", F.col("capacity").alias("text"), parsed.value.alias("value"), parsed.error.alias("error_code"))


@query("c11_required_text",
       f"""with {RAW_SQL} select l_orderkey, l_linenumber, case when not {_blank('facility')} then facility end as facility,
       case when {_blank('generator')} then 'required_text' end as generator_error from raw""")
def _(spark, folder):
    return raw_rows(spark, folder).select(
        "l_orderkey", "l_linenumber", parse_text(F.col("facility")).value.alias("facility"), parse_text(F.col("generator")).error.alias("generator_error")
    )


@query("c12_optional_text",
       f"""with {RAW_SQL} select l_orderkey, l_linenumber, case when not {_blank('"facilityName"')} then "facilityName" end as label from raw""")
def _(spark, folder):
    return raw_rows(spark, folder).select("l_orderkey", "l_linenumber", kept_text(F.col("facilityName")).alias("label"))


_STEPS = [
    ("period", _bad_date("period")),
    ("facility", f"case when {_blank('facility')} then 'required_text' end"),
    ("generator", f"case when {_blank('generator')} then 'required_text' end"),
    ("capacity-units", """case when "capacity-units" is distinct from 'megawatts' then 'invalid_units' end"""),
    ("capacity", _bad_decimal("capacity", True)),
    ("outage-units", """case when "outage-units" is distinct from 'megawatts' then 'invalid_units' end"""),
    ("outage", _bad_decimal("outage")),
    ("percentOutage-units", f"""case when not {_blank('"percentOutage"')} and "percentOutage-units" is distinct from 'percent' then 'invalid_units' end"""),
    ("percentOutage", f"""case when not {_blank('"percentOutage"')} then {_bad_decimal('"percentOutage"')} end"""),
]
_FIRST_FAULT = "coalesce({}) fault".format(", ".join(f"'{field}:' || ({code})" for field, code in _STEPS))


@query("c13_unit_quarantine",
       f"""with {RAW_SQL}, x as (select {_FIRST_FAULT} from raw)
       select split_part(fault, ':', 1) as error_field, count(*) as rows from x where fault like '%-units:%' group by 1""")
def _(spark, folder):
    bad = refused(normalize(raw_rows(spark, folder), GENERATOR))
    return bad.filter(F.col("error_code") == "invalid_units").groupBy("error_field").agg(F.count(F.lit(1)).alias("rows"))


@query("c14_normalized_rows",
       f"""with {RAW_SQL}, x as (select *, {_FIRST_FAULT} from raw)
       select l_orderkey, l_linenumber, case when fault is null then cast(capacity as decimal(24,6)) end as capacity,
       case when fault is null then cast(outage as decimal(24,6)) end as outage,
       case when fault is null and not {_blank('"percentOutage"')} then cast("percentOutage" as decimal(24,6)) end as "percentOutage",
       case when fault is null then cast(period as date) end as period, case when fault is null then facility end as facility,
       case when fault is null and not {_blank('"facilityName"')} then "facilityName" end as "facilityName",
       split_part(fault, ':', 2) as error_code, split_part(fault, ':', 1) as error_field from x""")
def _(spark, folder):
    typed = normalize(raw_rows(spark, folder), GENERATOR, ("l_orderkey", "l_linenumber"))
    good = F.col("error_code").isNull()
    names = ("capacity", "outage", "percentOutage", "period", "facility", "facilityName")
    return typed.select("l_orderkey", "l_linenumber", *[F.when(good, F.col(n)).alias(n) for n in names], "error_code", "error_field")


# --- source checks over landed pages -----------------------------------------------------------

_LOGS = "logs as ({})".format(
    " union all ".join(f"select '{g}' dataset, count(*) n, cast(ceil(count(*) / {PAGE_ROWS}.0) as bigint) pages from {g}_outages" for g in GRAINS)
)
_REQUESTS = f"""{_LOGS}, answered as (select dataset, n, unnest(range(pages + 1)) p from logs),
  requests as (select dataset, p + (p + 3) // 5 seq, least(p * {PAGE_ROWS}, n) expected_offset, case when p % 5 = 2 then 2 else 1 end expected_attempt from answered
    union all select dataset, p + (p + 3) // 5 - 1, least(p * {PAGE_ROWS}, n), 1 from answered where p % 5 = 2)"""


@query("f04_paging_progress",
       f"{TABLES}, {_REQUESTS} select dataset, seq, expected_offset as offset, expected_offset, cast(expected_attempt as bigint) as attempt_number, cast(expected_attempt as bigint) as expected_attempt from requests")
def _(spark, folder):
    return pages.paging_progress(land_all(spark, fixtures.outages(spark, folder))).drop("version_id")


@query("f05_attempt_times",
       f"""{TABLES}, {_REQUESTS} select dataset, seq, t as started_at, t + interval 1 second as completed_at,
       case when seq > 0 then t - interval 1 second end as previous_end, true as in_order from (select *, timestamp '2026-01-01 00:00:00' + to_seconds(seq * 2) t from requests) x""")
def _(spark, folder):
    return pages.attempt_times(land_all(spark, fixtures.outages(spark, folder))).drop("version_id")


@query("e15_route_counts",
       f"""{TABLES}, {_REQUESTS} select dataset, (select pages + 1 from logs l where l.dataset = r.dataset) as pages, (select n from logs l where l.dataset = r.dataset) as row_count,
       count(*) filter (where expected_attempt > 1) as retries from requests r group by dataset""")
def _(spark, folder):
    return pages.route_counts(land_all(spark, fixtures.outages(spark, folder))).drop("version_id")


def _source_facts(spark, folder):
    attempts = land_all(spark, fixtures.outages(spark, folder))
    start, end = window_of(spark, folder)
    routes = routes_for(spark, attempts, start, end)
    judged = together(partial(checks.source_complete, attempts, routes, s, start, end, fixtures.ROUTES[n]) for n, s in GRAINS.items())
    return dict(zip(GRAINS, judged))


@query("v01_source_complete",
       f"""{TABLES}, {_REQUESTS} select l.dataset as dataset_key, '' as reasons, n as row_count, pages + 1 as pages,
       (select count(*) from requests r where r.dataset = l.dataset and expected_attempt > 1) as retries,
       case when l.dataset = 'facility' then (select n from logs where dataset = 'generator') else n end as advertised_total, false as unreadable from logs l""")
def _(spark, folder):
    return union(list(_source_facts(spark, folder).values())).withColumn("reasons", F.concat_ws(",", "reasons"))


_CHECK_COLUMNS = ("check_code", "dataset_key", "required", "severity", "status", "checked_count", "failed_count")


@query("d09_advertised_total",
       f"""{TABLES} select 'D09' as check_code, 'facility' as dataset_key, false as required, 'info' as severity,
       case when a <> b then 'fail' else 'pass' end as status, cast(1 as bigint) as checked_count, cast(a <> b as bigint) as failed_count
       from (select (select count(*) from facility_outages) a, (select count(*) from generator_outages) b) x""")
def _(spark, folder):
    return checks.advertised_outcome(_source_facts(spark, folder)["facility"]).select(*_CHECK_COLUMNS)


@query("v02_schema_units",
       f"""{CLEAN} {' union all '.join(f"select 'V02' as check_code, '{g}' as dataset_key, true as required, 'required' as severity, 'pass' as status, cast(1 as bigint) as checked_count, cast(0 as bigint) as failed_count from {g}_outages having count(*) > 0" for g in GRAINS)}""")
def _(spark, folder):
    tables = fixtures.outages(spark, folder, clean=True)
    attempts = land_all(spark, tables)
    start, end = window_of(spark, folder)
    routes = routes_for(spark, attempts, start, end)
    return union([checks.schema_units(attempts, routes, tables[n], s) for n, s in GRAINS.items()]).select(*_CHECK_COLUMNS)


@query("h04_pages_equal_table", f"{TABLES} select count(*) as rows, 0 as differing from facility_outages")
def _(spark, folder):
    table = fixtures.facility_outages(spark, folder)
    parsed = accepted(normalize(pages.page_rows(land(spark, table, FACILITY, sorted_files=True), FACILITY), FACILITY), FACILITY)
    differing = multiset_difference(parsed, table).agg(F.count(F.lit(1))).scalar()
    return parsed.agg(F.count(F.lit(1)).alias("rows")).withColumn("differing", differing.cast("int"))
