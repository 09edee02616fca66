"""Take a clean version, spoil one thing, and exactly the matching check must fail."""

from copy import deepcopy
from datetime import date
from functools import reduce

import pytest
from pyspark.sql import functions as F

from fleetgauge import fixtures
from fleetgauge.contracts import DIAGNOSTIC_PAIRS, FACILITY, GRAINS, NATIONAL, REQUIRED_PAIRS
from fleetgauge.functions.dates import calendar
from fleetgauge.plans import checks, diagnostics, gate, refresh
from fleetgauge.plans.outcomes import evaluate, union
from fleetgauge.session import scratch, settle
from fleetgauge.sources import exports, history, pages, parquet
from rows import dec, frame, frames, observation, reconciled

START, END = date(2026, 10, 1), date(2026, 10, 3)


def table_status(spark, rows):
    t = frames(spark, rows)
    parts = checks.table_checks(t, calendar(spark, START, END))
    parts += [diagnostics.row_diagnostics(t[n], s) for n, s in GRAINS.items()]
    parts += [diagnostics.change_diagnostics(t[n], s, F.lit(START), F.lit(END)) for n, s in GRAINS.items()]
    return {(r["check_code"], r["dataset_key"]): r for r in union(parts).collect()}


def failing(results):
    return {k for k, r in results.items() if r["status"] != "pass"}


def spoil(change):
    rows = deepcopy(reconciled())
    change(rows)
    return rows


def _shift(rows):
    rows["generator"][0]["capacity"] += dec("0.000001")


def _drop_facility(rows):
    del rows["facility"][0]


def _repeat_national(rows):
    rows["national"].append(dict(rows["national"][0]))


def _no_labels(rows):
    for r in rows["facility"]:
        r["facilityName"] = None


def _negative(rows):
    for n in GRAINS:
        for r in rows[n]:
            r["outage"], r["percentOutage"] = -r["outage"], dec("-10")


@pytest.mark.parametrize(
    "change,expected",
    [
        (lambda rows: None, set()),
        (_shift, {("V06", "all"), ("V07", "all"), ("D08", "generator")}),
        (_drop_facility, {("V05", "all"), ("V06", "all"), ("V07", "all"), ("D07", "facility")}),
        (_repeat_national, {("V03", "national"), ("V04", "all"), ("V07", "all"), ("D08", "national")}),
        (_no_labels, {("D01", "facility")}),
        (_negative, {(c, n) for c in ("D03", "D05") for n in GRAINS}),
    ],
)
def test_one_defect(spark, change, expected):
    assert failing(table_status(spark, spoil(change))) == expected


def test_counts_of_checks(spark):
    results = table_status(spark, reconciled())
    counts = {k: r["checked_count"] for k, r in results.items()}
    assert counts[("V03", "generator")] == 12 and counts[("V04", "all")] == 3 and counts[("V05", "all")] == 6
    assert counts[("V06", "all")] == 12 and counts[("V07", "all")] == 12
    assert counts[("D07", "facility")] == 4 and counts[("D08", "national")] == 2


def test_capacity_change_repeated_observation_is_an_error(spark):
    def repeat(rows):
        rows["facility"].append(dict(rows["facility"][0]))

    assert table_status(spark, spoil(repeat))[("D08", "facility")]["status"] == "error"


def test_warnings_count_summaries_not_rows(spark):
    def blank(rows):
        for n in GRAINS:
            for r in rows[n]:
                r["percentOutage"] = None
                r["facilityName"] = None

    results = spark.createDataFrame(list(table_status(spark, spoil(blank)).values()))
    assert gate.warning_identity(results).first()["warning_count"] == 5


def land(spark, rows, size=5):
    """Landed attempts and routes of three small tables."""
    t = frames(spark, rows)
    attempts = reduce(
        lambda a, b: a.unionByName(b), [settle(fixtures.landed_attempts(t[n], s, "v1", size)) for n, s in GRAINS.items()]
    )
    routes = union([fixtures.landed_route(attempts, s, "v1", F.lit(START), F.lit(END)) for s in GRAINS.values()])
    return settle(attempts), settle(routes)


def reasons(spark, attempts, routes, spec=FACILITY):
    row = checks.source_complete(attempts, routes, spec, F.lit(START), F.lit(END), fixtures.ROUTES[spec.name]).first()
    return set(row["reasons"])


@pytest.fixture(scope="module")
def landed(spark):
    # Thirteen facilities a day: enough pages for one of them to be retried.
    rows = deepcopy(reconciled())
    extra = [observation(f"2026-10-0{d}", f"f{i}", None, None, "0", "0", None) for d in (1, 2, 3) for i in range(11)]
    rows["facility"] += extra
    rows["generator"] += [{**r, "generator": "1"} for r in extra]
    return land(spark, rows)


def test_complete_source(spark, landed):
    attempts, routes = landed
    assert attempts.filter("attempt_number = 2").count() > 0
    for spec in GRAINS.values():
        assert reasons(spark, attempts, routes, spec) == set()


def _where(seq):
    return (F.col("dataset") == "facility") & (F.col("seq") == seq)


@pytest.mark.parametrize(
    "column,value,seq,expected",
    [
        ("offset", 1, 1, {"request_progress"}),
        ("attempt_number", 3, 1, {"request_progress"}),
        ("requested_length", 5001, 1, {"request_progress"}),
        ("response_sha256", "x", 1, {"response_checksum"}),
        ("http_status", 404, 2, {"failed_request"}),
        ("actual_row_count", 4, 1, {"response_outcome", "route_counts"}),
        ("advertised_total", "1", 1, {"total_evidence"}),
        ("api_version", "0", 1, {"response_outcome"}),
    ],
)
def test_one_fault_in_the_log(spark, landed, column, value, seq, expected):
    attempts, routes = landed
    kind = attempts.schema[column].dataType
    spoiled = attempts.withColumn(column, F.when(_where(seq), F.lit(value).cast(kind)).otherwise(F.col(column)))
    found = reasons(spark, spoiled, routes)
    # The route summary keeps the counts of the true log.
    assert found - {"route_counts"} == expected - {"route_counts"}


def test_missing_last_page_and_reordered_log(spark, landed):
    attempts, routes = landed
    own = attempts.filter("dataset = 'facility'")
    last = own.agg(F.max("seq")).first()[0]
    assert "missing_exhaustion" in reasons(spark, own.filter(F.col("seq") != last), routes)
    assert "request_progress" in reasons(spark, own.filter(F.col("seq") != 1), routes)


def test_route_and_repeated_keys(spark, landed):
    attempts, routes = landed
    assert "route_not_complete" in reasons(spark, attempts, routes.withColumn("requested_end", F.date_add("requested_end", 1)))
    rows = deepcopy(reconciled())
    rows["facility"].append(dict(rows["facility"][0]))
    assert reasons(spark, *land(spark, rows)) == {"repeated_key"}


def test_source_rows_equal_saved_rows(spark):
    rows = reconciled()
    attempts, routes = land(spark, rows)
    saved = frame(spark, FACILITY, rows["facility"])
    status = lambda df: checks.schema_units(attempts, routes, df, FACILITY).first()["status"]
    assert status(saved) == "pass"
    assert status(saved.limit(5)) == "fail"
    assert status(saved.unionByName(saved.limit(1))) == "fail"
    bad = attempts.withColumn("sanitized_response", F.regexp_replace("sanitized_response", '"10.000000"', '"1e1"'))
    assert checks.schema_units(bad, routes, saved, FACILITY).first()["status"] == "error"


def test_a_job_that_cannot_finish_is_an_error_and_not_a_pass(spark):
    found = evaluate(spark, [("V05", "all"), ("V06", "all")], lambda: spark.read.parquet("/nowhere")).collect()
    assert [(r["check_code"], r["status"], r["checked_count"]) for r in found] == [("V05", "error", 0), ("V06", "error", 0)]


def test_gate_needs_every_pair_once(spark):
    rows = [(c, s, True, "required", "pass", 1, 0, None) for c, s in REQUIRED_PAIRS]
    rows += [(c, s, False, "info" if c in ("D07", "D08", "D09") else "warning", "pass", 1, 0, "0:0") for c, s in DIAGNOSTIC_PAIRS]
    from fleetgauge.contracts import CHECK_SCHEMA

    decide = lambda r: gate.decision(spark.createDataFrame(r, CHECK_SCHEMA)).first()
    good = decide(rows)
    assert (good["status"], good["warning_count"], good["approval_required"]) == ("passed", 0, False)
    assert decide(list(reversed(rows)))["warning_digest"] == good["warning_digest"]
    changed = [(*r[:4], "fail", 1, 1, "1:5") if r[0] == "D01" else r for r in rows]
    spoiled = decide(changed)
    assert (spoiled["status"], spoiled["warning_count"], spoiled["approval_required"]) == ("passed", 2, True)
    assert spoiled["warning_digest"] != good["warning_digest"]
    for bad in (rows[1:], rows + rows[:1], [(*rows[0][:5], 0, 0, None)] + rows[1:], rows[:-1], [(*r[:4], "error", 0, 0, None) if r[0] == "D06" else r for r in rows]):
        assert decide(bad)["status"] == "failed"


def test_refresh_publishes_and_notices_tampering(spark):
    attempts, routes = land(spark, reconciled())
    root = scratch(spark, "store")
    window = refresh.Window(START, END)
    args = (attempts, routes, window, fixtures.ROUTES)
    receipt = refresh.refresh(spark, root, "v1", "a1", 5, *args)
    assert receipt["status"] == "passed" and receipt["published"] == "published" and receipt["approval_required"] is False
    log = history.read_log(spark, f"{root}/publication_log")
    assert log.count() == 1 and history.active_event(log).first()["version_id"] == "v1"
    active = history.read_active(parquet.scan_versions(spark, NATIONAL, root), log)
    assert active.count() == 3
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        refresh.refresh(spark, root, "v1", "a2", 6, *args)
    saved = history.attempts_of(spark, f"{root}/check_results", "v1")
    assert saved.count() == 39
    assert refresh.verify(spark, root, "v1", saved, receipt) == []
    with pytest.raises(ValueError):
        history.append_checks(saved.select("check_code", "dataset_key", "required", "severity", "status", "checked_count", "failed_count", "details_hash"), f"{root}/check_results", "v1", "a1")
    # An extra file in the version has to be noticed.
    frame(spark, NATIONAL, reconciled()["national"]).write.mode("append").parquet(parquet.version_path(root, NATIONAL, "v1"))
    assert "files" in refresh.verify(spark, root, "v1", saved, receipt)
    # An older run never replaces the active version.
    candidate = history.Candidate("v0", 4, START, END, END)
    assert history.publish(spark, f"{root}/publication_log", candidate) == "superseded"
    assert history.publish(spark, f"{root}/publication_log", history.Candidate("v1", 9, START, END, END)) == "already_published"


def test_refresh_stops_at_a_refused_row(spark):
    attempts, routes = land(spark, reconciled())
    edited = F.regexp_replace("sanitized_response", '"10.000000"', '"1e1"')  # sealed again: the checksum is judged first
    bad = attempts.withColumn("sanitized_response", edited).withColumn("response_sha256", F.sha2("sanitized_response", 256))
    with pytest.raises(refresh.Refused, match="invalid_decimal"):
        refresh.write_version(spark, bad, scratch(spark, "store"), "v1", refresh.Window(START, END))


def test_written_files(spark):
    path = scratch(spark, "files")
    df = spark.range(120_000).select(
        F.date_add(F.lit(START), (F.col("id") % 7).cast("int")).alias("period"), F.lit(1).cast("decimal(24,6)").alias("capacity"),
        F.lit(1).cast("decimal(24,6)").alias("outage"), F.lit(None).cast("decimal(24,6)").alias("percentOutage"),
    )
    parquet.write_sorted(df, NATIONAL, path, partitions=1)
    import glob

    import pyarrow.parquet as pq

    file = pq.ParquetFile(sorted(glob.glob(f"{path}/*.parquet"))[0]).metadata
    assert [file.row_group(i).num_rows for i in range(file.num_row_groups)] == [50_000, 50_000, 20_000]
    assert file.row_group(0).column(0).compression == "SNAPPY"


CSV = "period,facility,facilityName,capacity,outage,percentOutage\n"


@pytest.mark.parametrize(
    "lines,problem",
    [
        ("2026-10-01,46,A,1.5,0,\n2026-10-02,46,A,1e2,0.000001,5\n", None), ("2026-10-01,46,A,1.5,0\n", "MALFORMED|malformed"), ("", "empty"),
        ("2026-10-01, ,A,1,0,\n", "empty_key"), ("2026-10-01,46,A,1,0,\n2026-10-01,46,A,1,0,\n", "duplicate"), ("20261001,46,A,1,0,\n", "noncanonical"),
        ("2026-10-01,46,A,NaN,0,\n", "invalid_number"), ("2026-10-01,46,A,1,0.0000001,\n", "invalid_number"), ("2026-10-01,46,A,-1,0,\n", "negative"),
        ("2026-10-01,46,A,1000000000000000000,0,\n", "invalid_number"),
    ],
)
def test_exports(spark, tmp_path, lines, problem):
    (tmp_path / "x.csv").write_text(CSV + lines)
    load = lambda: exports.load_export(spark, str(tmp_path / "x.csv"), FACILITY, CSV.strip().split(","))
    if problem:
        with pytest.raises(Exception, match=problem):
            load().collect()
    else:
        rows = load().orderBy("period").collect()
        assert [(r["capacity"], r["percentOutage"]) for r in rows] == [(dec("1.5"), None), (dec(100), dec(5))]


def test_registry_of_inputs(spark, tmp_path):
    import hashlib

    (tmp_path / "a.csv").write_bytes(b"a")
    (tmp_path / "b.csv").write_bytes(b"b")
    digest = lambda b: hashlib.sha256(b).hexdigest()
    make = lambda rows: spark.createDataFrame(rows, "file string, role string, bytes long, sha256 string")
    good = make([("a.csv", "us", 1, digest(b"a")), ("b.csv", "facility", 1, digest(b"b"))])
    assert exports.verify_inputs(spark, str(tmp_path), good).count() == 0
    bad = make([("a.csv", "us", 1, digest(b"x")), ("c.csv", "us", 1, digest(b"b"))])
    assert {r["problem"] for r in exports.verify_inputs(spark, str(tmp_path), bad).collect()} == {"changed", "missing", "repeated_role"}


def test_report_is_not_overwritten(spark):
    path = scratch(spark, "report")
    one = spark.range(1)
    history.write_report(one, one, path)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        history.write_report(one, one, path)


def test_units_are_column_metadata(spark):
    df = frame(spark, NATIONAL, reconciled()["national"])
    assert df.select("capacity").schema["capacity"].metadata == {"unit": "MW"}
    assert df.select((F.col("capacity") + 1).alias("c")).schema["c"].metadata == {}


def test_period_filters_reach_the_scan(spark):
    path = scratch(spark, "pushed")
    parquet.write_sorted(frame(spark, FACILITY, reconciled()["facility"]), FACILITY, path)
    from fleetgauge.operators.paging import lookahead, selected

    df = lookahead(selected(parquet.scan(spark, FACILITY, path), FACILITY, START, END, {"facility": "46"}), FACILITY.keys, 10)
    plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "GreaterThanOrEqual(period" in plan and "EqualTo(facility,46)" in plan and "TakeOrderedAndProject" in plan


def test_page_rows_keep_duplicates(spark):
    rows = deepcopy(reconciled())
    rows["facility"].append(dict(rows["facility"][0]))
    attempts, _ = land(spark, rows)
    assert pages.page_rows(attempts, FACILITY).count() == len(rows["facility"])
