"""Stored failures and receipts: what failed can be told later, and nothing changes unnoticed."""

import hashlib
from copy import deepcopy
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from fleetgauge import fixtures
from fleetgauge.contracts import ALL, GRAINS, RECEIPT_SCHEMA
from fleetgauge.functions.dates import calendar
from fleetgauge.functions.digests import digest_sums
from fleetgauge.plans import checks, details, diagnostics, receipts, refresh
from fleetgauge.plans.outcomes import union
from fleetgauge.session import scratch, settle
from fleetgauge.sources import history
from rows import dec, frames, observation, reconciled
from test_pipeline import land

START, END = date(2026, 10, 1), date(2026, 10, 3)


def judged(spark, rows, attempt="a1", path=None):
    tables = frames(spark, rows)
    store = details.DetailStore(spark, path or scratch(spark, "details"), "v1", attempt)
    return store, settle(details.check_tables(store, tables, calendar(spark, START, END), F.lit(START), F.lit(END)))


def spoiled():
    rows = deepcopy(reconciled())
    rows["generator"][0]["capacity"] += dec("0.000001")  # V06, V07, D08
    rows["facility"][1]["facilityName"] = None
    rows["facility"][1]["percentOutage"] = None
    del rows["facility"][5]  # V05, V06, V07, D07
    rows["national"].append(dict(rows["national"][0]))
    del rows["national"][1]  # V04
    rows["generator"][3]["outage"] = dec("-1")
    rows["generator"][4]["percentOutage"] = dec("101")
    return rows


def test_results_are_those_of_the_plain_checks(spark):
    for rows in (reconciled(), spoiled()):
        tables, days = frames(spark, rows), calendar(spark, START, END)
        plain = checks.table_checks(tables, days) + [diagnostics.row_diagnostics(tables[n], s) for n, s in GRAINS.items()]
        plain += [diagnostics.change_diagnostics(tables[n], s, F.lit(START), F.lit(END)) for n, s in GRAINS.items()]
        _, found = judged(spark, rows)
        shown = lambda df: {tuple(r)[:7] for r in df.collect()}
        assert shown(found) == shown(union(plain))
        digests = {(r.check_code, r.dataset_key): r.details_hash for r in union(plain).collect() if r.details_hash and r.status != "error"}
        assert digests.items() <= {(r.check_code, r.dataset_key): r.details_hash for r in found.collect()}.items()


def test_failures_are_told_row_by_row(spark):
    store, _ = judged(spark, spoiled())
    one, two, three = (START + timedelta(days=d) for d in range(3))
    said = lambda code, *names: {tuple(r) for r in store.rows(code).select(*names).collect()}
    assert said("V03", "dataset_key", "period", "copies") == {("national", one, 2)}
    assert said("V04", "dataset", "kind", "period") == {("national", "missing", two), ("national", "repeated", one)}
    assert said("V05", "kind", "period", "facility") == {("missing_facility", three, "46")}
    assert said("V06", "period", "facility", "measure", "note") == {
        (one, "001", "capacity", "mismatch"), (one, "46", "outage", "mismatch"), (three, "46", "capacity", "missing"), (three, "46", "outage", "missing"),
    }
    assert ("facility_to_national", two, "capacity", "missing") in said("V07", "kind", "period", "measure", "note")
    assert said("D01", "dataset_key", "facility") == {("facility", "46")} == said("D02", "dataset_key", "facility")
    assert said("D03", "generator", "outage") == {("2", dec("-1.000000"))} and said("D05", "percentOutage") == {(dec("101.000000"),)}
    assert {k[1:] for k in said("D06", "period", "kind", "note") if k[1] == "not_applicable"} == {("not_applicable", "missing_source_percentage")}
    assert said("D07", "dataset_key", "kind", "period", "facility") == {("facility", "removed", three, "46")}
    assert ("generator", dec("100.000001"), dec("100.000000")) in said("D08", "dataset_key", "expected", "observed")
    eligible = {r.dataset_key: r.eligible_count for r in details.eligible(store.rows("D06"), judged(spark, spoiled())[1]).collect()}
    assert eligible == {"national": 3, "facility": 4, "generator": 12}


def test_digests_come_back_from_the_store(spark):
    path = scratch(spark, "details")
    for attempt, rows in (("a1", spoiled()), ("a2", reconciled())):
        store, results = judged(spark, rows, attempt, path)
        sealed = {(r.check_code, r.dataset_key): (r.failed_count, r.details_hash) for r in results.collect() if r.status != "error"}
        back = {(r.check_code, r.dataset_key): r for r in details.digests(store.rows(), sealed).collect()}
        assert {k: r.details_hash for k, r in back.items()} == {k: h for k, (_, h) in sealed.items()}
        assert all(r.failures == sealed[k][0] for k, r in back.items() if k[0] not in ("V03", "V04"))
    # A clean attempt beside a spoiled one; all of its failures are none.
    assert store.rows().count() == 0 and set(back) > {("V07", ALL), ("D08", "generator")}
    assert {r.details_hash for r in back.values()} == {hashlib.sha256(b"0:0:0:0:0").hexdigest()}


def test_sets_of_failures_add_up(spark):
    rows = spark.range(50).select(F.sha2(F.col("id").cast("string"), 256).alias("_digest"), (F.col("id") % 3 == 0).alias("odd"))
    sums = lambda df: list(df.agg(*[c.alias(str(i)) for i, c in enumerate(digest_sums(F.lit(True)))]).first())
    a, b, whole = sums(rows.filter("odd")), sums(rows.filter("not odd")), sums(rows)
    assert [x + y for x, y in zip(a, b)] == whole and sums(rows.filter("odd").unionByName(rows.filter("odd"))) != a


@pytest.fixture
def refreshed(spark):
    attempts, routes = land(spark, reconciled())
    root = scratch(spark, "store")
    refresh.refresh(spark, root, "v1", "a1", 5, attempts, routes, refresh.Window(START, END), fixtures.ROUTES)
    return root


def problems(spark, root, version="v1"):
    return {tuple(r) for r in refresh.reverify(spark.newSession(), root, version).collect()}


def test_a_later_session_verifies_from_the_store_alone(spark, refreshed):
    assert problems(spark, refreshed) == set()
    assert problems(spark, refreshed, "v2") == {("receipt", "absent")}


def test_changed_results_files_and_failures_are_noticed(spark, refreshed):
    saved = settle(history.attempts_of(spark, f"{refreshed}/check_results", "v1"))
    others = saved.limit(1).withColumn("check_code", F.lit("V09"))
    others.write.mode("append").partitionBy("version_id", "attempt_id").parquet(f"{refreshed}/check_results")
    assert ("results", "changed") in problems(spark, refreshed)
    extra = spark.createDataFrame([("national", "affected", START, dec("1"))], "dataset_key string, kind string, period date, capacity decimal(24,6)")
    extra.write.parquet(f"{refreshed}/check_details/version_id=v1/attempt_id=a1/job=later/check_code=D03")
    assert ("details", "D03:national") in problems(spark, refreshed)
    frames(spark, reconciled())["national"].write.mode("append").parquet(f"{refreshed}/data/national_outages/version_id=v1")
    assert ("files", "extra:national") in problems(spark, refreshed)


def test_a_mixture_gets_no_receipt(spark, refreshed):
    saved = history.attempts_of(spark, f"{refreshed}/check_results", "v1")
    for name in ("attempt_id", "manifest_sha256", "version_id"):
        mixed = saved.withColumn(name, F.when(F.col("check_code") == "V03", F.lit("other")).otherwise(F.col(name)))
        with pytest.raises(ValueError, match="mixture"):
            receipts.issue(mixed, refreshed, 6, START, END, {})
    with pytest.raises(ValueError, match="mixture"):
        receipts.issue(saved.withColumn("manifest_sha256", F.lit(None).cast("string")), refreshed, 6, START, END, {})


def test_receipts_follow_one_another(spark, refreshed):
    saved = history.attempts_of(spark, f"{refreshed}/check_results", "v1")
    verdict = {"status": "passed", "warning_count": 0, "warning_digest": "x", "approval_required": False}
    issued = [receipts.issue(saved, refreshed, seq, START, END, verdict) for seq in (6, 7)]
    chain = receipts.read(spark, refreshed)
    assert {r.predecessor for r in chain.collect()} == {None, issued[0], chain.filter("run_seq = 5").first().receipt_id}
    assert receipts.faults(chain).count() == 0
    found = lambda df: {(r.receipt_id, r.problem) for r in receipts.faults(df).collect()}
    edited = chain.withColumn("warning_count", F.when(F.col("run_seq") == 6, 9).otherwise(F.col("warning_count")).cast("long"))
    assert found(edited) == {(issued[0], "content")}
    assert found(chain.filter("run_seq <> 6")) == {(issued[1], "predecessor_absent")}
    again = receipts.issue(saved.limit(3), refreshed, 6, START, END, verdict)
    fork = found(receipts.read(spark, refreshed))
    assert fork == set() and again != issued[0]  # two receipts of one run name the same predecessor
    row = {**chain.filter("run_seq = 7").first().asDict(), "run_seq": 8, "predecessor": issued[0]}
    row["receipt_id"] = receipts.content_id(row)
    other = spark.createDataFrame([tuple(row[n] for n in RECEIPT_SCHEMA.fieldNames())], RECEIPT_SCHEMA)
    assert found(chain.unionByName(other)) == {(issued[1], "fork"), (row["receipt_id"], "fork")}


def test_a_table_without_rows(spark):
    rows = {**reconciled(), "facility": []}
    store, results = judged(spark, rows)
    assert {r.kind for r in store.rows("V05").collect()} == {"missing_facility"} and store.rows("V04").filter("dataset = 'facility'").count() == 3
    assert {r.checked_count for r in results.filter("dataset_key = 'facility'").collect()} == {0}
    assert observation()["facility"] == "46"
