"""Steps whose disk or memory must not grow faster than their input."""

import hashlib
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from fleetgauge import fixtures
from fleetgauge.catalog import ingest
from fleetgauge.contracts import ATTEMPT_SCHEMA, DIAGNOSTIC_SCOPES, GENERATOR, GRAINS, REQUIRED_SCOPES
from fleetgauge.functions.digests import SLICE, WIDE, fingerprint
from fleetgauge.operators import adjacency, compare
from fleetgauge.operators.day_sets import day_sets
from fleetgauge.operators.numbering import number_rows, number_sorted_files
from fleetgauge.plans import details, findings
from fleetgauge.session import scratch, settle
from fleetgauge.sources import parquet
from rows import dec, frame, observation


def units(spark, days=20, each=50):
    rows = [
        observation((date(2026, 1, 1) + timedelta(days=d)).isoformat(), str(g % 7), str(g), f"Plant {g}", str(g), "1", None if g % 3 else "2")
        for d in range(days) for g in range(each)
    ]
    return frame(spark, GENERATOR, rows)


def test_landed_pages_take_less_disk_than_their_bodies(spark, monkeypatch):
    paths = []
    monkeypatch.setattr(ingest, "scratch", lambda spark, purpose: paths.append(fixtures.scratch(spark, purpose)) or paths[-1])
    landed = ingest.land(spark, units(spark), GENERATOR, page_rows=100)
    bodies = landed.agg(F.sum(F.length("sanitized_response"))).first()[0]
    files = spark.read.format("binaryFile").load(paths[0]).filter(F.col("length") > 0)
    assert files.agg(F.sum("length")).first()[0] * 4 < bodies
    text = ingest.pages.page_rows(landed, GENERATOR)
    assert text.count() == 1000 and text.filter("facility is null or `percentOutage-units` <> 'percent'").count() == 0
    assert text.filter("generator = '4'").agg(F.min("capacity")).first()[0] == f"{dec('4'):.6f}"


def test_rows_of_sorted_files_are_numbered_where_they_are(spark, tmp_path):
    keys = ["period", "facility", "generator"]
    parquet.write_sorted(units(spark, days=9, each=20), GENERATOR, str(tmp_path / "t"), partitions=5)
    table = parquet.scan(spark, GENERATOR, str(tmp_path / "t"))
    found = number_sorted_files(table, keys, "n")
    assert len(table.inputFiles()) > 1 and "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    rows = sorted(found.collect(), key=lambda r: r.n)
    assert [r.n for r in rows] == list(range(1, 181)) and [tuple(r[k] for k in keys) for r in rows] == sorted(tuple(r[k] for k in keys) for r in rows)
    # Rows that had to be sorted first do not move a second time for their numbers either.
    again = number_rows(table.select(*keys), [F.col(k) for k in keys], "n")
    assert "Exchange hashpartitioning" not in again._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in again.select(*keys, "n").collect()} == {(*[r[k] for k in keys], r.n) for r in rows}


def test_landed_pages_of_stored_tables_are_read_by_dataset(spark, tmp_path):
    tables = {}
    for name, spec in GRAINS.items():
        rows = units(spark, days=3, each=30).select(*spec.schema.names) if name == "generator" else units(spark, days=2 if name == "national" else 3, each=1).select(*spec.schema.names)
        parquet.write_sorted(rows, spec, str(tmp_path / name), partitions=3)
        tables[name] = parquet.scan(spark, spec, str(tmp_path / name))
    attempts = ingest.land_all(spark, tables)
    assert attempts.columns == ATTEMPT_SCHEMA.fieldNames()
    own = attempts.filter("dataset = 'facility'")
    assert "PartitionFilters: [isnotnull(dataset" in own._jdf.queryExecution().executedPlan().toString() and own.filter("http_status = 200").count() == 2
    for name, spec in GRAINS.items():
        plain = fixtures.landed_attempts(tables[name], spec, "v1", ingest.PAGE_ROWS, 90 if name == "facility" else None)
        landed = attempts.filter(F.col("dataset") == name)
        assert compare.multiset_difference(plain, landed).count() == 0 and landed.count() > 1


def test_tables_that_few_rows_share_a_key_of_are_compared_without_combining_first(spark):
    df = units(spark, days=2, each=6)
    other = df.filter("generator <> '3'").withColumn("outage", F.when(F.col("generator") == "4", dec("9")).otherwise(F.col("outage")).cast("decimal(24,6)"))
    found = compare.multiset_difference(df.unionByName(df.filter("generator = '5'")), other, list(GENERATOR.keys))
    assert "Aggregate" not in _before_the_shuffle(found)
    assert sorted((r.period.day, r.generator, r.left_copies, r.right_copies) for r in found.collect()) == sorted(
        (d, *row) for d in (1, 2) for row in (("3", 1, 0), ("4", 0, 1), ("4", 1, 0), ("5", 2, 1)))


def test_bodies_that_hold_other_values_than_text_are_found(spark):
    values = {'"x"': False, '"x:1"': False, "null": False, "5": True, "true": True, "-1": True, "{}": True, '[]': True, ' "x"': False, ' 5': True}
    for colon in (":", " :", "\t:"):
        bodies = [('{"response":{"total":3,"data":[{"a"%s%s,"b":"y"}]}}' % (colon, value), mixed) for value, mixed in values.items()]
        found = spark.createDataFrame(bodies, "sanitized_response string, mixed boolean")
        assert found.filter(ingest.pages._may_hold_other_values() != F.col("mixed")).collect() == []


def _before_the_shuffle(df):
    """The part of a plan below its last exchange by key, as text."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return plan.split("hashpartitioning", 1)[1]


def test_days_of_units_and_pairs_are_not_combined_before_they_move(spark):
    df = units(spark, days=5, each=10)
    for found in (
        adjacency.day_pairs(df, GENERATOR), day_sets(df, ("facility", "generator")),
        compare.one_sided(df, df.filter("generator <> '3'"), ["period", "facility", "generator"], ("a", "b")),
    ):
        assert "Aggregate" not in _before_the_shuffle(found)


def test_one_sided_keys(spark):
    df = units(spark, days=2, each=4)
    left, right = df.filter("generator <> '3'"), df.filter("generator <> '1'").unionByName(df.filter("generator = '2'"))
    found = compare.one_sided(left, right, ["period", "generator"], ("left", "right"))
    assert sorted((r.period.day, r.generator, r.missing_in) for r in found.collect()) == [
        (1, "1", "right"), (1, "3", "left"), (2, "1", "right"), (2, "3", "left")
    ]


def test_wide_digests_read_what_narrow_ones_leave_out(spark):
    digest = "f" * 64
    other = digest[:40] + "0" + digest[41:]  # differs beyond the 28 digits that four parts of 7 read
    seal = lambda d, width: spark.createDataFrame([(d,)] * 9, "_digest string").agg(
        fingerprint(F.lit(True), width=width).alias("d")).first()["d"]
    assert seal(digest, SLICE) == seal(other, SLICE)
    assert seal(digest, WIDE) != seal(other, WIDE)
    total = ":".join(["9", *[str(9 * int(digest[15 * i:15 * i + 15], 16)) for i in range(4)]])
    assert seal(digest, WIDE) == hashlib.sha256(total.encode()).hexdigest()


def _stored_plans(monkeypatch, spark, judge):
    """Plans of what a step stores."""
    found, save = [], details.DetailStore.save
    monkeypatch.setattr(details.DetailStore, "save", lambda self, failures, job: found.append(failures) or save(self, failures, job))
    judge(details.DetailStore(spark, scratch(spark, "details"), "v1", "a1"))
    return [df._jdf.queryExecution().optimizedPlan().toString() for df in found]


def test_changes_are_stored_without_arrays_of_whole_rows(spark, monkeypatch):
    df = units(spark, days=5, each=10)
    day = lambda n: F.lit(date(2026, 1, n))
    for plan in _stored_plans(monkeypatch, spark, lambda store: details.change_failures(store, df, GENERATOR, day(1), day(5))):
        assert "inline(" not in plan and "lambda" not in plan


def test_differing_groups_are_stored_without_arrays_of_whole_rows(spark, monkeypatch):
    sums = units(spark, days=3, each=9).groupBy("period", "facility").agg(F.sum("capacity").alias("capacity"), F.sum("outage").alias("outage"))
    halves = sums.filter("facility <> '1'").withColumn("outage", F.col("outage") / 2)
    for plan in _stored_plans(monkeypatch, spark, lambda store: details.facility_groups(store, sums, halves)):
        assert "inline(" not in plan and "lambda" not in plan


def test_digests_of_stored_failures_are_compiled_to_machine_code(spark):
    said = {"check_code": "D03", "dataset_key": "facility", "kind": "affected"}
    stored = settle(spark.range(1).select(*[F.lit(said.get(f.name)).cast(f.dataType).alias(f.name) for f in details.DETAIL_SCHEMA]))
    df = details.digests(stored, [(code, g) for code, scopes in DIAGNOSTIC_SCOPES.items() for g in scopes if code != "D09"])
    assert df.filter("failures = 1").count() == 1 and df.collect()
    plan = df._jdf.queryExecution().debug().codegenToSeq()
    sizes = [plan.apply(i)._3().maxMethodCodeSize() for i in range(plan.size())]
    assert sizes and max(sizes) < 8000  # HotSpot interprets larger methods for ever


def test_rows_are_judged_in_machine_code(spark, monkeypatch):
    found, df = [], settle(units(spark, days=3, each=9))
    monkeypatch.setattr(details.DetailStore, "save", lambda self, failures, job: found.append(failures) or failures.collect())
    details.row_failures(details.DetailStore(spark, "none", "v1", "a1"), df, GENERATOR)
    plan = found[0]._jdf.queryExecution().debug().codegenToSeq()
    sizes = [plan.apply(i)._3().maxMethodCodeSize() for i in range(plan.size())]
    assert sizes and max(sizes) < 8000


def test_pairs_of_days_are_aggregated_without_a_sort(spark):
    df = units(spark, days=4, each=6)
    pairs = adjacency.day_pairs(df.unionByName(df.filter("generator = '1'").withColumn("capacity", F.lit(dec("9")))), GENERATOR)
    rows = {(r.generator, r.period.day): r for r in pairs.collect()}
    assert "SortAggregate" not in pairs._jdf.queryExecution().executedPlan().toString()
    # The higher one of two values of a key, on either side, and null where there is none.
    assert (rows["1", 2].value, rows["1", 2].previous_value, rows["1", 2].rows_now, rows["1", 2].rows_before) == (dec("9"), dec("9"), 2, 2)
    assert (rows["2", 1].value, rows["2", 1].previous_value) == (dec("2"), None) and rows["2", 5].value is None


def test_only_jobs_that_judge_the_asked_codes_run(spark, tmp_path, monkeypatch):
    df = units(spark, days=3, each=9)
    plants = df.groupBy("period", "facility").agg(F.max("facilityName").alias("facilityName"), *[F.sum(m).cast("decimal(24,6)").alias(m) for m in ("capacity", "outage")], F.max("percentOutage").alias("percentOutage"))
    days = plants.groupBy("period").agg(*[F.sum(m).cast("decimal(24,6)").alias(m) for m in ("capacity", "outage")], F.max("percentOutage").alias("percentOutage"))
    tables = {"national": days, "facility": plants.filter("facility <> '3'"), "generator": df}
    ends, window = (F.lit(date(2026, 1, 1)), F.lit(date(2026, 1, 3))), days.select("period")
    whole, part = (details.DetailStore(spark, str(tmp_path / n), "v1", "a1") for n in ("whole", "part"))
    every = {tuple(r) for r in details.check_tables(whole, tables, window, *ends).collect()}
    jobs, save = [], details.DetailStore.save
    monkeypatch.setattr(details.DetailStore, "save", lambda self, failures, job: jobs.append(job) or save(self, failures, job))
    some, profiles = {tuple(r) for r in details.check_tables(part, tables, window, *ends, ["D05"]).collect()}, {}
    assert sorted(jobs) == ["rows-facility", "rows-generator", "rows-national"]
    some |= {tuple(r) for r in details.check_tables(part, tables, window, *ends, ["V06"], profiles).collect()}
    assert sorted(jobs)[:1] == ["groups"] and len(jobs) == 4 and sorted(profiles) == ["facility", "generator"]
    assert some == {r for r in every if r[0] in (*details.ROW_CODES, "V05", "V06")}
    for code in ("D02", "D06", "V05", "V06"):
        assert sorted(map(str, whole.rows(code).collect())) == sorted(map(str, part.rows(code).collect())) != []


def test_each_digest_reads_its_columns_in_one_order():
    for code, scopes in {**REQUIRED_SCOPES, **DIAGNOSTIC_SCOPES}.items():
        if code in ("V01", "V02", "V08", "D09"):
            continue
        for scope in scopes:
            read = details.digest_columns(code, scope)
            assert [c for c in details.READ if c in read] == read


def test_rows_are_stored_without_arrays_of_whole_rows(spark, monkeypatch):
    df = units(spark, days=3, each=9)
    for plan in _stored_plans(monkeypatch, spark, lambda store: details.row_failures(store, df, GENERATOR)):
        assert "inline(" not in plan and "lambda" not in plan and plan.count("CollectMetrics") == 2


def test_report_is_worked_out_and_stored_once(spark, tmp_path):
    # Two days of units, one of them with another sum in the facility table and one that only the units have.
    df = units(spark, days=2, each=4)
    plants = df.filter("facility <> '3'").groupBy("period", "facility").agg(
        F.max("facilityName").alias("facilityName"), (F.sum("capacity") + F.when(F.col("facility") == "2", 5).otherwise(0)).cast("decimal(24,6)").alias("capacity"),
        F.sum("outage").cast("decimal(24,6)").alias("outage"), F.max("percentOutage").alias("percentOutage"),
    )
    national = df.groupBy("period").agg(*[F.sum(m).cast("decimal(24,6)").alias(m) for m in ("capacity", "outage")])
    evaluated = spark.sparkContext.accumulator(0)

    @F.udf("decimal(24,6)")
    def counted(value):
        evaluated.add(1)
        return value

    report = findings.reconciliation_report(national, plants, settle(df)).withColumn("difference", counted("difference"))
    findings.save_report(report, str(tmp_path / "r"))
    rows = spark.read.option("header", True).schema(report.schema).csv(str(tmp_path / "r/reconciliation"))
    # Four facilities, the facility table's days and the units' days: two measures on two days.
    assert evaluated.value == rows.count() == 24
    stored = spark.read.json(str(tmp_path / "r/summary")).first().asDict()
    again = findings.reconciliation_summary(rows).first().asDict()
    assert stored == {**again, "max_absolute_difference": float(again["max_absolute_difference"])}
    assert again["comparisons"] == 24 and again["nonmatching"] > 0


def test_sums_of_facility_days_meet_without_a_join(spark):
    df = units(spark, days=2, each=8)
    rows = df.select("period", "facility", "capacity", "outage")
    unknown = rows.limit(1).withColumn("period", F.lit(None).cast("date"))
    left, right = rows.unionByName(unknown), rows.filter("facility <> '1'").unionByName(unknown)
    found = compare.joined_sums(left, right, ["period", "facility"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in _before_the_shuffle(found)
    got = {(r.period, r.facility, r.in_left, r.in_right): (r.left_capacity, r.right_capacity) for r in found.collect()}
    day = date(2026, 1, 1)
    assert got[day, "0", True, True] == (dec("7"), dec("7")) and got[day, "1", True, False] == (dec("1"), None)
    # As in a join, keys that hold a null do not meet.
    assert sorted(k[2:] for k in got if k[0] is None) == [(False, True), (True, False)] and len(got) == 16


def test_tables_are_moved_once_from_stored_whole_numbers(spark, tmp_path):
    line = "l_shipdate timestamp, l_suppkey long, l_partkey long, l_returnflag string, l_quantity double, l_discount double, l_tax double"
    lines = [(datetime(2026, 1, 1 + d), s, p, "AN"[p % 2], 10.0 + p, 0.05, 0.02) for d in range(2) for s in range(4) for p in range(3)]
    spark.createDataFrame(lines, line).write.parquet(str(tmp_path / "lineitem.parquet"))
    # One supplier is missing, one stands twice.
    suppliers = [(0, "a"), (1, "b"), (2, "c"), (2, "d")]
    spark.createDataFrame(suppliers, "s_suppkey long, s_name string").write.parquet(str(tmp_path / "supplier.parquet"))
    found = fixtures._label(fixtures._units(spark, str(tmp_path)), spark, str(tmp_path))
    assert {"capacity": "bigint", "outage": "bigint", "percentOutage": "bigint"}.items() <= dict(found.dtypes).items()
    stored = settle(found)
    # Below the ranges is nothing but a scan, since it is worked out once more for the split points.
    for rows in (fixtures._generator_rows(stored), fixtures._facility_rows(stored, clean=True)):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and plan.count("RepartitionByExpression") <= 1
        assert "Aggregate" not in plan.split("RepartitionByExpression")[-1]
    tables = fixtures.outages(spark, str(tmp_path), clean=True)
    assert tables["generator"].count() == 2 * 3 * 4 and tables["facility"].count() == 2 * 4
    sums = {(r.facility, r.facilityName): r.capacity for r in tables["facility"].filter("period = date '2026-01-01'").collect()}
    assert sums == {("0", "a A"): dec("33"), ("1", "b A"): dec("33"), ("2", "c A"): dec("33"), ("2", "d A"): dec("33")}
    assert tables["national"].first().capacity == dec("132")  # units without a supplier count, none counts twice
