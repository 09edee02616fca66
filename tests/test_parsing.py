from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fleetgauge.contracts import FACILITY, GENERATOR, NATIONAL
from fleetgauge.functions.parsing import accepted, kept_text, normalize, parse_date, parse_decimal, refused
from fleetgauge.functions.search import contains_folded
from fleetgauge.sources.exports import check_export
from fleetgauge.sources.pages import of_version, page_rows

GOOD = {
    "period": "2024-02-29", "facility": " 0x7 ", "generator": "00", "facilityName": " Mill ", "capacity": "100.0000000",
    "outage": "-.5", "percentOutage": "5", "capacity-units": "megawatts", "outage-units": "megawatts", "percentOutage-units": "percent",
}


def judge(spark, changes, spec=GENERATOR):
    row = {**GOOD, **changes}
    row = {k: v for k, v in row.items() if v != "absent"}
    raw = spark.createDataFrame([tuple(row.values())], ", ".join(f"`{k}` string" for k in row))
    return normalize(raw, spec).first()


def test_good_row_keeps_ids_and_labels(spark):
    row = judge(spark, {})
    assert (row["period"], row["facility"], row["generator"], row["facilityName"]) == (date(2024, 2, 29), " 0x7 ", "00", " Mill ")
    assert (row["capacity"], row["outage"], row["percentOutage"], row["error_code"]) == (Decimal(100), Decimal("-0.5"), Decimal(5), None)


@pytest.mark.parametrize(
    "text", ["1999-02-29", "1999-11-31", "1999-5-07", "1999/05/07", "07-05-1999", "99-05-07", "1999-05-07 00:00", "1999-05-07 ", "\t1999-05-07", "0000-12-31", "1999-13-01", "१९९९-05-07"]
)
def test_dates_that_are_refused(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    parsed = parse_date(F.col("t"))
    assert tuple(df.select(parsed.value, parsed.error).first()) == (None, "invalid_date")


@pytest.mark.parametrize(
    "text,error",
    [
        ("863.4000000", None), (".5", None), ("+7", None), ("000000000000000000000007.1", None), ("999999999999999999.999999", None),
        ("863.4000001", "decimal_scale"), ("1000000000000000000", "decimal_overflow"), ("5.", "invalid_decimal"), ("1e3", "invalid_decimal"),
        (" 5 ", "invalid_decimal"), ("1,5", "invalid_decimal"), ("NaN", "invalid_decimal"), ("٣", "invalid_decimal"), ("5\n", "invalid_decimal"),
        ("", "required_text"), ("  ", "required_text"), (None, "required_text"), ("-1", "negative_capacity"), ("-0", None),
        ("1000000000000000000.0000001", "decimal_overflow"),
    ],
)
def test_decimal_text(spark, text, error):
    parsed = parse_decimal(F.col("t"), nonnegative=True)
    row = spark.createDataFrame([(text,)], "t string").select(parsed.value.alias("v"), parsed.error.alias("e")).first()
    assert row["e"] == error and (row["v"] is None) == (error is not None)
    if error is None:
        assert row["v"] == Decimal(text)


@pytest.mark.parametrize(
    "changes,code,field",
    [
        ({"period": "absent"}, "required_text", "period"), ({"facility": "  "}, "required_text", "facility"),
        ({"generator": None}, "required_text", "generator"), ({"capacity-units": "kilowatts"}, "invalid_units", "capacity-units"),
        ({"outage-units": "absent"}, "invalid_units", "outage-units"), ({"percentOutage-units": None}, "invalid_units", "percentOutage-units"),
        ({"capacity": "-1"}, "negative_capacity", "capacity"), ({"outage": "x"}, "invalid_decimal", "outage"),
        ({"percentOutage": "1.1234567"}, "decimal_scale", "percentOutage"), ({"period": "x", "outage": "x"}, "invalid_date", "period"),
    ],
)
def test_first_fault_is_reported(spark, changes, code, field):
    row = judge(spark, changes)
    assert (row["error_code"], row["error_field"]) == (code, field)


@pytest.mark.parametrize("percent", [None, "", " ", "absent"])
def test_percentage_may_be_missing_without_units(spark, percent):
    row = judge(spark, {"percentOutage": percent, "percentOutage-units": None}, NATIONAL)
    assert row["percentOutage"] is None and row["error_code"] is None


def test_blank_label_becomes_null(spark):
    df = spark.createDataFrame([(" ",), ("\u0085",), (" a ",)], "t string")
    assert [r[0] for r in df.select(kept_text(F.col("t"))).collect()] == [None, None, " a "]


def _attempt(spark, body):
    return spark.sql("select 'v' version_id, 'facility' dataset, 0L seq, 200 http_status, cast(null as string) error_code, 'no_error_reported' api_status").withColumn(
        "sanitized_response", F.lit(body)
    ).withColumn("response_sha256", F.sha2("sanitized_response", 256))


def test_values_that_are_not_text_are_never_converted(spark):
    base = '"period":"2026-10-01","facility":"46","outage":"1","capacity-units":"megawatts","outage-units":"megawatts","percentOutage-units":"percent"'
    rows = [
        base + ',"capacity":"5","percentOutage":"1"', base + ',"capacity":5,"percentOutage":"1"', base + ',"capacity":"5","percentOutage":1',
        base + ',"capacity":"5","percentOutage":null', base + ',"capacity":"5","facilityName":true', base + ',"capacity":"5","facilityName":"a\\u0041"',
    ]
    body = '{"response":{"data":[%s]}}' % ",".join("{%s}" % r for r in rows)
    typed = normalize(page_rows(_attempt(spark, body), FACILITY), FACILITY, ("position",))
    found = {r["position"]: (r["error_code"], r["error_field"]) for r in typed.collect()}
    assert found == {
        0: (None, None), 1: ("required_text", "capacity"), 2: ("invalid_text", "percentOutage"), 3: (None, None),
        4: ("invalid_text", "facilityName"), 5: (None, None),
    }
    assert accepted(typed, FACILITY).count() == 3 and refused(typed).count() == 3


def test_case_folding_search(spark):
    df = spark.createDataFrame([("50%_Mill",), ("Große Au",), ("a'b\\c",), (None,)], "t string")
    found = lambda s: [r[0] for r in df.filter(contains_folded(F.col("t"), s)).collect()]
    assert found("%_") == ["50%_Mill"] and found("GROSSE") == ["Große Au"] and found("A'B\\") == ["a'b\\c"]


GOOD_BODY = '{"response":{"data":[{"period":"1999-05-31","facility":"7","outage":"1","capacity":"5","capacity-units":"megawatts","outage-units":"megawatts"}]}}'


@pytest.mark.parametrize(
    "body,code",
    [
        (GOOD_BODY, None), (GOOD_BODY[:60], "unreadable_body"), ('{"response":{}}', "unreadable_body"), ("{}", "unreadable_body"),
        ("no page", "unreadable_body"), ("", "unreadable_body"), (GOOD_BODY.replace("{", '{"error":"late",', 1), "error_member"),
        (GOOD_BODY.replace('"data"', '"error":{"code":3},"data"'), "error_member"), ('{"response":{"data":7}}', "unreadable_body"),
    ],
)
def test_a_body_is_taken_whole_or_refused_with_a_row(spark, body, code):
    rows = normalize(page_rows(_attempt(spark, body), FACILITY), FACILITY).select("error_code", "error_field").collect()
    assert [tuple(r) for r in rows] == [(code, code and "sanitized_response")]


def test_a_changed_body_is_refused_and_an_empty_page_is_silent(spark):
    changed = _attempt(spark, GOOD_BODY).withColumn("response_sha256", F.sha2(F.lit("another"), 256))
    assert [r["error_code"] for r in normalize(page_rows(changed, FACILITY), FACILITY).collect()] == ["response_checksum"]
    assert page_rows(_attempt(spark, '{"response":{"data":[]}}'), FACILITY).count() == 0


def test_versions_of_one_log_are_kept_apart(spark):
    log = _attempt(spark, GOOD_BODY)
    both = log.unionByName(log.withColumn("version_id", F.lit("w")))
    assert page_rows(of_version(both, "v"), FACILITY).count() == 1


@pytest.mark.parametrize(
    "spaced",
    [GOOD_BODY.replace('"capacity":"5"', '"capacity" :\n 5'), GOOD_BODY.replace('"capacity":"5"', '"capacity":{"n":5}'),
     GOOD_BODY.replace('"facility":"7",', "").replace('"outage"', '"facility":7,"outage"')],
)
def test_values_that_are_not_text_are_found_wherever_they_stand(spark, spaced):
    row = normalize(page_rows(_attempt(spark, spaced), FACILITY), FACILITY).first()
    assert row["error_code"] == "required_text"


@pytest.mark.parametrize(
    "text,good",
    [("1.000000", True), ("1.0000000", False), ("1.0000000000001", False), ("1e-6", True), ("1e-7", False), ("10e-7", False), ("1.5e-5", True),
     ("1.5e-6", False), ("1.2345678e2", True), (" 7 ", True), ("1.2345678e+1", True), ("1.23456789e+1", False), ("7.", True)],
)
def test_an_export_number_keeps_six_places_as_written(spark, text, good):
    row = [("1999-05-31", "7", text, "0", "")]
    export = spark.createDataFrame(row, "period string, facility string, capacity string, outage string, percentOutage string")
    assert (check_export(export, FACILITY).first()["refused"] is None) == good


def test_text_with_a_visible_start_is_kept_as_all_other_text(spark):
    from fleetgauge.functions.parsing import is_blank, kept_text

    texts = ["", " ", "\t", "\u00a0", "\u2003\n", "\x1c", "\x85", "!", "~", "~x", "\x7f", "a ", " a", "é", "Ω", "0", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", kept_text(F.col("t")).alias("kept"), is_blank(F.col("t")).alias("blank")).collect()
    assert [r.kept for r in rows] == [None if r.blank else r.t for r in rows]
    assert [r.t for r in rows if not r.blank] == ["!", "~", "~x", "\x7f", "a ", " a", "é", "Ω", "0"]
