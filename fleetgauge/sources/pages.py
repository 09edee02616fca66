"""Landed page responses: one row per request attempt, the body kept as text."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgauge.contracts import ATTEMPT_SCHEMA, ROUTE_SCHEMA, GrainSpec
from fleetgauge.functions.parsing import UNITS
from fleetgauge.operators.numbering import running_before

NO_ERROR = "no_error_reported"  # fixed value: the status of an accepted response


def read_attempts(spark: SparkSession, path: str) -> DataFrame:
    """A log as it was landed. Where each dataset has a folder of its own (``dataset=…``), a filter on it reads that folder alone."""
    return spark.read.schema(ATTEMPT_SCHEMA).option("mode", "FAILFAST").json(path).select(*ATTEMPT_SCHEMA.fieldNames())


def read_routes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ROUTE_SCHEMA).option("mode", "FAILFAST").json(path)


def answered() -> Column:
    return F.col("http_status").eqNullSafe(F.lit(200)) & F.col("error_code").isNull()


def successful() -> Column:
    return answered() & F.col("api_status").eqNullSafe(F.lit(NO_ERROR))


def source_fields(spec: GrainSpec) -> list[str]:
    names = [*spec.keys, *([spec.label] if spec.label else []), *spec.measures, spec.percent]
    return names + [f"{name}-units" for name in (*spec.measures, spec.percent)]


def envelope_type(spec: GrainSpec, keys_only: bool = False) -> str:
    """Values stay VARIANT so that text can be told from JSON numbers and booleans;
    checks of the request log need the keys alone, as plain text."""
    row = ", ".join(f"`{name}`: variant" for name in source_fields(spec))
    if keys_only:
        row = ", ".join(f"`{name}`: string" for name in spec.keys)
    return (
        "apiVersion string, error variant, response struct<error: variant, total: variant, "
        f"frequency: string, data: array<struct<{row}>>>"
    )


def open_envelopes(attempts: DataFrame, spec: GrainSpec, keys_only: bool = False) -> DataFrame:
    own = attempts.filter(F.col("dataset") == spec.name)
    kind = envelope_type(spec, keys_only)
    return own.withColumn("body", F.from_json("sanitized_response", kind, {"mode": "PERMISSIVE"}))


def _text(value: Column) -> Column:
    return F.when(F.schema_of_variant(value) == "STRING", value.cast("string"))


def _not_text(value: Column) -> Column:
    return ~F.coalesce(F.schema_of_variant(value), F.lit("VOID")).isin("STRING", "VOID", "NULL")


# A value that is neither quoted nor null, after any key but those of the envelope. The search starts from colons, which are
# rarer than quotes, and leaves at once where a quote follows.
UNQUOTED = r':(?!")(?<=["\s]:)(?<!"(?:response|data|total)":)\s*+[^"\sn]'


def _may_hold_other_values() -> Column:
    """False only where every row value of a body is text or null. An escape could spell
    a key differently, and text that looks like a value counts as one; both only mean
    that a body takes the careful way."""
    body = F.col("sanitized_response")
    return F.contains(body, F.lit("\\u")) | body.rlike(UNQUOTED)


def of_version(log: DataFrame, version_id: str) -> DataFrame:
    """The rows of a landed log that belong to one version; a log may hold several."""
    return log.filter(F.col("version_id") == version_id)


def _body_fault(body: Column, errors: list[Column]) -> Column:
    """Why no row of a body may be taken, or null. A body is refused whole."""
    readable = body["response"]["data"].isNotNull()
    sealed = F.sha2("sanitized_response", 256).eqNullSafe(F.col("response_sha256"))
    return (
        F.when(~readable, F.lit("unreadable_body"))
        .when(reduce(or_, [e.isNotNull() for e in errors]), F.lit("error_member"))
        .when(~sealed, F.lit("response_checksum"))
    )


def page_rows(attempts: DataFrame, spec: GrainSpec) -> DataFrame:
    """Source rows of the successful attempts, as text, duplicates kept.

    A body that cannot be read, reports an error or differs from its checksum gives one row without
    a position, whose ``body_fault`` says why; so a page is never left out without a trace.
    Blank-able fields also say whether their value was something other than text. Bodies
    that hold text alone are parsed as text; only the others pay for VARIANT values.
    """
    names = source_fields(spec)
    optional = [name for name in (spec.label, spec.percent) if name]
    fields = ", ".join([f"`{n}`: string" for n in names] + [f"`{n}_not_text`: boolean" for n in optional])
    body = F.col("sanitized_response")
    plain = F.from_json(body, f"error string, response struct<error: string, data: array<struct<{fields}>>>")
    checked = F.transform(
        F.from_json(body, envelope_type(spec))["response"]["data"],
        lambda r: F.struct(
            *[_text(r[n]).alias(n) for n in names], *[_not_text(r[n]).alias(f"{n}_not_text") for n in optional]
        ),
    )
    own = attempts.filter(successful() & (F.col("dataset") == spec.name)).withColumns(
        {"_mixed": _may_hold_other_values(), "_plain": plain}
    )
    opened = F.col("_plain")
    judged = own.select(
        "version_id", "seq", "_mixed", _body_fault(opened, [opened["error"], opened["response"]["error"]]).alias("body_fault"),
        F.when(F.col("_mixed"), checked).otherwise(opened["response"]["data"]).alias("_data"),
    )
    taken = F.when(F.col("body_fault").isNull(), F.col("_data"))
    rows = judged.select("version_id", "seq", "_mixed", "body_fault", F.posexplode_outer(taken).alias("position", "row"))
    # An accepted page without rows has nothing to say; a refused one has its fault.
    return rows.filter(F.col("position").isNotNull() | F.col("body_fault").isNotNull()).select(
        "version_id", "seq", "position", "body_fault", *[F.col("row")[n].alias(n) for n in names],
        *[(F.col("_mixed") & F.coalesce(F.col("row")[f"{n}_not_text"], F.lit(False))).alias(f"{n}_not_text") for n in optional],
    )


def to_source_text(df: DataFrame, spec: GrainSpec) -> DataFrame:
    """A typed table as source text with unit labels: what a page row carries."""
    names = [*spec.keys, *([spec.label] if spec.label else []), *spec.measures, spec.percent]
    return df.select(
        *[F.col(name).cast("string").alias(name) for name in names],
        *[F.lit(UNITS[name]).alias(f"{name}-units") for name in (*spec.measures, spec.percent)],
    )


def route_counts(attempts: DataFrame) -> DataFrame:
    """Pages, rows and repeated requests of every version's and dataset's log."""
    return attempts.groupBy("version_id", "dataset").agg(
        F.count_if(answered()).alias("pages"),
        F.coalesce(F.sum(F.when(answered(), F.col("actual_row_count"))), F.lit(0)).alias("row_count"),
        F.count_if(F.col("attempt_number") > 1).alias("retries"),
    )


def paging_progress(attempts: DataFrame) -> DataFrame:
    """The offset and attempt number that each request should have had."""
    narrow = attempts.select(
        "version_id", "dataset", "seq", "offset", "attempt_number", answered().alias("_ok"),
        F.when(answered(), F.col("actual_row_count")).otherwise(0).alias("_rows"),
    )
    running = running_before(
        narrow, ["version_id", "dataset"], "seq",
        {"expected_offset": ("sum", F.col("_rows")), "_last_ok": ("max", F.when(F.col("_ok"), F.col("seq")))},
    )
    return running.select(
        "version_id", "dataset", "seq", "offset", "expected_offset", "attempt_number",
        (F.col("seq") - F.coalesce("_last_ok", F.lit(-1))).alias("expected_attempt"),
    )


def attempt_times(attempts: DataFrame) -> DataFrame:
    """Each request beside the end of the one before it, joined on (dataset, seq)."""
    narrow = attempts.select("version_id", "dataset", "seq", "started_at", "completed_at")
    earlier = narrow.select("version_id", "dataset", (F.col("seq") + 1).alias("seq"), F.col("completed_at").alias("previous_end"))
    in_order = (F.col("started_at") <= F.col("completed_at")) & F.coalesce(
        F.col("previous_end") <= F.col("started_at"), F.lit(True)
    )
    return narrow.join(earlier, ["version_id", "dataset", "seq"], "left").withColumn("in_order", in_order)
