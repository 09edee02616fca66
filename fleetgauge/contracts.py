"""Grains, table schemas and the two check registries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# The measurement type, units and id/label column names.
MEASURE = T.DecimalType(24, 6)
MEGAWATTS = "MW"
PERCENT = "percent"

PERIOD = "period"


def _field(name: str, kind: T.DataType, nullable: bool, unit: str | None = None) -> T.StructField:
    return T.StructField(name, kind, nullable, {"unit": unit} if unit else None)


def _schema(*ids: str) -> T.StructType:
    fields = [_field(PERIOD, T.DateType(), False)]
    fields += [_field(name, T.StringType(), False) for name in ids]
    if ids:
        fields.append(_field("facilityName", T.StringType(), True))
    fields += [
        _field("capacity", MEASURE, False, MEGAWATTS),
        _field("outage", MEASURE, False, MEGAWATTS),
        _field("percentOutage", MEASURE, True, PERCENT),
    ]
    return T.StructType(fields)


@dataclass(frozen=True)
class GrainSpec:
    """One table: its name, its ordered daily key (the date first) and its measures.

    Every operator takes a spec rather than fixed column names, so the same plan
    serves outage tables and any other table with a daily key.
    """

    name: str
    keys: tuple[str, ...]
    schema: T.StructType | None = None
    label: str | None = None
    measures: tuple[str, ...] = ("capacity", "outage")
    percent: str | None = "percentOutage"

    @property
    def period(self) -> str:
        return self.keys[0]

    @property
    def entity(self) -> tuple[str, ...]:
        return self.keys[1:]

    @property
    def table(self) -> str:
        return f"{self.name}_outages"


NATIONAL = GrainSpec("national", ("period",), _schema())
FACILITY = GrainSpec("facility", ("period", "facility"), _schema("facility"), "facilityName")
GENERATOR = GrainSpec(
    "generator", ("period", "facility", "generator"), _schema("facility", "generator"), "facilityName"
)
GRAINS = {spec.name: spec for spec in (NATIONAL, FACILITY, GENERATOR)}

# The registries of required checks and diagnostics, with scopes.
ALL = "all"
_EACH = ("national", "facility", "generator")
_WITH_IDS = ("facility", "generator")
REQUIRED_SCOPES = {
    "V01": _EACH, "V02": _EACH, "V03": _EACH, "V04": (ALL,),
    "V05": (ALL,), "V06": (ALL,), "V07": (ALL,), "V08": _EACH,
}
DIAGNOSTIC_SCOPES = {
    "D01": _WITH_IDS, "D02": _EACH, "D03": _EACH, "D04": _EACH, "D05": _EACH,
    "D06": _EACH, "D07": _WITH_IDS, "D08": _EACH, "D09": ("facility",),
}
INFORMATIONAL = ("D07", "D08", "D09")
# The messages, and the column names of logs, results and manifests below.
DIAGNOSTIC_MESSAGES = {
    "D01": "Facility label is missing.",
    "D02": "Source percentage is missing.",
    "D03": "Outage is negative.",
    "D04": "Outage exceeds capacity.",
    "D05": "Source percentage is outside 0 to 100.",
    "D06": "Source and computed percentages differ beyond the threshold.",
    "D07": "Entity membership changed.",
    "D08": "Reported capacity changed.",
    "D09": "Facility advertised total differs from the returned row count.",
}
REQUIRED_PAIRS = [(code, scope) for code, scopes in REQUIRED_SCOPES.items() for scope in scopes]
DIAGNOSTIC_PAIRS = [(code, scope) for code, scopes in DIAGNOSTIC_SCOPES.items() for scope in scopes]

# Range presets in days, and the request bounds.
PRESET_DAYS = {"30d": 30, "90d": 90, "1y": 365}
MAX_RANGE_DAYS = 366
MAX_PREVIEW_ROWS = 1000
MAX_CHOICES = 100
MAX_SQL_ROWS = 1000

_TYPES = {
    "string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "date": T.DateType(),
    "boolean": T.BooleanType(), "time": T.TimestampNTZType(), "strings": T.ArrayType(T.StringType()),
}


def _columns(**kinds: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in kinds.items()])


ATTEMPT_SCHEMA = _columns(
    version_id="string", dataset="string", seq="long", offset="long", requested_length="long",
    attempt_number="long", started_at="time", completed_at="time", http_status="int",
    api_status="string", api_version="string", advertised_total="string", actual_row_count="long",
    error_code="string", sanitized_response="string", response_sha256="string",
)
ROUTE_SCHEMA = _columns(
    version_id="string", dataset="string", route="string", requested_start="date", requested_end="date",
    frequency="string", sort_fields="strings", pages_fetched="long", records_fetched="long", retries="long",
    final_status="string", error_code="string", started_at="time", completed_at="time",
)
CHECK_SCHEMA = _columns(
    check_code="string", dataset_key="string", required="boolean", severity="string", status="string",
    checked_count="long", failed_count="long", details_hash="string",
)
MANIFEST_SCHEMA = _columns(
    version_id="string", dataset_key="string", storage_path="string", sha256="string",
    schema_fingerprint="string", byte_size="long", row_count="long", min_period="date", max_period="date",
)
PUBLICATION_SCHEMA = _columns(
    event_id="string", version_id="string", run_seq="long", coverage_start="date", coverage_end="date",
    latest_observation_date="date", published_at="time", mode="string",
)
BOUND_CHECK_SCHEMA = T.StructType(
    [
        *CHECK_SCHEMA.fields, T.StructField("checked_at", T.TimestampType()),
        T.StructField("manifest_sha256", T.StringType()),
        T.StructField("version_id", T.StringType()), T.StructField("attempt_id", T.StringType()),
    ]
)
RECEIPT_SCHEMA = _columns(
    receipt_id="string", predecessor="string", version_id="string", attempt_id="string", run_seq="long",
    coverage_start="date", coverage_end="date", manifest_sha256="string", results_sha256="string", status="string",
    warning_count="long", warning_digest="string", approval_required="boolean",
)


def severity(code: str) -> str:
    if code in REQUIRED_SCOPES:
        return "required"
    return "info" if code in INFORMATIONAL else "warning"
