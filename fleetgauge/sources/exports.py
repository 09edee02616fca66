"""CSV exports and the registry of input files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetgauge.contracts import MEASURE, GrainSpec
from fleetgauge.functions.parsing import is_blank, parse_date
from fleetgauge.operators.summary import duplicate_keys
from fleetgauge.sources.file_ranges import WHOLE_BYTES, file_digests

# Fixed value: number text that an export may hold, exponents included.
NUMBER_TEXT = r"^\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*\z"
DIGITS = r"^\s*[+-]?0*([0-9.]*?)(?:[eE][+-]?[0-9]+)?\s*\z"
FRACTION = r"\.([0-9]*)"
EXPONENT = r"[eE]([+-]?[0-9]+)\s*\z"


def read_export(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """An export as text. A row with missing or extra fields stops the read."""
    schema = T.StructType([T.StructField(name, T.StringType()) for name in columns])
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .option("nullValue", "\u0000")
        .option("emptyValue", "")
        .csv(path)
    )


def check_export(export: DataFrame, spec: GrainSpec) -> DataFrame:
    """Typed rows with the reason (if any) why each one is refused."""
    text = F.trim  # numbers may carry outer spaces
    typed, reasons = {}, []
    for name in spec.keys:
        reasons.append(F.when(is_blank(F.col(name)), F.lit("empty_key")))
        typed[name] = F.col(name)
    typed[spec.period] = parse_date(F.col(spec.period)).value
    reasons.append(F.when(typed[spec.period].isNull(), F.lit("noncanonical_date")))
    for name in (*spec.measures, spec.percent):
        source = F.col(name)
        wide = text(source).try_cast(T.DecimalType(38, 12))
        value = wide.try_cast(MEASURE)
        digits = F.length(F.regexp_replace(F.regexp_extract(source, DIGITS, 1), r"\.", ""))
        # Places after the point as written, moved by the exponent: the text decides, since a cast would round it.
        places = F.length(F.regexp_extract(source, FRACTION, 1)) - F.coalesce(F.regexp_extract(source, EXPONENT, 1).try_cast("int"), F.lit(0))
        fits = source.rlike(NUMBER_TEXT) & (digits <= 24) & (places <= MEASURE.scale) & wide.isNotNull() & (value == wide)
        blank_allowed = is_blank(source) if name == spec.percent else F.lit(False)
        reasons.append(F.when(~blank_allowed & ~F.coalesce(fits, F.lit(False)), F.lit("invalid_number")))
        if name == "capacity":
            reasons.append(F.when(value < 0, F.lit("negative_capacity")))
        typed[name] = F.when(~blank_allowed, value)
    label = {spec.label: F.col(spec.label)} if spec.label and spec.label in export.columns else {}
    return export.select(
        *[column.alias(name) for name, column in {**typed, **label}.items()], F.coalesce(*reasons).alias("refused")
    )


def load_export(spark: SparkSession, path: str, spec: GrainSpec, columns: list[str]) -> DataFrame:
    """A checked export: any refused row, repeated key or an empty file raises."""
    if not {*spec.keys, *spec.measures, spec.percent} <= set(columns):
        raise ValueError(f"{spec.name}: missing CSV columns")
    checked = check_export(read_export(spark, path, columns), spec)
    facts = checked.agg(F.count(F.lit(1)).alias("rows"), F.count("refused").alias("refused"), F.first("refused", True).alias("why")).first()
    if facts["rows"] == 0:
        raise ValueError(f"{spec.name}: empty export")
    if facts["refused"]:
        raise ValueError(f"{spec.name}: {facts['why']} in {facts['refused']} rows")
    if duplicate_keys(checked, list(spec.keys)).limit(1).count():
        raise ValueError(f"{spec.name}: duplicate daily key")
    return checked.drop("refused")


def verify_inputs(spark: SparkSession, folder: str, registry: DataFrame, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """Registry rows (file, role, bytes, sha256) that the folder does not bear out. Files may have any size."""
    found = file_digests(spark, folder, whole_bytes=whole_bytes).select(
        F.element_at(F.split("path", "/"), -1).alias("file"),
        F.struct(F.col("length").alias("bytes"), "sha256").alias("found"),
    )
    expected = registry.select("file", "role", F.struct(F.col("bytes").cast("long").alias("bytes"), "sha256").alias("expected"))
    problem = (
        F.when(F.col("file").contains("/"), F.lit("invalid_name"))
        .when(F.col("found").isNull(), F.lit("missing"))
        .when(F.col("found") != F.col("expected"), F.lit("changed"))
    )
    compared = expected.join(found, "file", "left").select("file", "role", problem.alias("problem"))
    repeated = registry.groupBy("role").count().filter("count > 1").select(
        F.lit(None).cast("string").alias("file"), "role", F.lit("repeated_role").alias("problem")
    )
    return compared.filter(F.col("problem").isNotNull()).unionByName(repeated)
