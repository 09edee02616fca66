"""Versioned Parquet tables: scan, immutable write, file measurement, manifest."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetgauge.contracts import GRAINS, MANIFEST_SCHEMA, GrainSpec
from fleetgauge.operators.compare import multiset_difference
from fleetgauge.operators.summary import any_rows
from fleetgauge.sources.file_ranges import file_digests

ROW_GROUP_ROWS = 50_000  # fixed value: rows per row group
FILE_ROWS = 20_000_000


def table_path(root: str, spec: GrainSpec) -> str:
    return f"{root}/data/{spec.table}"


def version_path(root: str, spec: GrainSpec, version_id: str) -> str:
    return f"{table_path(root, spec)}/version_id={version_id}"


def scan(spark: SparkSession, spec: GrainSpec, path: str) -> DataFrame:
    """All Parquet parts below ``path`` under the declared schema, never an inferred one."""
    return spark.read.schema(spec.schema).parquet(path)


def scan_versions(spark: SparkSession, spec: GrainSpec, root: str) -> DataFrame:
    """All versions, with ``version_id`` as a partition column that filters can prune."""
    schema = T.StructType([*spec.schema.fields, T.StructField("version_id", T.StringType())])
    return spark.read.schema(schema).parquet(table_path(root, spec)).select("version_id", *spec.schema.names)


def by_range(df: DataFrame, spec: GrainSpec, partitions: int | None = None) -> DataFrame:
    """Rows dealt out by ranges of the key.

    Range partitioning spreads one hot day over several tasks, because the split
    points come from the whole key, and gives every file narrow min/max bounds. The split points
    come from a sample for which ``df`` is worked out once more, so it should be little more than a scan.
    """
    keys = [F.col(k).asc_nulls_last() for k in spec.keys]
    return df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)


def write_ranged(ranged: DataFrame, spec: GrainSpec, path: str, values: Mapping[str, Column] | None = None) -> None:
    """Key-ordered snappy Parquet of rows that ranges of the key dealt out; an existing path is refused, duplicates are kept.

    ``values`` are columns worked out of the sorted rows, so that what they read is moved and sorted instead of them.
    """
    made = values or {}
    (
        ranged.sortWithinPartitions(*[F.col(k).asc_nulls_last() for k in spec.keys])
        .select(*[made.get(name, F.col(name)).alias(name) for name in spec.schema.names])
        .write.mode("errorifexists")
        .option("compression", "snappy")
        .option("maxRecordsPerFile", FILE_ROWS)
        .option("parquet.block.row.count.limit", ROW_GROUP_ROWS)
        .parquet(path)
    )


def write_sorted(
    df: DataFrame, spec: GrainSpec, path: str, partitions: int | None = None, values: Mapping[str, Column] | None = None
) -> None:
    """Key-ordered Parquet of rows in any order."""
    write_ranged(by_range(df, spec, partitions), spec, path, values)


def readback_difference(spark: SparkSession, spec: GrainSpec, path: str, expected: DataFrame) -> DataFrame:
    """Rows whose multiplicity on disk differs from what was meant to be written."""
    return multiset_difference(scan(spark, spec, path), expected.select(*spec.schema.names), list(spec.keys))


def freeze_version(df: DataFrame, spec: GrainSpec, root: str, version_id: str) -> str:
    """Write one new version and read it back; a version directory is never reused."""
    path = version_path(root, spec, version_id)
    write_sorted(df, spec, path)
    if any_rows(readback_difference(df.sparkSession, spec, path, df)):
        raise ValueError("round_trip_values")
    return path


def schema_fingerprint(spec: GrainSpec) -> Column:
    """SHA-256 over the ordered (name, type, nullable) triples of the declared schema."""
    triples = [f"{f.name}:{f.dataType.simpleString()}:{f.nullable}" for f in spec.schema.fields]
    return F.sha2(F.lit(";".join([spec.name, *triples])), 256)


def file_bytes(spark: SparkSession, path: str) -> DataFrame:
    """Name, size and digest of every Parquet file; a large one is streamed, so a task's memory does not grow with it."""
    return file_digests(spark, path, "*.parquet", recursive=True).select(
        F.element_at(F.split("path", "/"), -1).alias("storage_path"), F.col("length").alias("byte_size"), "sha256"
    )


def file_rows(df: DataFrame, spec: GrainSpec) -> DataFrame:
    """Row count, date bounds and required nulls of every file behind a scan."""
    required = [f.name for f in spec.schema.fields if not f.nullable]
    missing = sum((F.count_if(F.col(name).isNull()) for name in required), F.lit(0))
    return df.groupBy(F.col("_metadata.file_name").alias("storage_path")).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min(spec.period).alias("min_period"),
        F.max(spec.period).alias("max_period"),
        missing.alias("required_nulls"),
    )


def overlapping_files(df: DataFrame, spec: GrainSpec) -> DataFrame:
    """How many files start before the file in front of them ends; none in a sorted table.

    The window sees one row per file.
    """
    key = F.struct(*spec.keys)
    bounds = df.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.min(key).alias("low"), F.max(key).alias("high"))
    previous = F.lag("high").over(Window.orderBy("low", "high"))
    return bounds.select((F.col("low") < previous).alias("overlaps")).agg(F.count_if("overlaps").alias("overlapping"))


def measure_version(spark: SparkSession, spec: GrainSpec, root: str, version_id: str) -> DataFrame:
    """Manifest rows of one table of one version, from the files as they are now."""
    path = version_path(root, spec, version_id)
    measured = file_bytes(spark, path).join(file_rows(scan(spark, spec, path), spec), "storage_path", "left")
    return measured.select(
        F.lit(version_id).alias("version_id"),
        F.lit(spec.name).alias("dataset_key"),
        "storage_path",
        "sha256",
        schema_fingerprint(spec).alias("schema_fingerprint"),
        "byte_size",
        F.coalesce("row_count", F.lit(0)).alias("row_count"),
        "min_period",
        "max_period",
        F.coalesce("required_nulls", F.lit(0)).alias("required_nulls"),
    )


def manifest_faults(manifest: DataFrame, start, end, datasets: list[str] | None = None) -> DataFrame:
    """Reasons why a manifest may not be frozen; no rows means it may.

    A file without rows carries no dates, so an empty part written by Spark is allowed
    as long as its table has rows in another file.
    """
    names = datasets or list(GRAINS)
    outside = (F.col("min_period") < F.lit(start)) | (F.col("max_period") > F.lit(end))
    per_file = manifest.select(
        "dataset_key",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(outside, F.lit("file_bounds")),
                    F.when(F.col("byte_size") <= 0, F.lit("file_size")),
                    F.when(F.col("required_nulls") > 0, F.lit("required_null")),
                    F.when(~F.col("sha256").rlike(r"^[0-9a-f]{64}\z"), F.lit("digest")),
                )
            )
        ).alias("reason"),
    )
    repeated = (
        manifest.groupBy("dataset_key", "storage_path").count().filter("count > 1")
        .select("dataset_key", F.lit("repeated_path").alias("reason"))
    )
    expected = manifest.sparkSession.createDataFrame([(n,) for n in names], "dataset_key STRING")
    rows = manifest.groupBy("dataset_key").agg(F.sum("row_count").alias("rows"))
    absent = (
        expected.join(rows, "dataset_key", "left").filter(F.coalesce("rows", F.lit(0)) == 0)
        .select("dataset_key", F.lit("empty_dataset").alias("reason"))
    )
    return per_file.unionByName(repeated).unionByName(absent)


def manifest_digest(manifest: DataFrame) -> DataFrame:
    """One digest for a version: file rows hash alone, then the ordered hashes hash together.

    Only 64-character hashes meet in the final row, one per file.
    """
    columns = MANIFEST_SCHEMA.fieldNames()
    line = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    per_file = manifest.select("version_id", F.struct("dataset_key", "storage_path", line.alias("h")).alias("f"))
    ordered = F.transform(F.array_sort(F.collect_list("f")), lambda f: f["h"])
    return per_file.groupBy("version_id").agg(F.sha2(F.concat_ws("\n", ordered), 256).alias("manifest_sha256"))


def inspect(expected: DataFrame, measured: DataFrame) -> DataFrame:
    """Every file that is missing, extra or changed against a frozen manifest."""
    keys = ["dataset_key", "storage_path"]
    facts = ["sha256", "schema_fingerprint", "byte_size", "row_count", "min_period", "max_period"]
    before = expected.select(*keys, F.struct(*facts).alias("frozen"))
    after = measured.select(*keys, F.struct(*facts).alias("found"))
    state = (
        F.when(F.col("found").isNull(), F.lit("missing"))
        .when(F.col("frozen").isNull(), F.lit("extra"))
        .when(F.col("found") != F.col("frozen"), F.lit("changed"))
    )
    compared = before.join(after, keys, "full_outer").select(*keys, state.alias("state"))
    return compared.filter(F.col("state").isNotNull())
