"""Digests of a version by ranges of its file names, and of these ranges in turn.

A leaf covers the files of a table whose names' hashes begin alike; a node covers the sixteen below it; the root covers the tables.
Leaves are sums, so no task holds the files of a range, and no row but a leaf's sums is made of more than sixteen
entries (the root: of one a table). Two versions, or a manifest and what is stored now, are compared from the root
down: only ranges that differ are opened, and only files in differing leaves are compared one by one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.functions.digests import fingerprint, row_digest
from fleetgauge.sources.parquet import inspect

DEPTH = 2  # hex digits of the hash of a name: 256 leaves a table; one more for every sixteen times as many files
FACTS = ("storage_path", "sha256", "schema_fingerprint", "byte_size", "row_count", "min_period", "max_period")


def prefix(depth: int) -> Column:
    return F.substring(F.sha2("storage_path", 256), 1, depth)


def _joined(children: Column) -> Column:
    """Digest over at most sixteen (prefix, digest) pairs, in order."""
    lines = F.transform(F.array_sort(children), lambda c: F.concat(c["name"], F.lit(":"), c["digest"]))
    return F.sha2(F.concat_ws("\n", lines), 256)


def digest_tree(manifest: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(dataset_key, prefix, files, digest) of every node of the tables' trees; a table's own node has the empty prefix."""
    named = manifest.select("dataset_key", prefix(depth).alias("prefix"), row_digest(list(FACTS)).alias("_digest"))
    level = named.groupBy("dataset_key", "prefix").agg(F.count(F.lit(1)).alias("files"), fingerprint(F.lit(True)).alias("digest"))
    levels = [level]
    for size in range(depth - 1, -1, -1):
        child = F.struct(F.col("prefix").alias("name"), "digest")
        level = level.withColumn("above", F.substring("prefix", 1, size)).groupBy("dataset_key", "above").agg(
            F.sum("files").alias("files"), _joined(F.collect_list(child)).alias("digest")
        ).withColumnRenamed("above", "prefix")
        levels.append(level)
    return reduce(lambda a, b: a.unionByName(b), levels)


def root_digest(tree: DataFrame) -> DataFrame:
    """One row: files and digest of a whole version."""
    child = F.struct(F.col("dataset_key").alias("name"), "digest")
    return tree.filter("prefix = ''").agg(F.coalesce(F.sum("files"), F.lit(0)).alias("files"), _joined(F.collect_list(child)).alias("digest"))


def differing_ranges(before: DataFrame, after: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(dataset_key, prefix) of the leaves that differ, found from the tables' nodes down."""

    def differing(size: int) -> DataFrame:
        at = F.length("prefix") == size
        old = before.filter(at).select("dataset_key", "prefix", F.col("digest").alias("old"))
        both = old.join(after.filter(at).select("dataset_key", "prefix", "digest"), ["dataset_key", "prefix"], "full_outer")
        return both.filter(~F.col("old").eqNullSafe(F.col("digest"))).select("dataset_key", "prefix")

    found = differing(0)
    for size in range(1, depth + 1):
        above = found.withColumnRenamed("prefix", "above")
        below = differing(size).withColumn("above", F.substring("prefix", 1, size - 1))
        found = below.join(above, ["dataset_key", "above"], "left_semi").drop("above")
    return found


def differing_files(expected: DataFrame, measured: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Missing, extra and changed files, looked for in differing ranges only."""
    ranges = differing_ranges(digest_tree(expected, depth), digest_tree(measured, depth), depth)

    def inside(manifest: DataFrame) -> DataFrame:
        return manifest.withColumn("prefix", prefix(depth)).join(ranges, ["dataset_key", "prefix"], "left_semi").drop("prefix")

    return inspect(inside(expected), inside(measured))
