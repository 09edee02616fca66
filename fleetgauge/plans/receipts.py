"""Receipts: what was checked, bound together and named by its own content.

A receipt names a version, the attempt that checked it, the manifest of its files and the digest of its result rows, whose own digests cover the
stored failures; its id is the SHA-256 of all that and of the receipt before it. So a receipt, and every
one that follows, fails when a row of what it covers changes.
"""

from __future__ import annotations

import hashlib
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgauge.contracts import BOUND_CHECK_SCHEMA, RECEIPT_SCHEMA
from fleetgauge.functions.digests import fingerprint, row_digest
from fleetgauge.plans import gate

CONTENT = [n for n in RECEIPT_SCHEMA.fieldNames() if n != "receipt_id"]
# What a result row says; when it was said does not matter.
SAID = [n for n in BOUND_CHECK_SCHEMA.fieldNames() if n != "checked_at"]


def has_stored_failures() -> Column:
    """Results whose failures are in the store: V03–V07 and D01–D08 that could be judged."""
    code = F.col("check_code")
    return (code.between("V03", "V07") | code.between("D01", "D08")) & (F.col("status") != "error")


def results_digest(saved: DataFrame) -> str:
    """An order-free digest of the rows of an attempt."""
    return saved.withColumn("_digest", row_digest(SAID)).agg(fingerprint(F.lit(True)).alias("d")).first()["d"]


def content_id(values: dict[str, object]) -> str:
    """The id of a receipt: a line for each field, in the order of the schema."""
    lines = [f"{n}={'-' if values[n] is None else str(values[n]).lower() if isinstance(values[n], bool) else values[n]}" for n in CONTENT]
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def read(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.schema(RECEIPT_SCHEMA).parquet(f"{root}/receipts")
    except Exception as error:  # before the first receipt
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], RECEIPT_SCHEMA)


def issue(saved: DataFrame, root: str, run_seq: int, start: date, end: date, verdict: dict[str, object]) -> str:
    """Add the receipt of one attempt after the one of the run before it; a mixture of attempts or manifests gets none."""
    spark = saved.sparkSession
    if not gate.one_attempt(saved).first()["single"]:
        raise ValueError("Results of one attempt on one version and one manifest, never a mixture")
    bound = saved.select("version_id", "attempt_id", "manifest_sha256").first()
    before = read(spark, root).filter(F.col("run_seq") < run_seq).orderBy(F.col("run_seq").desc(), "receipt_id").limit(1).first()
    values = {
        **bound.asDict(), "predecessor": before and before["receipt_id"], "run_seq": run_seq, "coverage_start": start,
        "coverage_end": end, "results_sha256": results_digest(saved),
        **{n: verdict[n] for n in ("status", "warning_count", "warning_digest", "approval_required")},
    }
    values["receipt_id"] = content_id(values)
    row = [tuple(values[n] for n in RECEIPT_SCHEMA.fieldNames())]
    spark.createDataFrame(row, RECEIPT_SCHEMA).write.mode("append").parquet(f"{root}/receipts")
    return values["receipt_id"]


def faults(chain: DataFrame) -> DataFrame:
    """(receipt_id, problem) of receipts whose content is not what their id says, or that do not follow the one they name.

    Joined receipt by receipt; a chain of any length is checked at once.
    """
    lines = [F.concat(F.lit(f"{n}="), F.coalesce(F.col(n).cast("string"), F.lit("-"))) for n in CONTENT]
    text = F.concat_ws("\n", *lines)
    before = chain.select(F.col("receipt_id").alias("predecessor"), F.col("run_seq").alias("earlier")).distinct()
    first = chain.agg(F.min("run_seq").alias("first"))
    followers = chain.groupBy("predecessor").agg(F.countDistinct("run_seq").alias("followers"))
    linked = chain.join(before, "predecessor", "left").join(followers, "predecessor", "left").withColumn("first", first.scalar())
    problems = F.array_compact(
        F.array(
            F.when(F.sha2(text, 256) != F.col("receipt_id"), F.lit("content")),
            F.when(F.col("predecessor").isNull() & (F.col("run_seq") != F.col("first")), F.lit("unlinked")),
            F.when(F.col("predecessor").isNotNull() & F.col("earlier").isNull(), F.lit("predecessor_absent")),
            F.when(F.col("earlier") >= F.col("run_seq"), F.lit("order")),
            F.when(F.col("predecessor").isNotNull() & (F.col("followers") > 1), F.lit("fork")),
        )
    )
    return linked.select("receipt_id", F.explode(problems).alias("problem"))

