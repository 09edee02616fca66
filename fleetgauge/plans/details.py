"""Which rows failed a check: a store of failures, one partition for each version, attempt, job and code.

A job judges the rows of a check once. The rows that fail go to the store in the same pass in which the checked and
failed rows are counted and the digest of the failures is added up (as observed metrics of the write), so the
table is not read again to explain a result. The observed metrics stand after the last shuffle of a job, where a
repeated task counts once. A result carries the digest of its stored rows, and the store can be held against
its results in any later session (:func:`digests`).

A digest of a set of rows is a count and four sums; those of two sets add up to that of both.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetgauge.contracts import ALL, CHECK_SCHEMA, DIAGNOSTIC_SCOPES, GRAINS, MEASURE, REQUIRED_SCOPES, GrainSpec, severity
from fleetgauge.functions.digests import SLICES, digest_parts, digest_sums, row_digest
from fleetgauge.functions.exact import TOTAL
from fleetgauge.operators.adjacency import day_pairs, member_change, member_changed, pair_counts, value_changed
from fleetgauge.operators.compare import comparisons, joined_sums, stacked
from fleetgauge.plans.diagnostics import reasons, row_conditions
from fleetgauge.session import settle, together

KEYS = ("period", "facility", "generator")
FIELDS = {
    "dataset_key": T.StringType(), "kind": T.StringType(), "dataset": T.StringType(), "period": T.DateType(),
    "facility": T.StringType(), "generator": T.StringType(), "measure": T.StringType(), "copies": T.LongType(),
    "capacity": MEASURE, "outage": MEASURE, "percentOutage": MEASURE, "expected": TOTAL, "observed": TOTAL, "note": T.StringType(),
}
BOUND = {"version_id": T.StringType(), "attempt_id": T.StringType(), "job": T.StringType(), "check_code": T.StringType()}
DETAIL_SCHEMA = T.StructType([T.StructField(n, t) for n, t in {**FIELDS, **BOUND}.items()])
# All columns that digests read; each check's own stand in this order.
READ = ("dataset", "kind", "period", "facility", "generator", "measure", "copies", "expected", "observed", "capacity", "outage", "percentOutage")
ROW_CODES = ("D01", "D02", "D03", "D04", "D05", "D06")
CHANGE_CODES, GROUP_CODES = ("D07", "D08"), ("V05", "V06")
JOBS = (("V03",), ("V04",), GROUP_CODES, ("V07",), ROW_CODES, CHANGE_CODES)  # codes that are judged in one pass
AFFECTED, NOT_APPLICABLE = "affected", "not_applicable"


def digest_columns(code: str, scope: str) -> list[str]:
    """What a failure of a check is made of, in the order in which its digest reads it."""
    if code == "V04":
        return ["dataset", "kind", "period"]
    if code == "V05":
        return ["kind", "period", "facility"]
    if code in ("V06", "V07"):
        return ["kind", "period", "facility", "measure", "expected", "observed"]
    keys = list(GRAINS[scope].keys)
    if code == "V03":
        return [*keys, "copies"]
    # Changes show the value of the day before and of the day.
    return [*keys, "expected", "observed"] if code in ("D07", "D08") else [*keys, "capacity", "outage", "percentOutage"]


def _filled(names: Mapping[str, Column]) -> list[Column]:
    return [names[n].cast(t).alias(n) if n in names else F.lit(None).cast(t).alias(n) for n, t in FIELDS.items()]


@dataclass(frozen=True)
class DetailStore:
    """Failures of one attempt to check one version, below ``path``."""

    spark: SparkSession
    path: str
    version_id: str
    attempt_id: str

    def save(self, failures: DataFrame, job: str) -> None:
        """Write rows of (check_code, *FIELDS). Each job has a folder of its own, so jobs may run at the same time, and
        none is written twice."""
        folder = f"{self.path}/version_id={self.version_id}/attempt_id={self.attempt_id}/job={job}"
        failures.select(*FIELDS, "check_code").write.mode("errorifexists").partitionBy("check_code").parquet(folder)

    def rows(self, code: str | None = None) -> DataFrame:
        """What was stored, read by partition."""
        try:
            stored = self.spark.read.schema(DETAIL_SCHEMA).parquet(self.path)
        except Exception as error:  # nothing has failed yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
            stored = self.spark.createDataFrame([], DETAIL_SCHEMA)
        own = stored.filter((F.col("version_id") == self.version_id) & (F.col("attempt_id") == self.attempt_id))
        return own if code is None else own.filter(F.col("check_code") == code)


def result(code: str, scope: str, checked: int, failed: int, digest: str | None, error: bool = False) -> tuple:
    """A result row from counts; a check that could not be judged counts nothing."""
    status = "error" if error else "fail" if failed else "pass"
    counts = (0, 0, None) if error else (checked, failed, digest)
    return (code, scope, code in REQUIRED_SCOPES, severity(code), status, *counts)


def _sealed(prefix: str, condition: Column, digest: str = "_digest") -> list[Column]:
    return [c.alias(f"{prefix}_{i}") for i, c in enumerate(digest_sums(condition, digest))]


def _seal(found: Mapping[str, int], prefix: str) -> tuple[int, str]:
    """Failures and their digest from observed sums, as :func:`fingerprint` words it."""
    sums = [found[f"{prefix}_{i}"] for i in range(SLICES + 1)]
    return sums[0], hashlib.sha256(":".join(map(str, sums)).encode()).hexdigest()


def _with_parts(judged: DataFrame, digest: Column, prefix: str = "_part") -> DataFrame:
    """The parts of a row's digest as numbers, worked out once a row however many sums read them."""
    named = judged.withColumn("_digest", digest)
    return named.withColumns({f"{prefix}{i}": part for i, part in enumerate(digest_parts("_digest"))}).drop("_digest")


def _sums(prefix: str, condition: Column, parts: str = "_part") -> list[Column]:
    """What :func:`digest_sums` says of a digest, from its parts."""
    sums = [F.coalesce(F.sum(F.when(condition, F.col(f"{parts}{i}"))), F.lit(0)) for i in range(SLICES)]
    return [c.alias(f"{prefix}_{i}") for i, c in enumerate([F.count_if(condition), *sums])]


def _mark(when: Column, code: str, kind: str | Column) -> Column:
    named = F.lit(kind) if isinstance(kind, str) else kind
    return F.when(when, F.struct(F.lit(code).alias("check_code"), named.alias("kind")))


def _marked(store: DetailStore, job: str, judged: DataFrame, metrics: list[Column], marks: list[Column], values: Mapping[str, Column]) -> dict[str, int]:
    """Write a failure for each mark that a judged row has, and return the metrics of the same pass.

    Rows without a mark end before anything is made of them, and only marks are put into an array: arrays of whole
    failures are worked out without compiled code, field by field for every judged row.
    """
    seen = Observation()
    some = reduce(lambda a, b: a | b, [m.isNotNull() for m in marks])
    each = judged.observe(seen, *metrics).filter(some).withColumn("_mark", F.explode(F.array(*marks))).filter("_mark is not null")
    names = {"kind": F.col("_mark.kind"), **values}
    store.save(each.select(F.col("_mark.check_code").alias("check_code"), *_filled(names)), job)
    return seen.get


def _observed(store: DetailStore, job: str, judged: DataFrame, metrics: list[Column], failures: Column) -> dict[str, int]:
    """Write ``failures`` (an array of structs) of the judged rows, and return the metrics of the same pass."""
    seen = Observation()
    store.save(judged.observe(seen, *metrics).select(F.inline(F.array_compact(failures))), job)
    return seen.get


def _failure(when: Column, code: str | Column, scope: str, kind: str | Column, **columns: Column) -> Column:
    known = {"dataset_key": F.lit(scope), "kind": F.lit(kind) if isinstance(kind, str) else kind, **columns}
    named = F.lit(code) if isinstance(code, str) else code
    return F.when(when, F.struct(named.alias("check_code"), *_filled(known)))


# --- required checks ---------------------------------------------------------------


def repeated_keys(store: DetailStore, df: DataFrame, profiled: DataFrame, spec: GrainSpec) -> list[tuple]:
    """V03. The profile says which (day, first entity) groups hold surplus rows; only rows of those are counted by key again."""
    facts = profiled.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n"), F.coalesce(F.sum("surplus"), F.lit(0)).alias("bad")).first()
    first = list(spec.keys[:2])
    groups = profiled.filter("surplus > 0").select(*first)
    per_key = df.join(groups, first, "left_semi").groupBy(*spec.keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    if not facts["bad"]:
        per_key = per_key.limit(0)
    judged = per_key.withColumn("_digest", row_digest(digest_columns("V03", spec.name)))
    keys = {k: F.col(k) for k in spec.keys}
    found = _observed(
        store, f"keys-{spec.name}", judged, _sealed("v03", F.lit(True)),
        F.array(_failure(F.lit(True), "V03", spec.name, "repeated", copies=F.col("copies"), **keys)),
    )
    return [result("V03", spec.name, facts["n"], facts["bad"], _seal(found, "v03")[1])]


def missing_and_extra_days(store: DetailStore, profiles: Mapping[str, DataFrame], window: DataFrame) -> list[tuple]:
    """V04: a row for each day that a table lacks, has beyond the window, or (national) has more than once."""
    parts = []
    for name, df in profiles.items():
        per_day = df.groupBy("period").agg(F.sum("rows").alias("copies"))
        both = window.select("period", F.lit(True).alias("wanted")).join(per_day, "period", "full_outer")
        again = (F.col("copies") > 1) if name == "national" else F.lit(False)
        kind = F.when(F.col("copies").isNull(), F.lit("missing")).when(F.col("wanted").isNull(), F.lit("extra"))
        kinds = F.array_compact(F.array(kind, F.when(F.coalesce(again, F.lit(False)), F.lit("repeated"))))
        parts.append(both.select(F.lit(name).alias("dataset"), "period", "copies", F.explode(kinds).alias("kind")))
    days = reduce(lambda a, b: a.unionByName(b), parts).withColumn("_digest", row_digest(digest_columns("V04", ALL)))
    found = _observed(
        store, "days", days,
        [*_sealed("v04", F.lit(True)), *[F.count_if(F.col("dataset") == name).alias(name) for name in profiles]],
        F.array(_failure(F.lit(True), "V04", ALL, F.col("kind"), dataset=F.col("dataset"), period=F.col("period"), copies=F.col("copies"))),
    )
    return [result("V04", ALL, len(profiles), sum(found[name] > 0 for name in profiles), _seal(found, "v04")[1])]


def _compared(code: str, kind: Column, keys: Iterable[str]) -> Column:
    return _failure(
        F.col("status") != "match", code, ALL, kind, measure=F.col("measure"), expected=F.col("left_value"),
        observed=F.col("right_value"), note=F.col("status"), **{k: F.col(k) for k in keys},
    )


def facility_groups(store: DetailStore, generator: DataFrame, facility: DataFrame) -> list[tuple]:
    """V05 and V06: groups on one side, and sums that differ, from one join of the profiles."""
    keys = ["period", "facility"]
    joined = joined_sums(facility, generator, keys)
    sides = F.when(~F.col("in_right"), F.lit("missing_generator")).when(~F.col("in_left"), F.lit("missing_facility"))
    # One row for each group and measure; a group on one side is told at its first measure.
    rows = comparisons(joined.withColumn("side", sides), [*keys, "side"], "generator_to_facility")
    first = F.col("measure") == "capacity"
    one_sided = first & F.col("side").isNotNull()
    bad = F.col("status") != "match"
    group = F.when(one_sided, _digest_of({"kind": F.col("side"), **{k: F.col(k) for k in keys}}, "V05"))
    differing = F.when(bad, _digest_of(
        {"kind": F.col("comparison"), "expected": F.col("left_value"), "observed": F.col("right_value"),
         **{k: F.col(k) for k in [*keys, "measure"]}}, "V06"))
    judged = _with_parts(_with_parts(rows, group, "_group"), differing, "_sum")
    compared = F.col("_mark.check_code") == "V06"
    told = {"measure": "measure", "expected": "left_value", "observed": "right_value", "note": "status"}
    found = _marked(
        store, "groups", judged,
        [F.count(F.lit(1)).alias("n"), F.count_if(first).alias("groups"), *_sums("v05", one_sided, "_group"), *_sums("v06", bad, "_sum")],
        [_mark(one_sided, "V05", F.col("side")), _mark(bad, "V06", F.col("comparison"))],
        {"dataset_key": F.lit(ALL), **{k: F.col(k) for k in keys}, **{n: F.when(compared, F.col(c)) for n, c in told.items()}},
    )
    (lone, lone_digest), (unequal, unequal_digest) = _seal(found, "v05"), _seal(found, "v06")
    return [result("V05", ALL, found["groups"], lone, lone_digest), result("V06", ALL, found["n"], unequal, unequal_digest)]


def national_sums(store: DetailStore, national: DataFrame, facility: DataFrame, generator: DataFrame) -> list[tuple]:
    """V07: what facilities and generators add up to against the national row, day by day."""
    families = [
        comparisons(joined_sums(national, child, ["period"]), ["period"], f"{name}_to_national")
        for name, child in (("facility", facility), ("generator", generator))
    ]
    bad = F.col("status") != "match"
    names = {"kind": F.col("comparison"), "expected": F.col("left_value"), "observed": F.col("right_value"), "period": F.col("period"), "measure": F.col("measure")}
    judged = stacked(families, ["period"]).withColumn("_digest", F.when(bad, _digest_of(names, "V07")))
    found = _observed(
        store, "national-sums", judged, [F.count(F.lit(1)).alias("n"), *_sealed("v07", bad)], F.array(_compared("V07", F.col("comparison"), ["period"]))
    )
    failed, digest = _seal(found, "v07")
    return [result("V07", ALL, found["n"], failed, digest)]


# --- diagnostics -------------------------------------------------------------------


def row_failures(store: DetailStore, df: DataFrame, spec: GrainSpec) -> list[tuple]:
    """D01–D06 of a table in one pass without a shuffle; rows that D06 cannot judge are stored with the reasons."""
    conditions = row_conditions(spec)
    columns = [*spec.keys, *spec.measures, "percentOutage"]
    # Words joined without those that are null; no word means that D06 can judge the row.
    judged = df.select(*columns, F.concat_ws(",", *reasons()).alias("_reasons"), *[c.alias(code) for code, c in conditions.items()])
    affected = reduce(lambda a, b: a | b, [F.col(code) for code in conditions])
    # All rows are counted between the conditions and the digests, so that the two are compiled apart and few rows reach the second.
    total = Observation()
    judged = judged.observe(total, F.count(F.lit(1)).alias("n")).filter(affected | (F.col("_reasons") != ""))
    judged = _with_parts(judged, F.when(affected, row_digest(columns)))
    marks = [_mark(F.col(code), code, AFFECTED) for code in conditions]
    if "D06" in conditions:
        marks.append(_mark(F.col("_reasons") != "", "D06", NOT_APPLICABLE))
    note = F.when(F.col("_mark.kind") == NOT_APPLICABLE, F.col("_reasons"))
    metrics = [m for code in conditions for m in _sums(code, F.col(code))]
    values = {"dataset_key": F.lit(spec.name), **{c: F.col(c) for c in columns}, "note": note}
    found = _marked(store, f"rows-{spec.name}", judged, metrics, marks, values)
    return [result(code, spec.name, total.get["n"], *_seal(found, code)) for code in conditions]


def change_failures(store: DetailStore, df: DataFrame, spec: GrainSpec, start: Column, end: Column) -> list[tuple]:
    """D07 and D08 from one aggregation over pairs of days."""
    wanted = {code for code in ("D07", "D08") if spec.name in DIAGNOSTIC_SCOPES[code]}
    pairs = day_pairs(df, spec, "capacity", start, end)
    columns = [*spec.keys, "previous_value", "value"]
    pairs = _with_parts(pairs, F.when(member_changed() | value_changed(), row_digest(columns)))
    values = {
        "dataset_key": F.lit(spec.name), **{k: F.col(k) for k in spec.keys}, "expected": F.col("previous_value"), "observed": F.col("value"),
    }
    both = {"D07": _mark(member_changed(), "D07", member_change()), "D08": _mark(value_changed(), "D08", "changed")}
    metrics = [*pair_counts(), *_sums("D07", member_changed()), *_sums("D08", value_changed())]
    found = _marked(store, f"changes-{spec.name}", pairs, metrics, [m for code, m in both.items() if code in wanted], values)
    rows = []
    if "D07" in wanted:
        rows.append(result("D07", spec.name, found["membership_checked"], *_seal(found, "D07")))
    if "D08" in wanted:
        rows.append(result("D08", spec.name, found["value_checked"], *_seal(found, "D08"), error=found["repeated"] > 0))
    return rows


# --- reading back ------------------------------------------------------------------


def _digest_of(names: Mapping[str, Column], code: str) -> Column:
    """The digest of a failure from expressions, as it will be from the stored columns."""
    typed = [names[c].cast(FIELDS[c]) if c in names else F.lit(None) for c in digest_columns(code, ALL)]
    return F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("-")) for c in typed]), 256)


def digests(stored: DataFrame, pairs: Iterable[tuple[str, str]]) -> DataFrame:
    """(check_code, dataset_key, failures, details_hash) of stored failures, for all ``pairs``, those without failures too."""
    spark = stored.sparkSession
    pairs = list(pairs)
    # A column that a check does not read is null, and left out. A branch for each pair, with a text of its own, makes one
    # method that is too large to be compiled to machine code.
    used = {c: [f"{code}:{scope}" for code, scope in pairs if c in digest_columns(code, scope)] for c in READ}
    texts = [
        F.when(F.col("_pair").isin(names), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c, names in used.items() if names
    ]
    digest = F.sha2(F.concat_ws("|", *texts), 256)
    stored = stored.withColumn("_pair", F.concat_ws(":", "check_code", "dataset_key"))
    sums = [c.alias(f"s{i}") for i, c in enumerate(digest_sums(F.lit(True)))]
    per_pair = stored.filter(F.col("kind") != NOT_APPLICABLE).withColumn("_digest", digest).groupBy("check_code", "dataset_key").agg(*sums)
    asked = spark.createDataFrame(pairs, "check_code string, dataset_key string")
    whole = [F.coalesce(f"s{i}", F.lit(0)) for i in range(SLICES + 1)]
    return asked.join(per_pair, ["check_code", "dataset_key"], "left").select(
        "check_code", "dataset_key", whole[0].alias("failures"), F.sha2(F.concat_ws(":", *whole), 256).alias("details_hash")
    )


def eligible(stored: DataFrame, results: DataFrame) -> DataFrame:
    """How many rows D06 could judge, by table: those checked but for the stored ones that it could not."""
    open_ = stored.filter((F.col("check_code") == "D06") & (F.col("kind") == NOT_APPLICABLE)).groupBy("dataset_key").agg(F.count(F.lit(1)).alias("open"))
    return results.filter("check_code = 'D06'").join(open_, "dataset_key", "left").select(
        "dataset_key", (F.col("checked_count") - F.coalesce("open", F.lit(0))).alias("eligible_count")
    )


def as_results(spark: SparkSession, rows: Iterable[tuple]) -> DataFrame:
    return spark.createDataFrame(list(rows), CHECK_SCHEMA)


def check_tables(
    store: DetailStore, tables: Mapping[str, DataFrame], window: DataFrame, start: Column, end: Column,
    codes: Iterable[str] | None = None, profiles: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """V03–V07 and D01–D08 of the three tables: failures to the store, results back.

    With ``codes``, jobs that judge none of them are left out; each of the others stores all that it judges (``JOBS``).
    ``profiles`` holds those already stored, and takes up the new ones. Jobs that do not wait for each other run at the same time.
    """
    from fleetgauge.plans.checks import profile

    asked = None if codes is None else set(codes)
    wanted = lambda *own: asked is None or not asked.isdisjoint(own)
    known = {} if profiles is None else profiles

    def store_profile(name: str) -> list[tuple]:
        known[name] = settle(profile(tables[name], GRAINS[name]), "profile")
        return []

    read = set(GRAINS) if wanted("V03", "V04", "V07") else {"facility", "generator"} if wanted(*GROUP_CODES) else set()
    jobs = [partial(store_profile, name) for name in GRAINS if name in read - set(known)]
    if wanted(*CHANGE_CODES):
        jobs += [partial(change_failures, store, tables[name], spec, start, end) for name, spec in GRAINS.items()]
    if wanted(*ROW_CODES):
        jobs += [partial(row_failures, store, tables[name], spec) for name, spec in GRAINS.items()]
    rows = together(jobs)
    jobs = []
    if wanted("V03"):
        jobs += [partial(repeated_keys, store, tables[name], known[name], spec) for name, spec in GRAINS.items()]
    if wanted("V04"):
        jobs.append(partial(missing_and_extra_days, store, {name: known[name] for name in GRAINS}, window))
    if wanted(*GROUP_CODES):
        jobs.append(partial(facility_groups, store, known["generator"], known["facility"]))
    if wanted("V07"):
        jobs.append(partial(national_sums, store, known["national"], known["facility"], known["generator"]))
    return as_results(store.spark, [row for found in rows + together(jobs) for row in found])
