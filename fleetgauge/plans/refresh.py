"""From landed pages to a published version."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgauge.contracts import ALL, DIAGNOSTIC_SCOPES, FACILITY, GRAINS, MANIFEST_SCHEMA, GrainSpec
from fleetgauge.functions.dates import calendar
from fleetgauge.functions.parsing import accepted, normalize, refused
from fleetgauge.operators.summary import any_rows
from fleetgauge.plans import checks, details, diagnostics, gate, receipts
from fleetgauge.plans.details import DetailStore, as_results
from fleetgauge.plans.outcomes import evaluate, union
from fleetgauge.session import settle, together
from fleetgauge.sources import history
from fleetgauge.sources.pages import of_version, page_rows
from fleetgauge.sources.parquet import (
    freeze_version,
    inspect,
    manifest_digest,
    manifest_faults,
    measure_version,
    scan,
    version_path,
)


ROW_CODES = ("D01", "D02", "D03", "D04", "D05", "D06")
CHANGE_CODES = ("D07", "D08")


@dataclass(frozen=True)
class Window:
    start: date
    end: date


class Refused(ValueError):
    """A stage that may not continue; the stage's own rows say why."""


def write_version(
    spark: SparkSession, attempts: DataFrame, root: str, version_id: str, window: Window
) -> DataFrame:
    """Parse every landed page of the version, write the three tables and freeze their manifest."""
    attempts = of_version(attempts, version_id)

    def write_table(spec: GrainSpec) -> DataFrame:
        typed = settle(normalize(page_rows(attempts, spec), spec), "normalized")
        bad = refused(typed).groupBy("error_code", "error_field").count().limit(1).collect()
        if bad:
            raise Refused(f"{spec.name}: {bad[0]['error_code']} in {bad[0]['error_field']}")
        freeze_version(accepted(typed, spec), spec, root, version_id)
        return settle(measure_version(spark, spec, root, version_id), "measured")

    measured = union(together(partial(write_table, spec) for spec in GRAINS.values()))
    if any_rows(manifest_faults(measured, window.start, window.end)):
        raise Refused("manifest")
    frozen = measured.select(*MANIFEST_SCHEMA.fieldNames())
    frozen.coalesce(1).write.mode("errorifexists").parquet(f"{root}/manifest/version_id={version_id}")
    return frozen


def read_manifest(spark: SparkSession, root: str, version_id: str) -> DataFrame:
    return spark.read.schema(MANIFEST_SCHEMA).parquet(f"{root}/manifest/version_id={version_id}").withColumn(
        "version_id", F.lit(version_id)
    )


def version_faults(spark: SparkSession, root: str, version_id: str) -> DataFrame:
    """Files of a version that differ from its manifest now."""
    measured = union([measure_version(spark, spec, root, version_id) for spec in GRAINS.values()])
    return inspect(read_manifest(spark, root, version_id), measured)


def run_checks(
    spark: SparkSession, root: str, version_id: str, attempts: DataFrame, routes: DataFrame, window: Window,
    route_names: dict[str, str], store: DetailStore | None = None,
) -> DataFrame:
    """All 16 required checks and 23 diagnostics of one version, one result row each.

    Every job is independent: one that cannot read its input gives ``error`` rows and
    leaves the others alone. With a store, the rows that fail V03–V07 and D01–D08 go there.
    """
    attempts, routes = of_version(attempts, version_id), of_version(routes, version_id)
    tables = {name: scan(spark, spec, version_path(root, spec, version_id)) for name, spec in GRAINS.items()}
    days = calendar(spark, window.start, window.end)
    start, end = F.lit(window.start), F.lit(window.end)
    profiles: dict[str, DataFrame] = {}

    def integrity() -> DataFrame:
        return evaluate(
            spark, [("V08", name) for name in GRAINS], lambda: checks.integrity(version_faults(spark, root, version_id))
        )

    def source(spec: GrainSpec) -> DataFrame:
        """V01, and the advertised-total diagnostic that depends on it."""
        facts: list[DataFrame] = []

        def complete() -> DataFrame:
            found = checks.source_complete(attempts, routes, spec, start, end, route_names[spec.name])
            facts.append(settle(found, "source"))
            return checks.source_outcome(facts[0], spec)

        result = evaluate(spark, [("V01", spec.name)], complete)
        if spec is not FACILITY:
            return result
        return union([result, evaluate(spark, [("D09", spec.name)], lambda: checks.advertised_outcome(facts[0]))])

    def units(spec: GrainSpec) -> DataFrame:
        return evaluate(spark, [("V02", spec.name)], lambda: checks.schema_units(attempts, routes, tables[spec.name], spec))

    def keys(spec: GrainSpec) -> DataFrame:
        def profiled() -> DataFrame:
            profiles[spec.name] = settle(checks.profile(tables[spec.name], spec), "profile")
            if store:
                return as_results(spark, details.repeated_keys(store, tables[spec.name], profiles[spec.name], spec))
            return checks.unique_keys(profiles[spec.name], spec)

        return evaluate(spark, [("V03", spec.name)], profiled)

    def rows(spec: GrainSpec) -> DataFrame:
        codes = [(c, spec.name) for c in ROW_CODES if spec.name in DIAGNOSTIC_SCOPES[c]]
        if store:
            return evaluate(spark, codes, lambda: as_results(spark, details.row_failures(store, tables[spec.name], spec)))
        return evaluate(spark, codes, lambda: diagnostics.row_diagnostics(tables[spec.name], spec))

    def changes(spec: GrainSpec) -> DataFrame:
        codes = [(c, spec.name) for c in CHANGE_CODES if spec.name in DIAGNOSTIC_SCOPES[c]]
        if store:
            return evaluate(spark, codes, lambda: as_results(spark, details.change_failures(store, tables[spec.name], spec, start, end)))
        return evaluate(spark, codes, lambda: diagnostics.change_diagnostics(tables[spec.name], spec, start, end))

    results = together([integrity, *[partial(job, spec) for job in (keys, source, units, rows, changes) for spec in GRAINS.values()]])

    def dates() -> DataFrame:
        own = lambda: {n: profiles[n] for n in GRAINS}
        if store:
            return evaluate(spark, [("V04", ALL)], lambda: as_results(spark, details.missing_and_extra_days(store, own(), days)))
        return evaluate(spark, [("V04", ALL)], lambda: checks.date_coverage(own(), days))

    def members() -> DataFrame:
        codes = [("V05", ALL), ("V06", ALL)]
        if store:
            return evaluate(
                spark, codes, lambda: as_results(spark, details.facility_groups(store, profiles["generator"], profiles["facility"]))
            )
        return evaluate(spark, codes, lambda: checks.cross_grain(profiles["generator"], profiles["facility"]))

    def national() -> DataFrame:
        own = lambda: [profiles[n] for n in ("national", "facility", "generator")]
        if store:
            return evaluate(spark, [("V07", ALL)], lambda: as_results(spark, details.national_sums(store, *own())))
        return evaluate(spark, [("V07", ALL)], lambda: checks.national_reconciliation(*own()))

    # These read the profiles that the jobs above have stored.
    return union(results + together([dates, members, national]))


def verify(
    spark: SparkSession, root: str, version_id: str, saved: DataFrame, receipt: dict[str, object]
) -> list[str]:
    """Recheck a passed version before it is used: files, manifest, results and digest."""
    problems = []
    if not gate.one_attempt(saved).first()["single"]:
        problems.append("binding")
    if any_rows(version_faults(spark, root, version_id)):
        problems.append("files")
    if manifest_digest(read_manifest(spark, root, version_id)).first()["manifest_sha256"] != receipt["manifest_sha256"]:
        problems.append("manifest")
    now = gate.decision(saved).first()
    if now["status"] != "passed":
        problems.append("results")
    for name in ("warning_count", "warning_digest", "approval_required"):
        if now[name] != receipt[name]:
            problems.append(name)
    return problems


def reverify(spark: SparkSession, root: str, version_id: str) -> DataFrame:
    """Hold a version against its newest receipt, from the store alone and in any later session.

    One row (part, problem) for each part that does not bear the receipt out; no rows means that everything does.
    """
    chain = receipts.read(spark, root)
    receipt = chain.filter(F.col("version_id") == version_id).orderBy(F.col("run_seq").desc(), "receipt_id").limit(1).first()
    found: list[tuple[str, str]] = []
    if receipt is None:
        return spark.createDataFrame([("receipt", "absent")], "part string, problem string")
    found += [("receipt", r.problem) for r in receipts.faults(chain).filter(F.col("receipt_id") == receipt.receipt_id).collect()]
    saved = history.attempts_of(spark, f"{root}/check_results", version_id).filter(F.col("attempt_id") == receipt.attempt_id)
    if receipts.results_digest(saved) != receipt.results_sha256:
        found.append(("results", "changed"))
    if saved.filter(~F.col("manifest_sha256").eqNullSafe(F.lit(receipt.manifest_sha256))).limit(1).count() or not gate.one_attempt(saved).first()["single"]:
        found.append(("results", "binding"))
    now = gate.decision(saved).first()
    found += [("gate", name) for name in ("status", "warning_count", "warning_digest", "approval_required") if now[name] != receipt[name]]
    if manifest_digest(read_manifest(spark, root, version_id)).first()["manifest_sha256"] != receipt.manifest_sha256:
        found.append(("manifest", "changed"))
    found += [("files", f"{r.state}:{r.dataset_key}") for r in version_faults(spark, root, version_id).select("state", "dataset_key").distinct().collect()]
    # One row for each pair of the registry.
    judged = {(r.check_code, r.dataset_key): r.details_hash for r in saved.filter(receipts.has_stored_failures()).collect()}
    store = DetailStore(spark, f"{root}/check_details", version_id, receipt.attempt_id)
    for r in details.digests(store.rows(), judged).collect() if judged else []:
        if r.details_hash != judged[r.check_code, r.dataset_key]:
            found.append(("details", f"{r.check_code}:{r.dataset_key}"))
    return spark.createDataFrame(sorted(found), "part string, problem string")


def refresh(
    spark: SparkSession, root: str, version_id: str, attempt_id: str, run_seq: int, attempts: DataFrame,
    routes: DataFrame, window: Window, route_names: dict[str, str], approved: bool = False,
) -> dict[str, object]:
    """Write, check, gate and (where nothing blocks it) publish one version."""
    frozen = write_version(spark, attempts, root, version_id, window)
    manifest = manifest_digest(frozen).first()["manifest_sha256"]
    store = DetailStore(spark, f"{root}/check_details", version_id, attempt_id)
    results = settle(run_checks(spark, root, version_id, attempts, routes, window, route_names, store), "results")
    history.append_checks(results, f"{root}/check_results", version_id, attempt_id, manifest)
    verdict = gate.decision(results).first().asDict()
    receipt = {**verdict, "manifest_sha256": manifest}
    saved = history.attempts_of(spark, f"{root}/check_results", version_id).filter(F.col("attempt_id") == attempt_id)
    receipts.issue(saved, root, run_seq, window.start, window.end, verdict)
    if verdict["status"] != "passed":
        return {**receipt, "published": "not_eligible"}
    problems = verify(spark, root, version_id, saved, receipt)
    if problems:
        raise Refused(",".join(problems))
    if verdict["approval_required"] and not approved:
        return {**receipt, "published": "awaiting_approval"}
    newest = frozen.filter(F.col("dataset_key") == "national").agg(F.max("max_period")).first()[0]
    candidate = history.Candidate(version_id, run_seq, window.start, window.end, newest)
    mode = "approval" if verdict["approval_required"] else "automatic"
    return {**receipt, "published": history.publish(spark, f"{root}/publication_log", candidate, mode)}
