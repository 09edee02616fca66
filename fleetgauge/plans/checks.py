"""Required checks of one version."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.contracts import ALL, GRAINS, GrainSpec
from fleetgauge.functions.exact import TOTAL
from fleetgauge.functions.parsing import normalize
from fleetgauge.operators.compare import comparisons, joined_sums, multiset_difference, stacked
from fleetgauge.operators.summary import by_key, one_row
from fleetgauge.plans.outcomes import outcome, outcomes
from fleetgauge.session import settle
from fleetgauge.sources.pages import answered, open_envelopes, page_rows, successful

# The limits that a request log has to respect.
MAX_PAGE_ROWS = 5000
MAX_ATTEMPTS = 3
RETRYABLE_STATUS = (429, 500, 502, 503, 504)
RETRYABLE_ERRORS = ("timeout", "transport_error")
FREQUENCY = "daily"


def profile(df: DataFrame, spec: GrainSpec) -> DataFrame:
    """Rows, surplus rows and exact sums per (day, first entity id).

    Key uniqueness, dates, membership and every reconciliation read this small table,
    so the base table is scanned and shuffled by its key once for all of them.
    """
    per_key = by_key(df.select(*spec.keys, *spec.measures), list(spec.keys)).groupBy(*spec.keys).agg(
        F.count(F.lit(1)).alias("copies"), *[F.sum(m).cast(TOTAL).alias(m) for m in spec.measures]
    )
    return per_key.groupBy(*spec.keys[:2]).agg(
        F.sum("copies").alias("rows"),
        F.sum(F.col("copies") - 1).alias("surplus"),
        *[F.sum(m).cast(TOTAL).alias(m) for m in spec.measures],
    )


def unique_keys(profiled: DataFrame, spec: GrainSpec) -> DataFrame:
    facts = profiled.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("n"), F.coalesce(F.sum("surplus"), F.lit(0)).alias("bad")
    )
    return outcomes(facts, [outcome("V03", spec.name, F.col("n"), F.col("bad"))])


def date_coverage(tables: dict[str, DataFrame], window: DataFrame) -> DataFrame:
    """Each table's dates against the window; the national grain has one row per date.

    ``tables`` may hold profiles or plain tables: a ``rows`` column is used when present.
    """
    parts = []
    for name, df in tables.items():
        rows = F.sum("rows") if "rows" in df.columns else F.count(F.lit(1))
        per_day = df.groupBy("period").agg(rows.alias("day_rows"))
        both = window.select("period", F.lit(True).alias("wanted")).join(per_day, "period", "full_outer")
        bad = F.col("day_rows").isNull() | F.col("wanted").isNull()
        if name == "national":
            bad = bad | (F.col("day_rows") != 1)
        parts.append(both.agg(F.count_if(bad).alias("defects")))
    defects = reduce(lambda a, b: a.unionByName(b), parts)
    facts = defects.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("defects") > 0).alias("bad"))
    return outcomes(facts, [outcome("V04", ALL, F.col("n"), F.col("bad"))])


def _unequal(measure: str) -> Column:
    left, right = F.col(f"left_{measure}"), F.col(f"right_{measure}")
    return ~F.coalesce(left == right, F.lit(False))


def cross_grain(generator: DataFrame, facility: DataFrame, measures: tuple[str, ...] = ("capacity", "outage")) -> DataFrame:
    """Membership (V05) and reconciliation (V06) from one join of group sums."""
    joined = joined_sums(generator, facility, ["period", "facility"], measures)
    facts = joined.agg(
        F.count(F.lit(1)).alias("groups"),
        F.count_if(~F.col("in_left") | ~F.col("in_right")).alias("one_sided"),
        *[F.count_if(_unequal(m)).alias(f"bad_{m}") for m in measures],
    )
    failed = reduce(lambda a, b: a + b, [F.col(f"bad_{m}") for m in measures])
    return outcomes(
        facts,
        [
            outcome("V05", ALL, F.col("groups"), F.col("one_sided")),
            outcome("V06", ALL, F.col("groups") * len(measures), failed),
        ],
    )


def national_reconciliation(
    national: DataFrame, facility: DataFrame, generator: DataFrame, measures: tuple[str, ...] = ("capacity", "outage")
) -> DataFrame:
    families = [
        comparisons(joined_sums(child, national, ["period"], measures), ["period"], f"{name}_sum_to_national", measures)
        for name, child in (("facility", facility), ("generator", generator))
    ]
    facts = stacked(families, ["period"]).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") != "match").alias("bad")
    )
    return outcomes(facts, [outcome("V07", ALL, F.col("n"), F.col("bad"))])


def integrity(faults: DataFrame) -> DataFrame:
    """V08 of every table over the faults that :func:`fleetgauge.sources.parquet.inspect` found."""
    facts = faults.agg(*[F.count_if(F.col("dataset_key") == name).alias(name) for name in GRAINS])
    return outcomes(facts, [outcome("V08", name, F.lit(1), (F.col(name) > 0).cast("int")) for name in GRAINS])


# --- source completeness -------------------------------------------------------


def _advertised(total: Column) -> tuple[Column, Column]:
    """An advertised total (number or digit text) and whether it is something else."""
    kind = F.coalesce(F.schema_of_variant(total), F.lit("NULL"))
    text = total.cast("string")
    given = ~kind.isin("VOID", "NULL")
    usable = kind.isin("STRING", "BIGINT", "TINYINT", "SMALLINT", "INT") & text.rlike(r"^[0-9]+\z")
    return F.when(usable, text.try_cast("long")), given & ~F.coalesce(usable, F.lit(False))


def attempt_facts(attempts: DataFrame, spec: GrainSpec) -> DataFrame:
    """One narrow row per attempt; the body is read here and left behind."""
    opened = open_envelopes(attempts, spec, keys_only=True)
    body, response = F.col("body"), F.col("body.response")
    rows = F.size(response["data"])
    advertised, unusable = _advertised(response["total"])
    stated = F.col("advertised_total")
    stated_value = F.when(stated.rlike(r"^[0-9]+\z"), stated.try_cast("long"))
    retryable = (F.col("http_status").isin(*RETRYABLE_STATUS) & F.col("error_code").eqNullSafe(F.lit("http_error"))) | (
        F.col("http_status").isNull() & F.col("error_code").isin(*RETRYABLE_ERRORS)
    )
    ok = answered()
    unexpected = (
        ~successful() | body["error"].isNotNull() | response["error"].isNotNull() | (rows > F.col("requested_length"))
        | ~F.col("actual_row_count").eqNullSafe(rows) | ~F.col("api_version").eqNullSafe(body["apiVersion"])
    )
    unreadable = response["data"].isNull() | unusable | (stated.isNotNull() & stated_value.isNull())
    return opened.select(
        "version_id", "dataset", "seq", "offset", "requested_length", "attempt_number", "started_at", "completed_at",
        ok.alias("answered"),
        F.when(ok, rows).otherwise(F.lit(0)).cast("long").alias("rows"),
        F.when(ok, advertised).alias("advertised"),
        F.coalesce(F.sha2("sanitized_response", 256) != F.col("response_sha256"), F.col("sanitized_response").isNotNull() & F.col("response_sha256").isNull()).alias("bad_checksum"),
        (~ok & ~F.coalesce(retryable, F.lit(False))).alias("bad_failure"),
        (ok & F.coalesce(unexpected, F.lit(True))).alias("bad_outcome"),
        (ok & ~advertised.eqNullSafe(stated_value)).alias("bad_total"),
        (ok & F.coalesce(unreadable, F.lit(True))).alias("unreadable"),
    )


def with_predecessor(facts: DataFrame) -> DataFrame:
    """Each attempt next to the one before it, by an equality join on (version, dataset, seq).

    A log is in order when every attempt continues its predecessor, so no window
    over the whole log of one dataset is needed.
    """
    before = facts.select(
        "version_id", "dataset", (F.col("seq") + 1).alias("seq"),
        F.struct("offset", "requested_length", "attempt_number", "completed_at", "answered", "rows").alias("before"),
    )
    return facts.join(before, ["version_id", "dataset", "seq"], "left")


def _progress_fault() -> Column:
    b = F.col("before")
    offset = F.when(b.isNull(), F.lit(0)).otherwise(b["offset"] + b["rows"])
    number = F.when(b.isNull() | b["answered"], F.lit(1)).otherwise(b["attempt_number"] + 1)
    return ~F.coalesce(
        F.col("requested_length").between(1, MAX_PAGE_ROWS)
        & (b.isNull() | (b["requested_length"] == F.col("requested_length")))
        & (F.col("offset") == offset)
        & (F.col("attempt_number") == number)
        & (F.col("attempt_number") <= MAX_ATTEMPTS)
        & ~(b.isNotNull() & b["answered"] & (b["rows"] == 0))
        & (b.isNotNull() | (F.col("seq") == 0)),
        F.lit(False),
    )


def source_complete(attempts: DataFrame, routes: DataFrame, spec: GrainSpec, start: Column, end: Column, route: str) -> DataFrame:
    """V01 facts of one dataset: sorted reasons, rows, advertised total, readability."""
    b = F.col("before")
    # Stored first: the bodies are read once, and both sides of the join are narrow.
    chain = with_predecessor(settle(attempt_facts(attempts, spec), "attempts"))
    late = (F.col("started_at") > F.col("completed_at")) | (b.isNotNull() & (b["completed_at"] > F.col("started_at")))
    seen = chain.agg(
        F.count(F.lit(1)).alias("attempts"),
        F.max("seq").alias("last_seq"),
        F.count_if("answered").alias("pages"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("row_count"),
        F.count_if(b.isNotNull() & ~b["answered"]).alias("retries"),
        F.min("started_at").alias("first_start"),
        F.max("completed_at").alias("last_end"),
        F.max_by(F.col("answered") & (F.col("rows") == 0), "seq").alias("ends_empty"),
        F.max_by("advertised", F.when(F.col("advertised").isNotNull(), F.col("seq"))).alias("advertised_total"),
        F.min("advertised").alias("low_total"),
        F.max("advertised").alias("high_total"),
        F.count_if(F.coalesce(late, F.lit(True))).alias("late"),
        F.count_if(_progress_fault()).alias("progress"),
        *[F.count_if(name).alias(name) for name in ("bad_checksum", "bad_failure", "bad_outcome", "bad_total", "unreadable")],
    )
    opened = open_envelopes(attempts.filter(answered()), spec, keys_only=True)
    keys = opened.select(F.explode("body.response.data").alias("row")).select(
        *[F.col("row")[k].alias(k) for k in spec.keys]
    )
    repeated = keys.groupBy(*spec.keys).agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated"))
    complete = (
        F.col("final_status").eqNullSafe(F.lit("success")) & F.col("error_code").isNull() & (F.col("route") == F.lit(route))
        & (F.col("requested_start") == start) & (F.col("requested_end") == end)
        & (F.col("sort_fields") == F.array(*[F.lit(k) for k in spec.keys]))
    )
    own = routes.filter(F.col("dataset") == spec.name).select(
        complete.alias("route_complete"),
        *[F.col(c).alias(f"route_{c}") for c in ("pages_fetched", "records_fetched", "retries", "started_at", "completed_at")],
    )
    facts = one_row([own, seen, repeated])

    def reason(condition: Column, name: str) -> Column:
        return F.when(F.coalesce(condition, F.lit(True)), F.lit(name))

    reasons = [
        reason(~F.col("route_complete"), "route_not_complete"),
        reason((F.col("late") > 0) | (F.col("route_started_at") > F.col("first_start")) | (F.col("last_end") > F.col("route_completed_at")), "attempt_times"),
        reason((F.col("progress") > 0) | (F.col("attempts") != F.col("last_seq") + 1), "request_progress"),
        reason(F.col("bad_checksum") > 0, "response_checksum"),
        reason(F.col("bad_failure") > 0, "failed_request"),
        reason(F.col("bad_outcome") > 0, "response_outcome"),
        reason(F.col("bad_total") > 0, "total_evidence"),
        F.when(F.col("low_total") != F.col("high_total"), F.lit("unstable_total")),
        reason(F.col("repeated") > 0, "repeated_key"),
        reason(~F.col("ends_empty"), "missing_exhaustion"),
        reason(
            (F.col("route_pages_fetched") != F.col("pages")) | (F.col("route_records_fetched") != F.col("row_count"))
            | (F.col("route_retries") != F.col("retries")), "route_counts",
        ),
    ]
    if spec.name != "facility":
        reasons.append(F.when(F.col("advertised_total") != F.col("row_count"), F.lit("total_mismatch")))
    return facts.select(
        F.lit(spec.name).alias("dataset_key"),
        F.array_sort(F.array_compact(F.array(*reasons))).alias("reasons"),
        "row_count", "pages", "retries", "advertised_total",
        (F.col("unreadable") > 0).alias("unreadable"),
    )


def source_outcome(facts: DataFrame, spec: GrainSpec) -> DataFrame:
    bad = (F.size("reasons") > 0).cast("int")
    return outcomes(facts, [outcome("V01", spec.name, F.lit(1), bad, error=F.col("unreadable"))])


def advertised_outcome(facts: DataFrame) -> DataFrame:
    """D09: information only, and unknown unless the source log itself passed."""
    differs = F.coalesce(F.col("advertised_total") != F.col("row_count"), F.lit(False)).cast("int")
    error = F.col("unreadable") | (F.size("reasons") > 0)
    details = F.concat_ws(":", F.col("advertised_total"), F.col("row_count"))
    return outcomes(facts, [outcome("D09", "facility", F.lit(1), differs, details, error)])


def schema_units(attempts: DataFrame, routes: DataFrame, saved: DataFrame, spec: GrainSpec) -> DataFrame:
    """V02: source rows parsed again equal the saved rows as multisets, at a daily frequency."""
    names = spec.schema.names
    # Refused rows stay in the comparison under their error code: one pass tells both
    # whether a source row could not be read and whether the two sides differ.
    typed = normalize(page_rows(attempts, spec), spec).select(*names, "error_code")
    kept = saved.select(*names, F.lit(None).cast("string").alias("error_code"))
    differing = multiset_difference(typed, kept, list(spec.keys)).agg(
        F.count(F.lit(1)).alias("differing"), F.count("error_code").alias("broken")
    )
    own = attempts.filter(successful() & (F.col("dataset") == spec.name))
    stated = F.from_json("sanitized_response", "response struct<frequency: string>")["response"]["frequency"]
    other = own.agg(F.count_if(~stated.eqNullSafe(F.lit(FREQUENCY))).alias("other"))
    route = routes.filter(F.col("dataset") == spec.name).agg(
        F.count_if(~F.col("frequency").eqNullSafe(F.lit(FREQUENCY))).alias("route_other")
    )
    facts = one_row([differing, other, route])
    bad = (F.col("differing") + F.col("other") + F.col("route_other") > 0).cast("int")
    return outcomes(facts, [outcome("V02", spec.name, F.lit(1), bad, error=F.col("broken") > 0)])


def table_checks(tables: dict[str, DataFrame], window: DataFrame, profiled: bool = False) -> list[DataFrame]:
    """V03–V07 over the three tables (or over their profiles)."""
    p = tables if profiled else {name: profile(df, GRAINS[name]) for name, df in tables.items()}
    return [
        *[unique_keys(p[name], GRAINS[name]) for name in GRAINS],
        date_coverage(p, window),
        cross_grain(p["generator"], p["facility"]),
        national_reconciliation(p["national"], p["facility"], p["generator"]),
    ]


