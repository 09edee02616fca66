"""Outage tables, landed pages and exports derived from the driver's tables.

Values carry anomalies on purpose (missing labels and percentages, negative outage,
outage above capacity, units wholly out, percentages out of range). The facility table leaves out units that report 0 percent and
the national table files no report on the 13th of a month, so that membership,
reconciliation and date checks find something. ``clean`` turns those two off.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetgauge.contracts import FACILITY, GENERATOR, GRAINS, MEASURE, NATIONAL, GrainSpec
from fleetgauge.functions.parsing import UNITS
from fleetgauge.operators.numbering import number_rows, number_sorted_files
from fleetgauge.operators.summary import by_key
from fleetgauge.session import scratch, settle, together
from fleetgauge.sources.pages import NO_ERROR, to_source_text
from fleetgauge.sources.parquet import by_range, scan, write_ranged, write_sorted

API_VERSION = "2.1.0"
FULL, ABOVE, BELOW = 700, 900, 1_100  # quantities, in hundredths, of units wholly out or with a percentage out of range
RETRY_EVERY = 5  # one page in five is answered at the second attempt


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _hundredths(column: str) -> Column:
    """A two-place double as a whole number of hundredths."""
    return F.rint(F.col(column) * 100).cast("long")


def _scaled(total: Column, unit: str) -> Column:
    return (total.cast(T.DecimalType(19, 0)) * F.lit(Decimal(unit))).cast(MEASURE)


def _values() -> dict[str, Column]:
    """Stored values of the whole numbers and codes that move."""
    units = {"capacity": "0.01", "outage": "0.0001", "percentOutage": "0.01"}
    # A null flag makes the whole label null.
    label = F.concat("s_name", F.lit(" "), F.chr(F.col("flag")))
    return {"facilityName": label, **{name: _scaled(F.col(name), unit) for name, unit in units.items()}}


def _units(spark: SparkSession, folder: str) -> DataFrame:
    """Unit days keyed by numbers. Sums are sums of longs (whole hundredths and
    ten-thousandths) and the label stays a character code; decimals appear where tables are written.
    Few units have a second line on a day, so lines move as they are and are aggregated where they
    arrive: a task's table of units is that of one shuffle partition, whose size adaptive execution bounds."""
    lines = table(spark, folder, "lineitem")
    quantity, discount, tax = _hundredths("l_quantity"), _hundredths("l_discount"), _hundredths("l_tax")
    flag = F.ascii("l_returnflag")
    returned, unflagged = F.lit(ord("R")), F.lit(ord("N"))
    narrow = lines.select(
        F.to_date("l_shipdate").alias("period"), "l_suppkey", "l_partkey",
        flag.alias("flag"), quantity.alias("q"), discount.alias("d"), tax.alias("t"),
    )
    keys = ["period", "l_suppkey", "l_partkey"]
    grouped = (
        by_key(narrow, keys).groupBy(*keys)
        .agg(
            F.max(F.when(F.col("flag") != unflagged, F.col("flag"))).alias("flag"),
            F.sum(F.when((F.col("q") == 5000) & (F.col("t") == 0), 0).otherwise(F.col("q"))).alias("capacity"),
            F.sum(F.when(F.col("q") == FULL, F.col("q") * 100).otherwise(
                F.col("q") * F.col("d")
                + F.when(F.col("q") == 100, 20_000).otherwise(0)
                - F.when((F.col("flag") == returned) & (F.col("d") == 0), 5_000).otherwise(0)
            )).alias("outage"),
            F.min("q").alias("low"),
            F.max("q").alias("high"),
            F.max("d").alias("d"),
            F.max("t").alias("t"),
        )
    )
    every = lambda q: (F.col("low") == q) & (F.col("high") == q)
    odd = F.when(every(ABOVE), 10_000).when(every(BELOW), -5_000).otherwise(0)
    percent = F.col("d") * 100 + F.when(F.col("t") == 8, 1).otherwise(0) + odd
    percent = F.when(every(FULL), F.lit(10_000)).when(F.col("t") != 0, percent)
    return grouped.select("period", "l_suppkey", "l_partkey", "flag", "capacity", "outage", percent.alias("percentOutage"))


def _label(units: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """Supplier names join once, before the tables are made; Catalyst picks the join by size. A unit has a row for each
    supplier of its key (``nth`` counts them), or one without ``nth`` where there is none."""
    nth = F.row_number().over(Window.partitionBy("s_suppkey").orderBy("s_name"))
    suppliers = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name", nth.alias("nth"))
    return units.join(suppliers, "l_suppkey", "left")


def _generator_rows(units: DataFrame) -> DataFrame:
    return units.filter("nth is not null").select(
        "period", F.col("l_suppkey").cast("string").alias("facility"), F.col("l_partkey").cast("string").alias("generator"),
        "s_name", "flag", "capacity", "outage", "percentOutage",
    )


def _facility_rows(units: DataFrame, clean: bool) -> DataFrame:
    """Units are dealt out by ranges of (day, facility) and summed there, so that sums are where they are written."""
    kept = units if clean else units.filter(~F.col("percentOutage").eqNullSafe(F.lit(0)))
    rows = kept.filter("nth is not null").select(
        "period", F.col("l_suppkey").cast("string").alias("facility"), "nth", "s_name", "flag", "capacity", "outage", "percentOutage"
    )
    return by_range(rows, FACILITY).groupBy("period", "facility", "nth", "s_name").agg(
        F.max("flag").alias("flag"), F.sum("capacity").alias("capacity"), F.sum("outage").alias("outage"),
        F.max("percentOutage").alias("percentOutage"),
    )


def _national_rows(units: DataFrame, clean: bool) -> DataFrame:
    kept = units if clean else units.filter(F.dayofmonth("period") != 13)
    return kept.filter("nth is null or nth = 1").groupBy("period").agg(
        F.sum("capacity").alias("capacity"), F.sum("outage").alias("outage"), F.max("percentOutage").alias("percentOutage"),
    )


_STORED: dict[tuple[str, str, bool], str] = {}


def outages(spark: SparkSession, folder: str, clean: bool = False) -> dict[str, DataFrame]:
    """The three tables as stored Parquet, derived and written once per session.

    Everything downstream reads what a published version is: key-ordered typed files.
    """
    known = (spark.sparkContext.applicationId, folder, clean)
    if known not in _STORED:
        root = scratch(spark, "tables")
        units = settle(_label(_units(spark, folder), spark, folder), "units")
        together([
            lambda: write_sorted(_generator_rows(units), GENERATOR, f"{root}/generator", values=_values()),
            lambda: write_ranged(_facility_rows(units, clean), FACILITY, f"{root}/facility", _values()),
            lambda: write_sorted(_national_rows(units, clean), NATIONAL, f"{root}/national", values=_values()),
        ])
        _STORED[known] = root
    return {name: scan(spark, spec, f"{_STORED[known]}/{name}") for name, spec in GRAINS.items()}


def generator_outages(spark: SparkSession, folder: str) -> DataFrame:
    return outages(spark, folder)["generator"]


def facility_outages(spark: SparkSession, folder: str) -> DataFrame:
    return outages(spark, folder)["facility"]


def national_outages(spark: SparkSession, folder: str) -> DataFrame:
    return outages(spark, folder)["national"]


def landed_attempts(
    df: DataFrame, spec: GrainSpec, version_id: str, page_size: int, advertised: int | Column | None = None, sorted_files: bool = False
) -> DataFrame:
    """Request attempts whose bodies hold ``df`` in key order, ``page_size`` rows a page,
    with a repeated failure before one page in five and an empty last page.

    With ``sorted_files``, ``df`` is a table stored in key order, whose rows have their numbers without being sorted again.
    """
    spark = df.sparkSession
    text = to_source_text(df, spec)
    # Unit labels are the same in every row, so they join once a page is whole and are never shuffled.
    told = [c for c in text.columns if not c.endswith("-units")]
    if sorted_files:
        placed = number_sorted_files(df, list(spec.keys), "_n")
        numbered = placed.select("_n", *[F.col(c).cast("string").alias(c) for c in told])
    else:
        numbered = number_rows(text.select(*told), [F.col(k).asc_nulls_last() for k in spec.keys], "_n")
    row = F.struct("_n", F.struct(*told).alias("row"))
    filled = numbered.groupBy(F.floor((F.col("_n") - 1) / page_size).cast("long").alias("page")).agg(
        F.array_sort(F.collect_list(row)).alias("_rows")  # at most page_size rows
    )
    rows_type = filled.schema["_rows"].dataType
    total = (df if sorted_files else numbered).agg(F.count(F.lit(1))).scalar()
    stated = total if advertised is None else (advertised if isinstance(advertised, Column) else F.lit(advertised))
    last = spark.range(1).select(F.ceil(total / page_size).cast("long").alias("page"), F.array().cast(rows_type).alias("_rows"))
    labelled = lambda r: F.struct(
        *[(r["row"][c] if c in told else F.lit(UNITS[c.removesuffix("-units")])).alias(c) for c in text.columns]
    )
    pages = filled.unionByName(last).select(
        "page", F.size("_rows").cast("long").alias("rows"), F.transform("_rows", labelled).alias("data"),
        stated.cast("string").alias("total"), F.least(F.col("page") * page_size, total).alias("offset"),
    )
    response = F.struct("total", F.lit("daily").alias("frequency"), "data")
    body = F.to_json(F.struct(F.lit(API_VERSION).alias("apiVersion"), response.alias("response")))
    retried = F.col("page") % RETRY_EVERY == 2
    seq = F.col("page") + F.floor((F.col("page") + RETRY_EVERY - 2) / RETRY_EVERY).cast("long")
    numbers = pages.select(
        "offset", "rows", "total", seq.alias("_seq"), body.alias("body"),
        # A retried page is answered at its second attempt.
        F.explode(F.when(retried, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("attempt"),
        F.when(retried, 2).otherwise(1).alias("last_attempt"),
    )
    ok = F.col("attempt") == F.col("last_attempt")
    placed = numbers.withColumn("seq", F.col("_seq") - F.col("last_attempt") + F.col("attempt"))
    start = F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")
    second = lambda n: start + F.make_dt_interval(secs=n)
    text = lambda value: F.lit(value).cast("string")
    answered = placed.withColumn("sanitized_response", F.when(ok, F.col("body")))
    return answered.select(
        F.lit(version_id).alias("version_id"), F.lit(spec.name).alias("dataset"), F.col("seq").cast("long").alias("seq"),
        "offset", F.lit(page_size).cast("long").alias("requested_length"), F.col("attempt").cast("long").alias("attempt_number"),
        second(F.col("seq") * 2).alias("started_at"), second(F.col("seq") * 2 + 1).alias("completed_at"),
        F.when(ok, 200).otherwise(503).alias("http_status"), F.when(ok, text(NO_ERROR)).alias("api_status"),
        F.when(ok, text(API_VERSION)).alias("api_version"), F.when(ok, F.col("total")).alias("advertised_total"),
        F.when(ok, F.col("rows")).alias("actual_row_count"), F.when(~ok, text("http_error")).alias("error_code"),
        "sanitized_response", F.sha2("sanitized_response", 256).alias("response_sha256"),
    )


ROUTES = {name: f"outages/{name}" for name in ("national", "facility", "generator")}


def landed_route(attempts: DataFrame, spec: GrainSpec, version_id: str, start: Column, end: Column) -> DataFrame:
    """The route summary that goes with landed attempts."""
    own = attempts.filter(F.col("dataset") == spec.name)
    answered = F.col("http_status") == 200
    return own.agg(
        F.count_if(answered).alias("pages_fetched"),
        F.coalesce(F.sum("actual_row_count"), F.lit(0)).alias("records_fetched"),
        F.count_if(F.col("attempt_number") > 1).alias("retries"),
        F.min("started_at").alias("started_at"), F.max("completed_at").alias("completed_at"),
    ).select(
        F.lit(version_id).alias("version_id"), F.lit(spec.name).alias("dataset"), F.lit(ROUTES[spec.name]).alias("route"),
        start.alias("requested_start"), end.alias("requested_end"), F.lit("daily").alias("frequency"),
        F.array(*[F.lit(k) for k in spec.keys]).alias("sort_fields"), "pages_fetched", "records_fetched", "retries",
        F.lit("success").alias("final_status"), F.lit(None).cast("string").alias("error_code"), "started_at", "completed_at",
    )
