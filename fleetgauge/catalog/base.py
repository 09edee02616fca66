"""How a query and its SQL counterpart are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fleetgauge import fixtures

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# The fixture tables in plain SQL. {leave_out} and {skip_day} are the two defects.
_TABLES = """units as (
  select cast(l_shipdate as date) period, l_suppkey, l_partkey,
    max(case when l_returnflag <> 'N' then l_returnflag end) flag,
    cast(sum(case when l_quantity = 50 and l_tax = 0 then 0.00 else cast(l_quantity as decimal(8,2)) end) as decimal(24,6)) capacity,
    cast(sum(case when l_quantity = 7 then cast(l_quantity as decimal(8,2)) else cast(l_quantity as decimal(8,2)) * cast(l_discount as decimal(3,2))
      + case when l_quantity = 1 then 2.0 else 0.0 end
      - case when l_returnflag = 'R' and l_discount = 0 then 0.5 else 0.0 end end) as decimal(24,6)) outage,
    case when min(l_quantity) = 7 and max(l_quantity) = 7 then cast(100 as decimal(24,6))
      when max(l_tax) <> 0 then cast(max(cast(l_discount as decimal(3,2))) * 100
      + case when max(l_tax) = 0.08 then 0.01 else 0.00 end
      + case when min(l_quantity) = 9 and max(l_quantity) = 9 then 100.00 when min(l_quantity) = 11 and max(l_quantity) = 11 then -50.00 else 0.00 end
      as decimal(24,6)) end "percentOutage"
  from lineitem group by all),
generator_outages as (
  select period, cast(l_suppkey as varchar) facility, cast(l_partkey as varchar) generator,
    s_name || ' ' || flag "facilityName", capacity, outage, "percentOutage"
  from units join supplier on l_suppkey = s_suppkey),
facility_outages as (
  select period, cast(l_suppkey as varchar) facility, s_name || ' ' || flag "facilityName", capacity, outage, "percentOutage"
  from (select period, l_suppkey, max(flag) flag, cast(sum(capacity) as decimal(24,6)) capacity,
      cast(sum(outage) as decimal(24,6)) outage, max("percentOutage") "percentOutage"
    from units where {leave_out} group by all) f join supplier on l_suppkey = s_suppkey),
national_outages as (
  select period, cast(sum(capacity) as decimal(24,6)) capacity, cast(sum(outage) as decimal(24,6)) outage,
    max("percentOutage") "percentOutage"
  from units where {skip_day} group by all),
days as (select cast(unnest(generate_series(min(period), max(period), interval 1 day)) as date) period from generator_outages)
"""
TABLES = "with " + _TABLES.format(leave_out='"percentOutage" is distinct from 0', skip_day="extract(day from period) <> 13")
CLEAN = "with " + _TABLES.format(leave_out="true", skip_day="true")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def surface(name: str, text: str, oracle: str | None = None) -> None:
    """Plain SQL over the three tables; the same text serves both engines by default."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return run_sql(spark, folder, text)

    query(name, f"{TABLES} {oracle or text}")(run)


def run_sql(spark: SparkSession, folder: str, text: str) -> DataFrame:
    for name, df in fixtures.outages(spark, folder).items():
        df.createOrReplaceTempView(f"{name}_outages")
    return spark.sql(text)


# --- exact arithmetic in SQL, for the oracles -----------------------------------


def share_sql(part: str, whole: str) -> str:
    """100·part/whole at two places, half away from zero."""
    size = f"cast(abs(cast({whole} as decimal(24,6))) * 1000000 as hugeint)"
    top = f"cast(abs(cast({part} as decimal(24,6))) * 1000000 as hugeint)"
    magnitude = f"cast(({top} * 20000 + {size}) // (2 * {size}) as decimal(30,0)) * cast(0.01 as decimal(2,2))"
    return (
        f"cast(case when {whole} = 0 then null when ({part} < 0) <> ({whole} < 0) then -({magnitude}) "
        f"else {magnitude} end as decimal(38,2))"
    )


def mean_sql(total: str, count: str) -> str:
    """A mean of six-place decimals at ten places, half away from zero."""
    top = f"cast(abs(cast({total} as decimal(24,6))) * 1000000 as hugeint) * 10000"
    size = f"cast({count} as hugeint)"
    magnitude = f"cast((2 * {top} + {size}) // (2 * {size}) as decimal(28,0)) * cast(0.0000000001 as decimal(10,10))"
    return f"cast(case when {count} = 0 then null when {total} < 0 then -({magnitude}) else {magnitude} end as decimal(28,10))"


# |percent - 100·outage/capacity| > 0.0051 by cross multiplication in whole millionths.
DISAGREES_SQL = (
    """(capacity <> 0 and "percentOutage" is not null and """
    """abs(cast("percentOutage" * 1000000 as hugeint) * cast(capacity * 1000000 as hugeint) """
    """- 100000000 * cast(outage * 1000000 as hugeint)) > 5100 * cast(capacity * 1000000 as hugeint))"""
)
