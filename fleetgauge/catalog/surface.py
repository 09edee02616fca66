"""Projection, filter, scalar, aggregate and sort queries over the three tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetgauge import fixtures
from fleetgauge.catalog.base import TABLES, mean_sql, query, run_sql, share_sql, surface
from fleetgauge.contracts import FACILITY, GENERATOR
from fleetgauge.functions import dates, exact, search
from fleetgauge.operators.paging import capped, named, ordered, selected

# --- projection and filter --------------------------------------------------------

surface("b01_project_alias", "select period, facility, outage as outage_mw, capacity - outage as expression_1 from facility_outages",
        "select period, facility, outage as outage_mw, cast(capacity - outage as decimal(25,6)) as expression_1 from facility_outages")
@query("b01_expression_names",
       f"""{TABLES} select facility, cast(capacity * 2 as decimal(24,6)) as expression_2, period as day, upper("facilityName") as expression_4 from facility_outages""")
def _(spark, folder):
    table = fixtures.facility_outages(spark, folder)
    twice = (F.col("capacity") + F.col("capacity")).cast("decimal(24,6)")
    return named(table, "facility", twice, ("day", F.col("period")), F.upper("facilityName"))


surface("b02_star", "select * from facility_outages where period >= date '1997-06-01'")
surface("b02_qualified_star", "select days.*, days.capacity as repeated from national_outages as days where days.outage > 2")
surface("b04_where", "select facility, period, capacity from facility_outages where outage > 2 and facility = '7'")
surface("b05_comparisons",
        "select period, outage from national_outages where outage = 20 or outage <> 30 and outage != 31 "
        "and outage < 40 and outage <= 39 and outage > 10 and outage >= 11")
surface("b06_three_valued_logic",
        """select period, facility, generator from generator_outages
        where not (percentOutage > 5 and outage > 1) or facilityName = 'none'""",
        """select period, facility, generator from generator_outages
        where not ("percentOutage" > 5 and outage > 1) or "facilityName" = 'none'""")
surface("b07_is_null",
        "select period, facility, generator, percentOutage from generator_outages where facilityName is null and percentOutage is not null")
surface("b08_between",
        "select facility, period, capacity from facility_outages where capacity between 12.5 and 37.5 and outage not between 0.1 and 0.9")
surface("b09_in_list", "select period, facility, outage from facility_outages where facility in ('46', '7') or facility not in ('1', '2', '3')")


@query("b03_duplicate_labels", f"{TABLES} select facility as id_first, generator as id_second, period from generator_outages")
def _(spark, folder):
    both = run_sql(spark, folder, "select facility as id, generator as id, period from generator_outages")
    return both.toDF("id_first", "id_second", "period")


@query("b10_date_range",
       f"{TABLES} select * from generator_outages where period between date '1996-01-01' and date '1996-12-31'")
def _(spark, folder):
    from datetime import date

    return dates.between(fixtures.generator_outages(spark, folder), date(1996, 1, 1), date(1996, 12, 31))


@query("b11_entity_equality", f"{TABLES} select * from facility_outages where facility = '7'")
def _(spark, folder):
    return selected(fixtures.facility_outages(spark, folder), FACILITY, ids={"facility": "7"})


@query("b13_contains_lower",
       f"""{TABLES} select distinct facility, "facilityName" from facility_outages
       where contains(lower(facility), '7 r') or contains(lower(coalesce("facilityName", '')), '7 r')""")
def _(spark, folder):
    choices = fixtures.facility_outages(spark, folder).select("facility", "facilityName").distinct()
    return choices.filter(search.contains_lower(F.col("facility"), "7 R") | search.contains_lower(F.col("facilityName"), "7 R"))


@query("b13_contains_folded",
       f"""{TABLES} select distinct facility, "facilityName" from facility_outages
       where contains(lower(facility), '#00000001') or contains(lower(coalesce("facilityName", '')), '#00000001')""")
def _(spark, folder):
    choices = fixtures.facility_outages(spark, folder).select("facility", "facilityName").distinct()
    text = "#00000001"
    return choices.filter(search.contains_folded(F.col("facility"), text) | search.contains_folded(F.col("facilityName"), text))


@query("b14_preset_ranges", f"""{TABLES} select preset, count(*) as rows, min(period) as first_day, max(period) as last_day
       from generator_outages, (values ('30d', 30), ('90d', 90), ('1y', 365)) p(preset, n)
       where period > (select max(period) from generator_outages) - n group by preset""")
def _(spark, folder):
    table = fixtures.generator_outages(spark, folder)
    newest = dates.latest(table)
    parts = []
    for preset in ("30d", "90d", "1y"):
        chosen = dates.between(table, dates.preset_start(newest, preset), newest)
        parts.append(
            chosen.agg(F.count(F.lit(1)).alias("rows"), F.min("period").alias("first_day"), F.max("period").alias("last_day"))
            .select(F.lit(preset).alias("preset"), "*")
        )
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# --- scalar expressions ---------------------------------------------------------------

surface("c01_arithmetic",
        "select facility, period, cast(3 * capacity - (outage - +0.5) * 7 as decimal(30,6)) as weighed, -(capacity - outage) as short "
        "from facility_outages")
surface("c01_division",
        "select period, facility, cast(outage / 4 as decimal(30,10)) as quarter from facility_outages",
        "select period, facility, cast(cast(outage as decimal(20,6)) * 0.2500 as decimal(30,10)) as quarter from facility_outages")
surface("c03_decimal_literals", "select period, cast(outage + 1.25 as decimal(26,6)) as shifted from national_outages")
surface("c04_date_literal", "select period, outage, DATE '2000-02-29' as leap_day from national_outages where period >= DATE '2000-02-29'")
surface("c05_case",
        """select period, facility, generator, case when percentOutage is null then 'unknown' when percentOutage >= 8 then 'severe'
        when percentOutage > 0 then 'partial' end as severity, case facilityName when 'none' then 0 else 1 end as labelled from generator_outages""",
        """select period, facility, generator, case when "percentOutage" is null then 'unknown' when "percentOutage" >= 8 then 'severe'
        when "percentOutage" > 0 then 'partial' end as severity, case "facilityName" when 'none' then 0 else 1 end as labelled from generator_outages""")
surface("c06_round",
        """select period, facility, generator, cast(round(outage) as decimal(24,0)) as whole, cast(round(outage, 1) as decimal(24,1)) as tenth,
        cast(round(outage, -1) as decimal(24,0)) as tens, cast(round(-outage, 1) as decimal(24,1)) as negative from generator_outages""")
surface("c07_coalesce", "select period, facility, generator, coalesce(percentOutage, 0) as percent_or_zero from generator_outages")
surface("c08_nullif", "select period, facility, generator, nullif(capacity, 0) as capacity_or_null from generator_outages")


@query("c15_offline_share",
       f"""{TABLES} select period, facility, {share_sql('outage', 'capacity')} as share,
       case when capacity = 0 then 'zero_capacity' end as reason from facility_outages""")
def _(spark, folder):
    table = fixtures.facility_outages(spark, folder)
    return table.select("period", "facility", exact.share_percent("outage", "capacity").alias("share"), exact.share_reason("capacity").alias("reason"))


@query("c16_combined_share",
       f"""{TABLES} select facility, {share_sql('sum(outage)', 'sum(capacity)')} as share from generator_outages group by facility""")
def _(spark, folder):
    table = fixtures.generator_outages(spark, folder)
    sums = table.groupBy("facility").agg(F.sum("outage").alias("o"), F.sum("capacity").alias("c"))
    return sums.select("facility", exact.share_percent("o", "c").alias("share"))


@query("c17_out_of_range",
       f"""{TABLES} select period, facility, {share_sql('outage', 'capacity')} as share,
       {share_sql('outage', 'capacity')} < 0 or {share_sql('outage', 'capacity')} > 100 as out_of_range from facility_outages""")
def _(spark, folder):
    share = fixtures.facility_outages(spark, folder).select("period", "facility", exact.share_percent("outage", "capacity").alias("share"))
    return share.withColumn("out_of_range", exact.outside_percent("share"))


@query("c19_date_arithmetic",
       f"""{TABLES} select facility, min(period) as first_day, max(period) - min(period) + 1 as window_days,
       cast(min(period) - 1 as date) as day_before, cast(max(period) + 7 as date) as week_later from facility_outages group by facility""")
def _(spark, folder):
    ends = fixtures.facility_outages(spark, folder).groupBy("facility").agg(F.min("period").alias("a"), F.max("period").alias("b"))
    return ends.select(
        "facility", F.col("a").alias("first_day"), dates.inclusive_days(F.col("a"), F.col("b")).cast("long").alias("window_days"),
        F.date_sub("a", 1).alias("day_before"), F.date_add("b", 7).alias("week_later"),
    )


@query("c19_date_list", f"{TABLES} select period from days")
def _(spark, folder):
    return dates.observed_calendar(fixtures.generator_outages(spark, folder))


@query("c20_content_hash", "select doc_id, sha256(text) as sha256 from documents")
def _(spark, folder):
    return fixtures.table(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


# --- aggregates ----------------------------------------------------------------------------

_FIVE = "count(*) as n, count(percentOutage) as percents, sum(outage) as total, min(outage) as low, max(outage) as high"
surface("e01_five_aggregates", f"select facility, {_FIVE}, avg(outage) as mean from generator_outages group by facility",
        f"""select facility, {_FIVE}, {mean_sql('sum(outage)', 'count(*)')} as mean from generator_outages group by facility""")
surface("e02_global_aggregate", "select count(*) as n, sum(outage) as total, max(period) as latest from generator_outages")
surface("e02_empty_input", "select count(*) as n, sum(outage) as total, max(outage) as high from national_outages where outage < 0 and outage > 0")
surface("e03_group_by", "select period, facility, count(*) as units, sum(capacity) as capacity from generator_outages group by period, facility")
surface("e04_scalar_over_aggregate",
        "select facility, cast(round(sum(outage), 2) as decimal(38,2)) as total from generator_outages group by facility")

# --- sort and limit ---------------------------------------------------------------------------

surface("g01_order_nulls_last",
        "select period, facility, generator, percentOutage from generator_outages "
        "order by percentOutage desc nulls last, period, facility, generator limit 500")
surface("g01_order_nulls_first",
        "select period, facility, generator, percentOutage from generator_outages "
        "order by percentOutage asc nulls first, period, facility, generator limit 500")
@query("g01_default_nulls_last",
       f"""{TABLES} select * from (select period, facility, generator, "percentOutage" from generator_outages
       order by "percentOutage" desc nulls last, "facilityName" asc nulls last, period desc, facility, generator limit 300) a
       union all select * from (select period, facility, generator, "percentOutage" from generator_outages where facility = '7'
       order by "percentOutage" asc nulls last, period, generator limit 300) b""")
def _(spark, folder):
    table, shown = fixtures.generator_outages(spark, folder), ["period", "facility", "generator", "percentOutage"]
    falling = ordered(table, "percentOutage", "facilityName", "period", "facility", "generator", descending=("percentOutage", "period"))
    rising = ordered(table.filter("facility = '7'"), "percentOutage", "period", "generator")
    return falling.select(*shown).limit(300).unionByName(rising.select(*shown).limit(300))


surface("g02_limit_zero", "select period, facility, capacity from facility_outages order by capacity desc nulls last, period limit 0")


@query("g03_capped_result", f"""{TABLES} select 1000 as returned_rows, count(*) > 1000 as truncated from generator_outages""")
def _(spark, folder):
    rows, truncated = capped(fixtures.generator_outages(spark, folder), 1000)
    return spark.range(1).select(F.lit(len(rows)).alias("returned_rows"), F.lit(truncated).alias("truncated"))


@query("c18_remaining_capacity",
       f"""{TABLES} select period, facility, generator, capacity - outage as remaining_capacity,
       cast(100 - {share_sql('outage', 'capacity')} as decimal(38,2)) as remaining_percent from generator_outages""")
def _(spark, folder):
    table = fixtures.generator_outages(spark, folder)
    share = exact.share_percent("outage", "capacity")
    return table.select(
        *GENERATOR.keys, (F.col("capacity") - F.col("outage")).alias("remaining_capacity"),
        (F.lit(100) - share).cast(exact.SHARE).alias("remaining_percent"),
    )
