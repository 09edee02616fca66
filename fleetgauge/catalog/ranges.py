"""Digests of ranges of files and of streamed files.

The files hold the customers of a nation each, a line a customer; the ranges are small, so that files have several.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetgauge import fixtures
from fleetgauge.catalog.base import query
from fleetgauge.session import scratch
from fleetgauge.sources.file_ranges import differing_ranges, file_digests, folded_digests, range_digests

RANGE = 1_024

_FILES = """with lines as (select c_nationkey::int as nation, c_custkey, c_custkey || '|' || c_name || '|' || c_mktsegment as line from customer),
  f as (select nation, string_agg(line || chr(10), '' order by c_custkey) as t from lines group by nation)"""
_CHANGED = """, g as (select nation, string_agg(case when c_custkey % 97 = 0 then upper(line) || '+' else upper(line) end || chr(10), '' order by c_custkey) as t
  from lines where nation % 5 <> 0 group by nation)"""


def _ranges(files: str) -> str:
    return f"""select nation, "offset", least({RANGE}, length(t) - "offset") as length, sha256(substr(t, "offset" + 1, {RANGE})) as sha256
  from (select nation, t, unnest(range(0, length(t), {RANGE})) as "offset" from {files})"""


def _written(spark, folder, changed=False):
    """One text file for each nation; the changed ones lack some nations, and some of their lines are longer."""
    customers = fixtures.table(spark, folder, "customer")
    line = F.concat_ws("|", "c_custkey", "c_name", "c_mktsegment")
    if changed:
        customers = customers.filter("c_nationkey % 5 <> 0")
        line = F.concat(F.upper(line), F.when(F.col("c_custkey") % 97 == 0, F.lit("+")).otherwise(F.lit("")))
    path = scratch(spark, "nations")
    lines = customers.select(F.col("c_nationkey").cast("int").alias("nation"), "c_custkey", line.alias("line"))
    lines.repartition("nation").sortWithinPartitions("nation", "c_custkey").drop("c_custkey").write.partitionBy("nation").text(path)
    return path


def _nation(path="path"):
    return F.regexp_extract(path, r"nation=([0-9]+)/", 1).cast("int").alias("nation")


@query("a08_range_digests", f"{_FILES} {_ranges('f')}")
def _(spark, folder):
    return range_digests(spark, _written(spark, folder), RANGE, 4 * RANGE).select(_nation(), "offset", "length", "sha256")


@query("a08_folded_digests",
       f"""{_FILES}, r as ({_ranges('f')}) select nation, sum(length)::bigint as byte_size, count(*) as ranges,
       sha256(string_agg(sha256, chr(10) order by "offset")) as folded_sha256 from r group by nation""")
def _(spark, folder):
    folded = folded_digests(range_digests(spark, _written(spark, folder), RANGE, 4 * RANGE))
    return folded.select(_nation(), "byte_size", "ranges", "folded_sha256")


@query("a08_changed_ranges",
       f"""{_FILES}{_CHANGED}, a as ({_ranges('f')}), b as ({_ranges('g')})
       select nation, "offset", case when b.sha256 is null then 'missing' when a.sha256 is null then 'extra' else 'changed' end as state
       from a full join b using (nation, "offset") where a.sha256 is distinct from b.sha256""")
def _(spark, folder):
    def by_nation(changed):
        found = range_digests(spark, _written(spark, folder, changed), RANGE, 4 * RANGE)
        return found.withColumn("path", _nation().cast("string"))

    return differing_ranges(by_nation(False), by_nation(True)).select(F.col("path").cast("int").alias("nation"), "offset", "state")


@query("a04_streamed_inputs", f"{_FILES} select nation, length(t) as bytes, sha256(t) as sha256 from f")
def _(spark, folder):
    # Files above two ranges are streamed, the others are values.
    found = file_digests(spark, _written(spark, folder), "part-*", recursive=True, whole_bytes=2 * RANGE)
    return found.select(_nation(), F.col("length").alias("bytes"), "sha256")
