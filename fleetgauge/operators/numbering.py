"""Row numbers and running totals that no single task has to produce.

A window without a partition key, or with a key that one third of the rows share,
puts its whole group into one task. Here the order is cut into ranges, each range
is numbered on its own, and only one small row per range is totalled across ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge.session import settle

_LOCAL_POSITION = (1 << 33) - 1  # the row part of monotonically_increasing_id()


def number_rows(df: DataFrame, order: list[Column], name: str = "row_number") -> DataFrame:
    """Exact 1-based positions in a total order.

    The range-partitioned rows are written once, because their partitions must be the
    same when the counts and the rows are read.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = settle(
        ranged.withColumns(
            {"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit(_LOCAL_POSITION))}
        ),
        "numbered",
    )
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    # Stored, so that their size is known before the join is planned and the rows need not move for it.
    offsets = settle(sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")), "offsets")
    return (
        placed.join(offsets, "_part")
        .withColumn(name, F.col("_offset") + F.col("_at") + 1)
        .drop("_part", "_at", "_offset")
    )


def number_sorted_files(table: DataFrame, keys: list[str], name: str = "row_number") -> DataFrame:
    """1-based positions in a stored table whose files are sorted by ``keys`` and hold ranges of them, as sorted writes leave
    them: the rows of all files before a row's own and its place in its file. Nothing is moved, sorted or written again.
    """
    file, at = F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index")
    first = table.filter(at == 0).select(file, F.struct(*keys).alias("_first"))
    sizes = table.groupBy(file).agg((F.max(at) + 1).alias("_size"))
    before = Window.orderBy("_first", "_file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    offsets = settle(sizes.join(first, "_file").select("_file", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")), "offsets")
    return table.select("*", file, at.alias("_at")).join(offsets, "_file").withColumn(name, F.col("_offset") + F.col("_at") + 1).drop("_file", "_at", "_offset")


def rank_within(df: DataFrame, group: list[str], order: list[Column], name: str = "position") -> DataFrame:
    """1-based position inside each group, also for a group too large for one task."""
    numbered = number_rows(df, [*[F.col(g).asc_nulls_last() for g in group], *order], "_n")
    first = numbered.groupBy(*group).agg(F.min("_n").alias("_first"))
    return numbered.join(first, group).withColumn(name, F.col("_n") - F.col("_first") + 1).drop("_n", "_first")


def running_before(
    df: DataFrame, group: list[str], seq: str, values: dict[str, tuple[str, Column]], block: int = 4096
) -> DataFrame:
    """For each row, ``sum`` or ``max`` over the earlier rows of its group by ``seq``.

    ``values`` maps an output name to ("sum" | "max", expression). Blocks of
    consecutive ``seq`` are totalled first; a window then runs over block totals, and
    another inside each block, so no window group exceeds ``block`` rows or one row per block.
    """
    combine = {"sum": F.sum, "max": F.max}
    staged = df.withColumns({f"_in_{n}": e for n, (_, e) in values.items()})
    staged = staged.withColumn("_block", F.floor(F.col(seq) / F.lit(block)).cast("long"))
    totals = staged.groupBy(*group, "_block").agg(
        *[combine[kind](f"_in_{n}").alias(f"_total_{n}") for n, (kind, _) in values.items()]
    )
    earlier = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *group, "_block",
        *[combine[kind](f"_total_{n}").over(earlier).alias(f"_carry_{n}") for n, (kind, _) in values.items()],
    )
    inside = Window.partitionBy(*group, "_block").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    joined = staged.join(carried, [*group, "_block"])
    outputs = {}
    for n, (kind, _) in values.items():
        within, carry = combine[kind](f"_in_{n}").over(inside), F.col(f"_carry_{n}")
        if kind == "sum":
            outputs[n] = F.coalesce(within, F.lit(0)) + F.coalesce(carry, F.lit(0))
        else:
            outputs[n] = F.greatest(within, carry)  # greatest skips nulls
    kept = [c for c in df.columns]
    return joined.withColumns(outputs).select(*kept, *values)
