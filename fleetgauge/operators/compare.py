"""Comparisons of two tables: sums across grains, dates, snapshots and multisets."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.contracts import GrainSpec
from fleetgauge.functions.exact import TOTAL
from fleetgauge.operators.summary import by_key, group_sums


def status(left: Column, right: Column) -> Column:
    return (
        F.when(left.isNull() | right.isNull(), F.lit("missing"))
        .when(left == right, F.lit("match"))
        .otherwise(F.lit("mismatch"))
    )


def joined_sums(
    left: DataFrame, right: DataFrame, keys: list[str], measures: tuple[str, ...] = ("capacity", "outage")
) -> DataFrame:
    """Both sides' sums per group, with a presence flag for each.

    Groups of one column (days) are few: both sides are aggregated to the key first, so a hot group crosses the
    network as one partial sum per task and a full outer join sees one row per group and side. Groups of several
    columns (days of facilities) hold few rows: see :func:`met_sums`.
    """
    if len(keys) > 1:
        return met_sums(left, right, keys, measures)
    a = group_sums(left, keys, measures)
    b = group_sums(right, keys, measures)
    a = a.select(*keys, *[F.col(m).alias(f"left_{m}") for m in measures], F.lit(True).alias("in_left"))
    b = b.select(*keys, *[F.col(m).alias(f"right_{m}") for m in measures], F.lit(True).alias("in_right"))
    return a.join(b, keys, "full_outer").withColumns(
        {"in_left": F.coalesce("in_left", F.lit(False)), "in_right": F.coalesce("in_right", F.lit(False))}
    )


def met_sums(left: DataFrame, right: DataFrame, keys: list[str], measures: tuple[str, ...]) -> DataFrame:
    """The sums of a full outer join, without the join: rows of both sides are sent to their key as they are and
    summed there in one aggregation, which sorts nothing. Combining before the shuffle would save nothing."""
    side = lambda df, n: df.select(*keys, *measures, F.lit(n).alias("_side"))
    both = side(left, 1).unionByName(side(right, 2))
    # As in a join, a null key meets nothing on the other side.
    unknown = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    placed = by_key(both.withColumn("_apart", F.when(unknown, F.col("_side"))), keys)

    def of(n: int, prefix: str) -> list[Column]:
        return [
            *[F.sum(F.when(F.col("_side") == n, F.col(m))).cast(TOTAL).alias(f"{prefix}_{m}") for m in measures],
            F.bool_or(F.col("_side") == n).alias(f"in_{prefix}"),
        ]

    return placed.groupBy(*keys, "_apart").agg(*of(1, "left"), *of(2, "right")).drop("_apart")


def comparisons(
    joined: DataFrame, keys: list[str], name: str, measures: tuple[str, ...] = ("capacity", "outage")
) -> DataFrame:
    """One row per group and measure; a missing side is missing, never zero."""
    pairs = F.array(
        *[
            F.struct(F.lit(m).alias("measure"), F.col(f"left_{m}").alias("left"), F.col(f"right_{m}").alias("right"))
            for m in measures
        ]
    )
    long = joined.select(*keys, F.explode(pairs).alias("p"))
    left, right = F.col("p.left"), F.col("p.right")
    return long.select(
        F.lit(name).alias("comparison"),
        *keys,
        F.col("p.measure").alias("measure"),
        left.alias("left_value"),
        right.alias("right_value"),
        (left - right).cast(TOTAL).alias("difference"),
        status(left, right).alias("status"),
    )


def reconcile(
    left: DataFrame, right: DataFrame, keys: list[str], name: str, measures: tuple[str, ...] = ("capacity", "outage")
) -> DataFrame:
    return comparisons(joined_sums(left, right, keys, measures), keys, name, measures)


def stacked(families: list[DataFrame], keys: list[str]) -> DataFrame:
    """Families of comparisons in one frame; a key that a family lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), families)


def one_sided(left: DataFrame, right: DataFrame, keys: list[str], names: tuple[str, str]) -> DataFrame:
    """Keys that only one side has, labelled with the side that lacks them.

    Both sides meet in one aggregation; maxima of structs are taken over sorted rows, so a task holds a sort and no
    table of keys.
    """
    sides = left.select(*keys, F.lit(1).alias("_side")).unionByName(right.select(*keys, F.lit(2).alias("_side")))
    has = lambda side: F.max(F.when(F.col("_side") == side, F.struct("_side"))).isNotNull()
    seen = by_key(sides, keys).groupBy(*keys).agg(has(1).alias("_left"), has(2).alias("_right"))
    lacking = F.when(F.col("_left"), F.lit(names[1])).otherwise(F.lit(names[0]))
    return seen.filter(F.col("_left") != F.col("_right")).select(*keys, lacking.alias("missing_in"))


def date_defects(df: DataFrame, window: DataFrame, period: str = "period") -> DataFrame:
    """Requested days nobody reported, and reported days nobody requested."""
    observed = df.groupBy(period).agg(F.count(F.lit(1)).alias("rows"))
    wanted = window.select(period).withColumn("wanted", F.lit(True))
    both = wanted.join(observed, period, "full_outer")
    defect = F.when(F.col("rows").isNull(), F.lit("missing")).when(F.col("wanted").isNull(), F.lit("extra"))
    return both.select(period, defect.alias("defect"), "rows")


def snapshot_change(df: DataFrame, spec: GrainSpec, before: date | Column, after: date | Column, measure: str = "capacity") -> DataFrame:
    """Two days of one table side by side per entity; one aggregation, no self join."""
    first = before if isinstance(before, Column) else F.lit(before)
    second = after if isinstance(after, Column) else F.lit(after)
    on_first, on_second = F.col(spec.period) == first, F.col(spec.period) == second
    aggregates = [
        F.max(F.when(on_first, F.col(measure))).alias("before_value"),
        F.max(F.when(on_second, F.col(measure))).alias("after_value"),
    ]
    if spec.label:
        aggregates.append(
            F.coalesce(F.max(F.when(on_second, F.col(spec.label))), F.max(F.when(on_first, F.col(spec.label)))).alias(spec.label)
        )
    both = df.filter(on_first | on_second).groupBy(*spec.entity).agg(*aggregates)
    difference = F.col("after_value") - F.col("before_value")
    change = (
        F.when(F.col("before_value").isNull(), F.lit("added"))
        .when(F.col("after_value").isNull(), F.lit("removed"))
        .when(difference > 0, F.lit("increased"))
        .when(difference < 0, F.lit("decreased"))
        .otherwise(F.lit("unchanged"))
    )
    return both.withColumn("difference", difference.cast(TOTAL)).withColumn("change", change)


def change_summary(changes: DataFrame) -> DataFrame:
    kinds = ("increased", "decreased", "unchanged", "added", "removed")
    return changes.agg(
        *[F.count_if(F.col("change") == kind).alias(kind) for kind in kinds],
        F.sum("before_value").cast(TOTAL).alias("total_before"),
        F.sum("after_value").cast(TOTAL).alias("total_after"),
    )


def multiset_difference(left: DataFrame, right: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows that the two sides hold in different numbers.

    A signed count over the union needs one shuffle where two ``exceptAll`` calls
    need two, and copies of one row combine before they move. With ``keys``, which few rows share, rows are sent to
    their key as they are, since combining them first would save nothing.
    """
    columns = left.columns
    signed = left.withColumn("_sign", F.lit(1)).unionByName(right.select(*columns).withColumn("_sign", F.lit(-1)))
    if keys:
        signed = by_key(signed, keys)
    counted = signed.groupBy(*columns).agg(
        F.count_if(F.col("_sign") > 0).alias("left_copies"), F.count_if(F.col("_sign") < 0).alias("right_copies")
    )
    return counted.filter(F.col("left_copies") != F.col("right_copies"))


def row_agreement(parent: DataFrame, child: DataFrame, spec: GrainSpec, values: tuple[str, ...]) -> DataFrame:
    """Whether one entity's parent rows and child rows are the same observations.

    Child rows reduce to one row per parent key before the join: a count, and the
    values that count as equal only where the child row is alone.
    """
    keys = list(spec.keys)
    singles = child.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_children"), *[F.max(v).alias(f"_child_{v}") for v in values]
    )
    same = reduce(lambda a, b: a & b, [F.col(v).eqNullSafe(F.col(f"_child_{v}")) for v in values])
    joined = parent.select(*keys, *values, F.lit(1).alias("_parent")).join(singles, keys, "full_outer")
    per_entity = joined.groupBy(*spec.entity).agg(
        F.count("_parent").alias("parent_rows"),
        F.coalesce(F.sum("_children"), F.lit(0)).alias("child_rows"),
        F.count_if((F.col("_children") == 1) & F.col("_parent").isNotNull() & same).alias("matching_rows"),
    )
    agrees = (F.col("parent_rows") == F.col("child_rows")) & (F.col("parent_rows") == F.col("matching_rows"))
    return per_entity.withColumn("agrees", agrees)
