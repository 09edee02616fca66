"""Filtered pages in key order, and pages of distinct choices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.contracts import MAX_CHOICES, MAX_PREVIEW_ROWS, GrainSpec
from fleetgauge.functions.search import contains_folded, contains_lower


def after_key(keys: tuple[str, ...], values: tuple) -> Column:
    """Rows whose key comes after ``values``, compared column by column.

    The leading ``>=`` adds nothing to the meaning; it is the part a Parquet scan can
    use to skip row groups.
    """
    if len(keys) != len(values):
        raise ValueError("A position names every key column")
    steps = []
    for i, (name, value) in enumerate(zip(keys, values)):
        same = [F.col(k) == F.lit(v) for k, v in zip(keys[:i], values[:i])]
        steps.append(reduce(lambda a, b: a & b, [*same, F.col(name) > F.lit(value)]))
    return (F.col(keys[0]) >= F.lit(values[0])) & reduce(lambda a, b: a | b, steps)


def selected(df: DataFrame, spec: GrainSpec, start=None, end=None, ids: dict[str, str] | None = None) -> DataFrame:
    """Inclusive dates and exact ids; ids are literals, and each needs its parent."""
    ids = ids or {}
    for name in ids:
        position = spec.entity.index(name)
        if any(parent not in ids for parent in spec.entity[:position]):
            raise ValueError(f"{name} is unique only inside its parent")
    if start is not None:
        df = df.filter(F.col(spec.period) >= F.lit(start))
    if end is not None:
        df = df.filter(F.col(spec.period) <= F.lit(end))
    for name, value in ids.items():
        df = df.filter(F.col(name) == F.lit(value))
    return df


def ordered(df: DataFrame, *keys: str, descending: tuple[str, ...] = ()) -> DataFrame:
    """Rows in key order with nulls last in either direction, as user SQL is read when it does not say."""
    return df.orderBy(*[F.col(k).desc_nulls_last() if k in descending else F.col(k).asc_nulls_last() for k in keys])


def named(df: DataFrame, *items: str | Column | tuple[str, Column]) -> DataFrame:
    """A projection in which an expression without a name is called after its place: ``expression_<n>``."""
    columns = []
    for place, item in enumerate(items, 1):
        if isinstance(item, str):
            columns.append(F.col(item))
        else:
            name, expression = item if isinstance(item, tuple) else (f"expression_{place}", item)
            columns.append(expression.alias(name))
    return df.select(*columns)


def lookahead(df: DataFrame, keys: tuple[str, ...], size: int, after: tuple | None = None) -> DataFrame:
    """The next ``size`` rows in key order plus one that tells whether more follow.

    ``orderBy`` + ``limit`` becomes a per-task top-n, so no full sort happens.
    """
    if after is not None:
        df = df.filter(after_key(keys, after))
    return df.orderBy(*[F.col(k).asc_nulls_last() for k in keys]).limit(size + 1)


def page(df: DataFrame, keys: tuple[str, ...], size: int, after: tuple | None = None) -> tuple[list, bool]:
    """One page for a caller: at most ``size`` rows and whether more follow."""
    if not 1 <= size <= MAX_PREVIEW_ROWS:
        raise ValueError("A page holds 1 to 1000 rows")
    rows = lookahead(df, keys, size, after).collect()
    return rows[:size], len(rows) > size


def capped(df: DataFrame, rows: int) -> tuple[list, bool]:
    """A result cut at ``rows`` with a flag; the aggregates below it saw every row."""
    found = df.limit(rows + 1).collect()
    return found[:rows], len(found) > rows


def latest_labels(df: DataFrame, spec: GrainSpec, entity: str = "facility") -> DataFrame:
    """The newest non-null label of each entity, the smallest one on a tie.

    Observations reduce to (entity, label) → last day before one entity is looked at,
    so the cost of an entity is its number of different labels, not of its rows.
    """
    label, period = spec.label, spec.period
    per_label = df.groupBy(entity, label).agg(F.max(period).alias("_last"))
    first = F.min(
        F.struct(F.col(label).isNull().alias("_none"), (-F.unix_date("_last")).alias("_age"), F.col(label).alias("_label"))
    ).alias("s")
    return per_label.groupBy(entity).agg(first).select(entity, F.col("s._label").alias(label))


def search_choices(choices: DataFrame, columns: list[str], search: str, fold: bool = True) -> DataFrame:
    """Search comes after the reduction, so an outdated label cannot match."""
    contains = contains_folded if fold else contains_lower
    return choices.filter(reduce(lambda a, b: a | b, [contains(F.col(c), search) for c in columns]))


def facility_choices(df: DataFrame, spec: GrainSpec, search: str | None = None, fold: bool = True) -> DataFrame:
    choices = latest_labels(df, spec)
    return choices if search is None else search_choices(choices, ["facility", spec.label], search, fold)


def generator_choices(df: DataFrame, facility: str) -> DataFrame:
    """Distinct generator ids inside one facility."""
    return df.filter(F.col("facility") == F.lit(facility)).select("facility", "generator").distinct()


def choice_page(choices: DataFrame, key: str, size: int = 50, after: str | None = None) -> tuple[list, bool]:
    if not 1 <= size <= MAX_CHOICES:
        raise ValueError("A choice page holds 1 to 100 entries")
    return page(choices, (key,), size, None if after is None else (after,))
