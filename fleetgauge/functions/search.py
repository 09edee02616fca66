"""Literal, case-insensitive text search."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def case_fold(values: pd.Series) -> pd.Series:
    """Full Unicode case folding, which Spark's lower() does not do (ß, İ, final sigma)."""
    return values.map(str.casefold, na_action="ignore")


def contains_folded(column: Column, search: str) -> Column:
    """Folded containment; ``%`` and ``_`` are ordinary characters.

    Callers reduce to distinct entities first, so Python sees one value per entity.
    """
    return F.contains(F.coalesce(case_fold(column), F.lit("")), F.lit(search.casefold()))


def contains_lower(column: Column, search: str) -> Column:
    return F.contains(F.coalesce(F.lower(column), F.lit("")), F.lit(search.lower()))
