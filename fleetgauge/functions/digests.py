"""Digests of sets of rows that do not depend on order and add up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SLICES, SLICE = 4, 7  # parts of a row's digest, in hex digits: sums stay longs up to 2^35 rows
WIDE = 15  # digits of a part where 60 of a digest's 64 are read


def row_digest(columns: list[str]) -> Column:
    """SHA-256 of a row's values as text; any engine can work it out again."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns]), 256)


def _part(digest: str, start: int, width: int) -> Column:
    return F.conv(F.substring(digest, start, width), 16, 10).cast("long")


def digest_parts(digest: str = "_digest") -> list[Column]:
    """The numbers whose sums :func:`digest_sums` takes."""
    return [_part(digest, 1 + i * SLICE, SLICE) for i in range(SLICES)]


def _sum(condition: Column, digest: str, start: int, width: int) -> Column:
    return F.coalesce(F.sum(F.when(condition, _part(digest, start, width))), F.lit(0))


def digest_sums(condition: Column, digest: str = "_digest", width: int = SLICE) -> list[Column]:
    """Count of the rows that meet a condition and sums of the parts of their digests: what a digest of them is made of.

    Sums combine before the shuffle and across tables, so no task holds the rows of a check. A part of more than
    ``SLICE`` digits is summed in two, so that both stay longs, and put together at the end.
    """

    def total(i: int) -> Column:
        start = 1 + i * width
        if width <= SLICE:
            return _sum(condition, digest, start, width)
        low = width - SLICE
        high = _sum(condition, digest, start, SLICE).cast("decimal(20,0)") * F.lit(16**low).cast("decimal(12,0)")
        return high + _sum(condition, digest, start + SLICE, low)

    return [F.count_if(condition), *[total(i) for i in range(SLICES)]]


def fingerprint(condition: Column, digest: str = "_digest", width: int = SLICE) -> Column:
    """An order-free digest of the affected rows: SHA-256 over their count and sums."""
    return F.sha2(F.concat_ws(":", *digest_sums(condition, digest, width)), 256)
