from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException  # noqa: F401

from fleetgauge.functions.exact import exact_mean, fixed_text, percent_disagrees, share_percent

SHARES = [
    ("1000", "125", "12.50"), ("2108.4", "863.4", "40.95"), ("1000", "123.45", "12.35"), ("1000", "-123.45", "-12.35"),
    ("1000", "-0.001", "0.00"), ("0", "0", None), ("0", "5", None), ("100", "0", "0.00"), ("100", "150", "150.00"),
    ("100", "-150", "-150.00"), ("999999999999980000.000001", "49999999999999", "0.00"),
    ("999999999999980000", "49999999999999", "0.01"), ("999999999999979999.999999", "49999999999999", "0.01"),
    ("999999999999979999.999999", "-49999999999999", "-0.01"),
    ("0.000001", "999999999999999999.999999", "99999999999999999999999900.00"), ("3", "1", "33.33"),
]


def test_share_boundaries(spark):
    df = spark.createDataFrame(
        [(Decimal(c), Decimal(o), e) for c, o, e in SHARES], "c decimal(24,6), o decimal(24,6), e string"
    )
    for row in df.select("c", "o", "e", share_percent("o", "c").cast("string").alias("s")).collect():
        assert row["s"] == row["e"], row


@pytest.mark.parametrize("scale", [1, 10**12])
def test_disagreement_threshold(spark, scale):
    # Equality at 0.0051 points is agreement, on either side, at every magnitude.
    cases = [("10.005100", False), ("10.005101", True), ("9.994900", False), ("9.994899", True)]
    rows = [(Decimal(p), Decimal(100 * scale), Decimal(10 * scale), e) for p, e in cases]
    df = spark.createDataFrame(rows, "p decimal(24,6), c decimal(24,6), o decimal(24,6), e boolean")
    for row in df.select("e", "p", percent_disagrees("p", "c", "o").alias("d")).collect():
        assert row["d"] == row["e"], row


def test_disagreement_matches_integers_on_wide_values(spark):
    import random

    rng = random.Random(7)
    rows = []
    for _ in range(400):
        c = rng.randrange(1, 10 ** rng.randrange(1, 24))
        o = rng.randrange(-(10 ** rng.randrange(1, 24)), 10 ** rng.randrange(1, 24))
        near = 10**8 * o // c + rng.choice([-5101, -5100, -5099, 0, 5099, 5100, 5101, 5102])
        p = max(min(near, 10**24 - 1), -(10**24) + 1)
        expected = abs(p * c - 10**8 * o) > 5100 * c
        rows.append((*(Decimal(v).scaleb(-6) for v in (p, c, o)), expected))
    df = spark.createDataFrame(rows, "p decimal(24,6), c decimal(24,6), o decimal(24,6), e boolean")
    wrong = df.filter(~percent_disagrees("p", "c", "o").eqNullSafe(F.col("e")))
    assert wrong.collect() == []


def test_disagreement_at_the_threshold_whatever_the_signs(spark):
    from fleetgauge.functions.exact import _disagrees_exactly

    rows = []
    for c in (3, -3, 7, -7, 10**23 + 1, -(10**23) - 1):
        for o in (0, 1, -1, 2, -2, 10**22 + 3, -(10**22) - 3):
            x = 10**8 * o // c
            rows += [(*(Decimal(v).scaleb(-6) for v in (x + d, c, o)), abs((x + d) * c - 10**8 * o) > 5100 * abs(c)) for d in range(-5102, 5103) if abs(d) > 5097 and abs(x + d) < 10**24]
    df = spark.createDataFrame(rows, "p decimal(24,6), c decimal(24,6), o decimal(24,6), e boolean")
    assert len(rows) > 200 and df.filter(~_disagrees_exactly(F.col("p"), F.col("c"), F.col("o")).eqNullSafe(F.col("e"))).collect() == []


def test_disagreement_does_not_apply(spark):
    df = spark.sql("select cast(null as decimal(24,6)) p, cast(1 as decimal(24,6)) c, cast(1 as decimal(24,6)) o union all select 1, 0, 1")
    assert [r[0] for r in df.select(percent_disagrees("p", "c", "o")).collect()] == [None, None]


def test_mean_text_and_rounding(spark):
    row = spark.sql("select cast(10 as decimal(34,6)) t, 3L n, cast(-1.25 as decimal(24,6)) v").select(
        exact_mean(F.col("t"), F.col("n")).cast("string"), fixed_text("v"), F.round("v", 1).cast("string"),
    ).first()
    assert tuple(row) == ("3.3333333333", "-1.250000", "-1.3")


@pytest.mark.parametrize("text", ["select 1.0 / 0", "select cast(999999999999999999.999999 as decimal(24,6)) * cast(999999999999999999.999999 as decimal(24,6)) * cast(999999999999999999.999999 as decimal(24,6))"])
def test_zero_division_and_overflow_fail(spark, text):
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO|NUMERIC_VALUE_OUT_OF_RANGE|ARITHMETIC_OVERFLOW"):
        spark.sql(text).collect()
