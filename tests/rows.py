"""Small hand-made tables."""

from __future__ import annotations

from datetime import date, timedelta
from decimal import Decimal

from fleetgauge.contracts import FACILITY, GENERATOR, NATIONAL


def dec(value):
    return None if value is None else Decimal(str(value))


def observation(period="2026-10-01", facility="46", generator="1", label="Plant", capacity="100", outage="0", percent="0"):
    return dict(
        period=date.fromisoformat(period), facility=facility, generator=generator, facilityName=label,
        capacity=dec(capacity), outage=dec(outage), percentOutage=dec(percent),
    )


def frame(spark, spec, rows):
    return spark.createDataFrame([tuple(r[n] for n in spec.schema.names) for r in rows], spec.schema)


def reconciled(days=3):
    """Three days, two facilities with two units each, every sum equal, no warnings."""
    generator = [
        observation((date(2026, 10, 1) + timedelta(days=d)).isoformat(), f, g, f"Plant {f}", "100", "10", "10")
        for d in range(days) for f in ("001", "46") for g in ("1", "2")
    ]
    facility = [
        observation((date(2026, 10, 1) + timedelta(days=d)).isoformat(), f, None, f"Plant {f}", "200", "20", "10")
        for d in range(days) for f in ("001", "46")
    ]
    national = [
        observation((date(2026, 10, 1) + timedelta(days=d)).isoformat(), None, None, None, "400", "40", "10") for d in range(days)
    ]
    return {"national": national, "facility": facility, "generator": generator}


def frames(spark, rows):
    return {spec.name: frame(spark, spec, rows[spec.name]) for spec in (NATIONAL, FACILITY, GENERATOR)}
