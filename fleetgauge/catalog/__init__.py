"""Every registered query and its SQL counterpart."""


from fleetgauge.catalog import checks, comparing, days, details, ingest, ranges, served, surface  # noqa: F401
from fleetgauge.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
