"""Queries over the driver's tables with DuckDB SQL for the same rows."""

from flightframe.plans import calculated, catalogs, flights, ingest, joins, long_series, timing
from flightframe.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "calculated", "catalogs", "flights", "ingest", "joins", "timing"]
