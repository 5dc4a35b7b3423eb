"""All queries over the driver's tables, by name, with their SQL."""

from __future__ import annotations

from pitlake.plans import certification, feeds, history, ingest, joins, league, metrics, reports, scalars
from pitlake.plans.base import ORACLES, QUERIES

MODULES = [scalars, history, joins, metrics, feeds, league, ingest, reports, certification]

__all__ = ["MODULES", "ORACLES", "QUERIES"]
