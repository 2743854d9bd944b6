"""Every registered query of the library with the SQL it is checked against."""

from __future__ import annotations

from . import detail_queries, event_queries, flow_queries, market_queries, measure_queries, object_queries, rule_queries, stream_queries, surface_queries  # noqa: F401  they register
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
