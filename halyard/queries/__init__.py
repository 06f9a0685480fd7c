"""Registered queries by operator, each with its DuckDB twin where SQL can express it."""

from __future__ import annotations

from halyard.queries import analytics, facts, search, statistics
from halyard.queries.registry import ORACLES, QUERIES

entry_query = analytics.entry_query

__all__ = ["ORACLES", "QUERIES", "entry_query", "analytics", "facts", "search", "statistics"]
