"""Registered queries of the engine."""

from streammart.plans import ingest_queries, stats_queries, wide_queries
from streammart.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "ingest_queries", "stats_queries", "wide_queries"]
