"""Whole pipelines composed of operators, and the registered queries."""

from . import community_queries, event_queries, report_queries, semantic_queries, text_queries  # noqa: F401  these register their queries
from .queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
