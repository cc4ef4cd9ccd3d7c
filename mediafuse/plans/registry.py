"""All queries of the library by name, and the SQL that gives the same rows."""

from __future__ import annotations

from mediafuse.plans import catalogue_queries, crosswalk_queries, fusion_queries, identity_queries, live_queries, operator_queries, search_queries, source_queries, stream_queries, text_queries  # noqa: F401  these register themselves
from mediafuse.plans.catalog import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
