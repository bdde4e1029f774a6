"""All registered queries of the mention engine and their DuckDB counterparts."""

from __future__ import annotations

from . import analytics_queries, guard_queries, recall_queries, text_queries

QUERIES: dict = {}
SQL: dict = {}
for part in (text_queries, recall_queries, guard_queries, analytics_queries):
    QUERIES |= part.QUERIES
    SQL |= part.SQL
