"""Named queries over the test tables, and DuckDB SQL that gives the same rows."""

from __future__ import annotations

from .plans import algebra_queries, classify_queries, count_queries, keyed_queries, source_queries, tag_queries, text_queries, vector_queries  # noqa: F401
from .plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
