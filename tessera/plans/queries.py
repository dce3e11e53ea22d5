"""All queries of the engine."""

from __future__ import annotations

from . import document_queries, graph_queries, pipeline_queries  # noqa: F401  they register their queries
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
