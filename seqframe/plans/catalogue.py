"""Queries of the engine's operators over the driver's tables, each beside equivalent DuckDB SQL where SQL can express it."""

from __future__ import annotations

from . import dataflow_queries, file_queries, search_queries, sequence_queries  # noqa: F401  they register their queries
from .base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
