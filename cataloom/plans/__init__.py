"""Queries over the driver's tables, and their SQL for DuckDB."""

from . import parsed  # noqa: F401  (registers its queries)
from .catalogue import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
