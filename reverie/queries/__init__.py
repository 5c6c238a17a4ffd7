"""Queries of the analytics operators on the driver's tables."""

from . import joins, layers, scalars, series  # noqa: F401  registers the queries
from .base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
