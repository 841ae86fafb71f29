"""Queries of the core library and their SQL."""

from __future__ import annotations

from .plans import more  # noqa: F401  registers its queries
from .plans.queries import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
