"""Verified queries: importing this package registers them all."""

from barloom.registry import companies, events, market, plans, streams  # noqa: F401
from barloom.registry.core import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
