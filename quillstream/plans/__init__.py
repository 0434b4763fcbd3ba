"""Registered queries."""

from .catalog import QUERIES, SQL
from . import catalog_more, catalog_text  # noqa: F401  register their queries

__all__ = ["QUERIES", "SQL"]
