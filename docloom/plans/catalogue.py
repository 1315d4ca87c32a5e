"""All queries of the library and their SQL, by name."""

from __future__ import annotations

from . import chunks, records, search, sources, streams, tables, texts  # noqa: F401  they register their queries
from .base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
