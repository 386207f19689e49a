"""All registered queries: name -> (DataFrame plan, equivalent SQL)."""

from __future__ import annotations

from . import analysis, decisions, health, parts, search, values  # noqa: F401  registering
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
