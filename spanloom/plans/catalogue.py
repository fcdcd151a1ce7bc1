"""All queries and their SQL."""

from __future__ import annotations

from spanloom.plans import checks, oracle, oracle_checks, oracle_rules, tables
from spanloom.plans.queries import QUERIES

__all__ = ["QUERIES", "SQL", "checks", "tables"]

SQL: dict[str, str] = oracle.SQL | oracle_checks.SQL | oracle_rules.SQL
