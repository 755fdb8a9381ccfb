"""Named queries over the driver's tables, with the SQL that checks them."""

from __future__ import annotations

from importlib import import_module

from airspark.catalog.registry import QUERIES, SQL

MODULES = ["values", "summaries", "tables", "learning", "modeling", "fixed"]


def load() -> tuple[dict, dict]:
    """All queries and all check queries, by name."""
    for module in MODULES:
        import_module(f"airspark.catalog.{module}")
    return QUERIES, SQL
