"""Named queries over the standard tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import importlib

GROUPS = ("customers", "reports", "learning", "events", "training")


def load():
    """All named queries and their SQL."""
    from holdfast.catalog import registry

    for group in GROUPS:
        importlib.import_module(f"holdfast.catalog.{group}")
    return registry.QUERIES, registry.SQL
