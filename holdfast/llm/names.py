"""Names for helper columns."""

from __future__ import annotations

from pyspark.sql import DataFrame


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, with underscores added until ``docs`` has no such column."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name
