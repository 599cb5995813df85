"""Collects the named queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from holdfast.catalog.profile_sql import EVENTS, PROFILE

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def profile_sql(body: str) -> str:
    """Put the profile definition in front; ``body`` is ``select ...`` or ``, more as (...) select ...``."""
    return f"with profile as ({PROFILE}) {body.strip()}"


def events_sql(body: str) -> str:
    return f"with ev as ({EVENTS}) {body.strip()}"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return add
