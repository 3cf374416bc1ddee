"""The registered queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from netweave.sources.views import sql_text

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is the same result in the checking engine's SQL."""
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql_text(sql, "duckdb")
        return fn
    return add


def load_all() -> None:
    """Import every module that registers queries."""
    from netweave.plans import alertstore, cleaning, detection, flowing, learning, streams  # noqa: F401
