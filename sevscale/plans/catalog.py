"""Named queries, each with the SQL another engine answers it by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with its SQL where there is one."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def load() -> tuple[dict[str, Query], dict[str, str]]:
    """Import every module that registers queries."""
    from sevscale.plans import (  # noqa: F401
        feature_queries,
        label_queries,
        metric_queries,
        model_queries,
        profile_queries,
        split_queries,
        stream_queries,
        text_queries,
    )

    return QUERIES, ORACLES
