"""Registered queries of the context operators, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import analytics_queries, dedup_queries, index_queries, live_queries, payload_queries, retrieval_queries, state_queries

MODULES = (index_queries, dedup_queries, payload_queries, live_queries, analytics_queries, retrieval_queries, state_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for m in MODULES for f in m.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
