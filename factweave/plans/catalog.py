"""Registry of the named queries and their side-by-side SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
GROUPS = ("facts", "text", "graph", "similarity", "discovery", "evaluation", "retrieval", "decision", "answering", "ingestion", "rules")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name."""
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def load() -> None:
    for group in GROUPS:
        import_module(f"factweave.plans.queries_{group}")
