"""All queries of the engine by name, each with the same query in SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with its SQL."""

    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


for _module in ("advantages", "trees", "texts", "tokens", "retrieval", "curation", "audits", "joins", "logs", "batches", "gates", "forms", "selection", "rewards", "services", "checks", "distill", "measures"):
    import_module(f".{_module}", __package__)
