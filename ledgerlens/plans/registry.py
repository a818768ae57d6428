"""Query registry: name -> (Spark callable(spark, sf_dir), DuckDB oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return deco


def alias(name: str, target: str) -> None:
    """Register ``name`` as the same query (and oracle) as ``target``."""
    QUERIES[name] = QUERIES[target]
    if target in ORACLES:
        ORACLES[name] = ORACLES[target]


def load_all() -> None:
    # Importing the modules fills the registry.
    from ledgerlens.plans import q_closed_forms, q_graph, q_model, q_reduce, q_relational  # noqa: F401
