"""Registry of runnable queries: name -> (spark, sf_dir) -> DataFrame, plus oracle SQL.

Each query reads the whole driver tables of ``sf_dir`` through the domain views
and applies one operator with the parameters listed next to it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    import importlib

    for mod in ("q_traffic", "q_market", "q_sequences", "q_patterns", "q_orders", "q_joins", "q_sources",
                "q_streaming"):
        try:
            importlib.import_module(f"{__package__}.{mod}")
        except ModuleNotFoundError as exc:
            if exc.name != f"{__package__}.{mod}":
                raise
