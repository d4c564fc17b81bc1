"""All queries of the engine and their DuckDB twins."""

from __future__ import annotations

import importlib
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}
MODULES = ("facts", "logs", "aggregates", "usage", "joins", "graph", "search", "state", "verify", "movement", "text", "star")


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name, with its oracle."""

    def add(fn):
        if fn.__name__ in QUERIES:
            raise ValueError(f"two queries are named {fn.__name__}")
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def load() -> None:
    """Import the modules that register queries."""
    for m in MODULES:
        importlib.import_module(f"lorekeep.plans.{m}")
