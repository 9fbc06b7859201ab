"""Names of the library's queries, their builders and their oracle SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]
MODULES = ("relational_queries", "search_queries", "graph_queries", "tree_queries", "source_queries", "incremental_queries")
_QUERIES: dict[str, Builder] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None) -> Callable[[Builder], Builder]:
    """Enters a query, and the DuckDB statement that gives the same rows, under a name."""

    def enter(build: Builder) -> Builder:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = build
        if oracle is not None:
            _ORACLES[name] = oracle
        return build

    return enter


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"lodestone.plans.{module}")


def queries() -> dict[str, Builder]:
    """Every query of the library outside the training-data subpackage."""
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """The DuckDB statement of every query that has one."""
    _load()
    return dict(_ORACLES)
