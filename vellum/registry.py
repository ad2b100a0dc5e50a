"""The engine's named queries, their SQL, and the operators of the inventory that they apply."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
#: Modules that register queries when imported.
MODULES = ("operators.words", "operators.marks", "operators.segments", "operators.rules", "operators.windows", "operators.scalars", "operators.html", "operators.procedural", "operators.streams", "operators.files")
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_IDS: dict[str, list[str]] = {}
_ABOUT: dict[str, str] = {}


def register(name: str, run: Query, sql: str | None = None, ids: list[str] | None = None, about: str = "") -> None:
    if name in _QUERIES:
        raise ValueError(f"query {name} is registered twice")
    _QUERIES[name], _IDS[name], _ABOUT[name] = run, ids or [], about
    if sql:
        _SQL[name] = sql


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"vellum.{module}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def inventory() -> dict[str, tuple[list[str], str]]:
    """Each query's operator identifiers and description."""
    _load()
    return {name: (_IDS[name], _ABOUT[name]) for name in _QUERIES}
