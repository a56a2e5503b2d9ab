"""The named queries of the engine and their SQL."""

from __future__ import annotations

from importlib import import_module


def _modules() -> list:
    return [import_module(f"{__name__}.{m}") for m in ("etl", "retrieval", "operations")]


def queries() -> dict:
    return {k: v for m in _modules() for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in _modules() for k, v in m.SQL.items()}
