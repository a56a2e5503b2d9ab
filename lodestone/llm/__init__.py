"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

_HOMES = {
    "p1_found": "split",
    "p1_pieces": "split",
    "p2_found": "survivors",
    "p2_merged": "survivors",
    "p3_found": "pii",
    "p3_redacted": "pii",
    "p4_found": "knn",
    "p4_knn": "knn",
    "p5_found": "neardup",
    "p6_found": "ocr",
    "p6_paragraphs": "ocr",
    "p7_found": "history",
    "p8_ids": "encode",
    "p9_containers": "pack",
    "p10_found": "residue",
}


def _late(module: str, name: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return getattr(import_module(f"{__name__}.{module}"), name)(spark, sf_dir)

    query.__name__ = name
    return query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _late(module, name) for name, module in _HOMES.items()}


def oracle_sql() -> dict[str, str]:
    return {}
