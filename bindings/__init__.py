"""The library's operators bound to the driver tables, with the same question in ANSI SQL.

Each module calls :func:`query` for its operators; ``QUERIES`` and ``SQL`` are what
``__spark_entry__`` hands to the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name``, with its SQL twin when there is one."""

    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"{name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One driver table."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def load_all() -> None:
    """Import every binding module."""
    import importlib

    for module in MODULES:
        importlib.import_module(f"bindings.{module}")


MODULES = ("intake", "candidates", "outlines", "stats", "scoring", "training", "sessions", "streams", "scenes")
