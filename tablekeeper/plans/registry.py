"""Registry of named queries and their DuckDB oracle SQL.

Each registered callable takes ``(spark, sf_dir)`` and returns a DataFrame
built from the driver tables under ``sf_dir``.  The oracle string is plain SQL
over the same tables (registered as views by name), used for side-by-side
checking.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle.strip()
        fn.query_name = name
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def load_all() -> None:
    """Import every module that registers queries."""
    from tablekeeper.plans import (  # noqa: F401
        q_layers, q_profile, q_checks, q_lineage, q_diagnose, q_fixes, q_history,
        q_sources, q_stream, flagship,
    )
