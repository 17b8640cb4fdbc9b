"""Query registry: every registered job paired with its DuckDB oracle SQL.

A job is ``fn(spark, sf_dir) -> DataFrame`` over the driver tables; the oracle
is the same computation in SQL over the same parquet tables (or ``None`` where
the job runs Python code or is not expressible in SQL).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Job = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Job] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None) -> Callable[[Job], Job]:
    def deco(fn: Job) -> Job:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def sql_list(values) -> str:
    """SQL literal list ``('a', 'b')`` for fixed config values."""
    return "(" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + ")"


def sql_str(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"
