"""Where queries register, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, *tables: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Registers a function of tables under its name, with the SQL that gives the same rows."""

    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register
