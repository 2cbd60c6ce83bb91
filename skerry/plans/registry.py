"""The registered queries and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
MODULES = ("queries", "closed_forms", "law_queries", "join_queries", "large_queries")


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) by its name, with the same result as SQL if there is one."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """The columns rounded, without a minus on zero."""
    for c in columns:
        df = df.withColumn(c, F.round(c, digits) + 0.0)
    return df


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"skerry.plans.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)
