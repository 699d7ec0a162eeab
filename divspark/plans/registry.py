"""Registry of queries over the driver's tables.

``register(name, sql)`` records a query ``(spark, sf_dir) -> DataFrame`` and,
when the operator is expressible in SQL, the oracle text run by an external
engine on the same parquet tables (views named after the tables).  Column
names are aliased identically on both sides.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}

_MODULES = (
    "divspark.plans.outlier_queries",
    "divspark.plans.text_queries",
    "divspark.plans.parse_queries",
    "divspark.plans.assembly_queries",
    "divspark.plans.word_queries",
    "divspark.plans.metric_queries",
    "divspark.plans.io_queries",
)


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def load_all() -> None:
    for m in _MODULES:
        importlib.import_module(m)


def queries() -> dict[str, QueryFn]:
    load_all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    load_all()
    return dict(ORACLES)
