"""Registry of queries: a Spark callable beside the SQL that checks it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Modules whose import registers queries.
MODULES = ("rank_queries", "agg_queries", "text_queries", "join_queries", "flow_queries", "filter_queries")

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register fn(spark, sf_dir) under name; oracle: equivalent SQL, if SQL can say it."""

    def put(fn):
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = fn
        if oracle:
            _ORACLES[name] = oracle
        return fn

    return put


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"skein.plans.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
