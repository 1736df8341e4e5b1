"""Registered queries: one Spark plan and one equivalent SQL text per key.

Every query reads the given test tables through the 12-table mapping
(``stockflow.sources.testdata``) and runs over whole tables. The SQL side is
the same mapping as a ``WITH`` prefix followed by the query over the model
tables, in plain ANSI SQL (DuckDB dialect where needed).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stockflow.sources.testdata import MAPPING_SQL, load_tables, with_mapping

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_SQL: dict[str, str] = {}


def register(key: str, sql: str | None = None, raw_sql: bool = False, recursive: bool = False):
    """Decorator: register ``fn(t) -> DataFrame`` (t = model tables) under ``key``.

    ``sql`` is the oracle text over the model tables (prefixed with the
    mapping), or over the raw test tables when ``raw_sql`` is set.
    """
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(load_tables(spark, sf_dir))
        run.__name__ = key
        run.__doc__ = fn.__doc__
        _QUERIES[key] = run
        if sql is not None:
            _SQL[key] = sql.strip() if raw_sql else with_mapping(sql, recursive=recursive)
        return fn
    return deco


def queries() -> dict[str, QueryFn]:
    _load_all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(_SQL)


def oracle_body(key: str) -> str:
    """The SQL of a registered query without the mapping before it."""
    return _SQL[key].removeprefix(MAPPING_SQL.strip()).lstrip(",\n")


def _load_all():
    # Importing the modules registers their queries.
    from stockflow.plans import catalog_queries, ledger_queries, operator_queries, quality_queries, report_queries  # noqa: F401
    from stockflow.streaming import queries as stream_queries  # noqa: F401
