"""Named queries over the driver tables and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Enter a query under a name, with its SQL if SQL can express it."""

    def keep(query: Query) -> Query:
        _QUERIES[name] = query
        if sql is not None:
            _SQL[name] = sql
        return query

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(x: Column, name: str) -> Column:
    """Doubles rounded to six places on both sides of a comparison."""
    return F.round(x.cast("double"), 6).alias(name)


def queries() -> dict[str, Query]:
    from tallywork.plans import collection_queries, extension_queries, io_queries, scalar_queries, statistics_queries, table_queries, text_queries  # noqa: F401

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)
