"""Registry of queries, and how they read the driver's tables.

The tables are a trading schema, so each operator runs on a structural analogue
or on literal samples dealt over the rows of a table by key.  Dates are literals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

ORDERS_ASOF, EVENTS_ASOF = "2001-06-30", "2024-01-30 00:00:00"


def query(sql: str | None):
    """Register a query under its function's name, with the SQL that must agree."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt over all cores by key, for much work on the rows of small files, which few tasks would read."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def c(name: str) -> Column:
    return F.col(name)


def literal(x) -> str:
    """A value of a sample in SQL."""
    if x is None:
        return "NULL"
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x).upper() if isinstance(x, bool) else repr(x)


def expected(names: str, rows: list[tuple], table: str = "part", key: str = "p_partkey") -> str:
    """SQL that deals results worked out by hand over the rows of a table: row k of ``rows`` goes to the keys that are k modulo their number."""
    values = ", ".join(f"({k}, {', '.join(map(literal, row))})" for k, row in enumerate(rows))
    return f"SELECT {key}, {names} FROM {table} JOIN (VALUES {values}) AS v(k, {names}) ON {key} % {len(rows)} = k"


def dealt(spark: SparkSession, sf_dir: str, *samples: list, table: str = "part", key: str = "p_partkey") -> DataFrame:
    """Samples dealt over the rows of a table in the same way, as columns ``x0``, ``x1``, ..."""
    picked = [F.element_at(F.array(*map(F.lit, s)), (F.col(key) % len(s) + 1).cast("int")).alias(f"x{i}") for i, s in enumerate(samples)]
    return t(spark, sf_dir, table).select(key, *picked)
