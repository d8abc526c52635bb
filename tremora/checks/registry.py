"""Named queries over the given tables, each with the SQL it is checked against where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

EXACT = 99
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Doubles rounded for comparison, because sums run in another order elsewhere; -0.0 becomes 0.0.

    Columns given EXACT digits are left alone: the same division of the same integers agrees to the bit.
    """
    picked: list[Column] = []
    for name, kind in df.dtypes:
        column, n = F.col(name), special.get(name, digits)
        picked.append((F.round(column, n) + F.lit(0.0)).alias(name) if kind == "double" and n != EXACT else column)
    return df.select(*picked)
