"""Aggregation helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_PIVOT_VALUES = 1_000


def money(column: str | Column) -> Column:
    """Cents-exact value, so a sum does not depend on the order of its addends."""
    c = F.col(column) if isinstance(column, str) else column
    return c.cast("decimal(18,2)")


def money_sum(column: str | Column) -> Column:
    return F.sum(money(column)).cast("double")


def pivot_values(df: DataFrame, column: str, limit: int = MAX_PIVOT_VALUES) -> list:
    """The sorted distinct values that become columns; refuses an unbounded list."""
    found = df.select(column).filter(F.col(column).isNotNull()).distinct().limit(limit + 1)
    values = [r[0] for r in found.collect()]
    if len(values) > limit:
        raise ValueError(f"{column} has more than {limit} values: not a pivot column")
    return sorted(values)


def pivot_dynamic(df: DataFrame, keys: list[str], column: str, agg: Column) -> DataFrame:
    return df.groupBy(*keys).pivot(column, pivot_values(df, column)).agg(agg)
