"""Global and grouped aggregates. Spark reduces each partition before it shuffles groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkmill.catalog import exact_sum

__all__ = ["count_all", "exact_sum", "global_aggregate", "grouped", "having", "product"]


def count_all() -> Column:
    return F.count(F.lit(1))


def product(column: str) -> Column:
    return F.product(column)


def global_aggregate(df: DataFrame, **values: Column) -> DataFrame:
    """One row, also for no input (sums are null then, counts 0)."""
    return df.agg(*(v.alias(n) for n, v in values.items()))


def grouped(df: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    return df.groupBy(*keys).agg(*(v.alias(n) for n, v in values.items()))


def having(df: DataFrame, keys: list[str], values: dict[str, Column], condition: Column) -> DataFrame:
    return grouped(df, keys, values).where(condition)
