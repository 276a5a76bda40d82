"""Selections: a column against constants or columns, alternatives, conjunctions, ranges, substrings.

They are Column expressions, so they end in one generated predicate and, where they compare
a column with constants, in the Parquet scan.
"""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPARISONS = {"eq": operator.eq, "ge": operator.ge, "gt": operator.gt, "le": operator.le, "lt": operator.lt}


def _column(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def compare(column, how: str, value) -> Column:
    """``how``: eq, ge, gt, le or lt; ``value``: a constant, or a Column for a comparison of columns."""
    return COMPARISONS[how](_column(column), value if isinstance(value, Column) else F.lit(value))


def either(column, how: str, *values) -> Column:
    """The column compares with any of the values."""
    if how == "eq":
        return _column(column).isin(*values)
    return reduce(operator.or_, (compare(column, how, v) for v in values))


def every(*conditions: Column) -> Column:
    return reduce(operator.and_, conditions)


def between(column, low, high) -> Column:
    return _column(column).between(low, high)


def contains(column, part: str) -> Column:
    return _column(column).contains(part)


def starts_with(column, prefix: str) -> Column:
    return _column(column).startswith(prefix)


def select_rows(df: DataFrame, *conditions: Column) -> DataFrame:
    return df.where(every(*conditions)) if conditions else df
