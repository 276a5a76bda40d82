"""Projections: arithmetic of columns and constants, and parts of dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ARITHMETIC = {
    "plus": lambda a, b: a + b,
    "minus": lambda a, b: a - b,
    "multiplies": lambda a, b: a * b,
    "divides": lambda a, b: a / b,
    "modulus": lambda a, b: a % b,
}


def arithmetic(how: str, left, right) -> Column:
    """``how`` of two operands; strings name columns, other values are constants. Integers divide to an integer, towards zero."""
    a, b = (F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x) for x in (left, right))
    return ARITHMETIC[how](a, b)


def integer_divides(left: str, right: str) -> Column:
    return F.expr(f"{left} DIV {right}")


def year(column: str) -> Column:
    return F.year(column)


def project(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select(*(c.alias(n) for n, c in columns.items()))
