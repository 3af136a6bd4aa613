"""Short builders for expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

col = F.col


def lit_i64(value: int) -> Column:
    return F.lit(value).cast("bigint")


def lit_f64(value: float) -> Column:
    return F.lit(float(value))


def lit_bool(value: bool) -> Column:
    return F.lit(bool(value))


def lit_str(value: str) -> Column:
    return F.lit(str(value))


def eq(a: Column, b: Column) -> Column:
    return a == b


def and_(a: Column, b: Column) -> Column:
    return a & b


def or_(a: Column, b: Column) -> Column:
    return a | b


def not_(a: Column) -> Column:
    return ~a


def div(a: Column, b: Column) -> Column:
    """Always a real quotient; division by zero is an error, as elsewhere in Spark."""
    return a.cast("double") / b.cast("double")
