"""Aggregates of the query surface: sums and maxima over no rows are 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.wrapping import wrapping_sum
from ..schema import integer_column, ordered_column


def count_rows() -> Column:
    return F.count(F.lit(1))


def sum_or_zero(df: DataFrame, column: str | int, wrap: bool = False) -> Column:
    """Overflow is an error, or wraps around in 64 bits if asked to."""
    name = integer_column(df, column)
    return F.coalesce(wrapping_sum(name) if wrap else F.sum(F.col(name).cast("long")), F.lit(0).cast("long"))


def max_or_zero(df: DataFrame, column: str | int) -> Column:
    return F.coalesce(F.max(F.col(integer_column(df, column)).cast("long")), F.lit(0).cast("long"))


def min_or_zero(df: DataFrame, column: str | int) -> Column:
    return F.coalesce(F.min(F.col(integer_column(df, column)).cast("long")), F.lit(0).cast("long"))


def mean(df: DataFrame, column: str | int) -> Column:
    """Null over no rows; unlike a sum, a mean of nothing is not 0."""
    return F.avg(F.col(ordered_column(df, column)))


def count_where(predicate: Column) -> Column:
    return F.count_if(predicate)


def summarise(df: DataFrame, *keys: str, **aggregates: Column) -> DataFrame:
    """Grouped aggregates; without keys one row."""
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()])


def top(df: DataFrame, k: int, *order: Column, skip: int = 0) -> DataFrame:
    """The first k rows in an order, after those to skip: each task keeps k + skip, so nothing is sorted as a whole."""
    rows = df.orderBy(*order)
    return (rows.offset(skip) if skip else rows).limit(k)
