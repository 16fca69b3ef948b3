"""Filters as plain columns, so that Catalyst pushes them into the scan."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import QueryError, ordered_column, text_column


def greater(df: DataFrame, column: str | int, threshold) -> Column:
    return F.col(ordered_column(df, column)) > F.lit(threshold)


def in_range(df: DataFrame, column: str | int, low, high) -> Column:
    """Both ends belong to the range; with low above high nothing does."""
    return F.col(ordered_column(df, column)).between(F.lit(low), F.lit(high))


def contains(df: DataFrame, column: str | int, pattern: str) -> Column:
    """Case-sensitive; the empty pattern is an error."""
    if not pattern:
        raise QueryError("the pattern is empty")
    return F.col(text_column(df, column)).contains(F.lit(pattern))


def starts_with(df: DataFrame, column: str | int, pattern: str) -> Column:
    if not pattern:
        raise QueryError("the pattern is empty")
    return F.col(text_column(df, column)).startswith(F.lit(pattern))


def every(*predicates: Column) -> Column:
    """All of them; none at all keeps every row."""
    return reduce(operator.and_, predicates, F.lit(True))
