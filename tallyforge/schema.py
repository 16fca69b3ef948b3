"""The record schema and the names that a query may use for its columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


class QueryError(ValueError):
    """A query that cannot mean anything: unknown column, wrong type, bad syntax."""


#: Time, number, message: the shape of every telemetry part.  Wall-clock parts use a timestamp, counters a long.
RECORD = T.StructType([T.StructField("ts", T.LongType(), False), T.StructField("value", T.LongType(), False), T.StructField("message", T.StringType(), False)])
RECORD_CLOCK = T.StructType([T.StructField("ts", T.TimestampType(), False), *RECORD.fields[1:]])

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_ORDERED = (*_INTEGERS, T.TimestampType, T.TimestampNTZType, T.DecimalType)


def column_name(df: DataFrame, column: str | int) -> str:
    """The name of a column given by name or by position (from 0)."""
    if isinstance(column, int):
        if not 0 <= column < len(df.columns):
            raise QueryError(f"there is no column {column}; there are {len(df.columns)}")
        return df.columns[column]
    if column not in df.columns:
        raise QueryError(f"there is no column {column!r}; there are {', '.join(df.columns)}")
    return column


def _typed(df: DataFrame, column: str | int, kinds: tuple, what: str) -> str:
    name = column_name(df, column)
    kind = df.schema[name].dataType
    if not isinstance(kind, kinds):
        raise QueryError(f"column {name!r} is {kind.simpleString()}, not {what}")
    return name


def integer_column(df: DataFrame, column: str | int) -> str:
    return _typed(df, column, _INTEGERS, "an integer")


def ordered_column(df: DataFrame, column: str | int) -> str:
    return _typed(df, column, (*_ORDERED, T.FloatType, T.DoubleType), "a number or a time")


def text_column(df: DataFrame, column: str | int) -> str:
    return _typed(df, column, (T.StringType,), "text")
