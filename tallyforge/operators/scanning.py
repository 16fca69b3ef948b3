"""Substring reports over raw text: every pattern in one pass."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import occurrences
from ..sources.logs import existing, read_lines


def count_pattern(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """One row: hits, over all rows."""
    return df.agg(F.coalesce(F.sum(occurrences(column, pattern)), F.lit(0)).cast("long").alias("hits"))


def indicator_report(df: DataFrame, column: str, patterns: list[str], *by: str) -> DataFrame:
    """pattern, hits (for each group of ``by``): one sum for each pattern in one scan, then turned into rows.

    Most texts hold no pattern, so without groups they go before anything is summed (with groups they
    stay, as a group without hits is reported too).
    """
    if not by and patterns:
        df = df.filter(reduce(operator.or_, [F.col(column).contains(F.lit(p)) for p in patterns]))
    sums = [F.coalesce(F.sum(occurrences(column, p)), F.lit(0)).cast("long").alias(f"__{i}") for i, p in enumerate(patterns)]
    wide = df.groupBy(*by).agg(*sums)
    long = F.explode(F.array(*[F.struct(F.lit(p).alias("pattern"), F.col(f"__{i}").alias("hits")) for i, p in enumerate(patterns)]))
    return wide.select(*by, long.alias("r")).select(*by, "r.*")


def scan_files(spark: SparkSession, paths: list[str], patterns: list[str]) -> DataFrame:
    """file, pattern, hits; files that are missing are left out."""
    found = existing(spark, paths)
    if not found:
        return spark.createDataFrame([], "file string, pattern string, hits long")
    return indicator_report(read_lines(spark, *found), "line", patterns, "file")
