"""Putting telemetry into context: dimensions, points in time, drift, snapshots, nested fields."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.parts import numbered


def with_dimension(facts: DataFrame, dimension: DataFrame, on: str | list[str], how: str = "left") -> DataFrame:
    """An equi-join; the optimiser broadcasts the dimension where its measured size allows, and deals both
    sides by key (splitting skewed keys) where it does not."""
    return facts.join(dimension, on, how)


def as_of(left: DataFrame, right: DataFrame, on: list[str], left_ts: str, right_ts: str, values: list[str], ties: list[str] = (), bucket: str = "day") -> DataFrame:
    """For each left row the latest right row of its key at or before its time (``values``, null if none).

    Rows of a key are cut into buckets of time; inside a bucket the latest right row runs along, and each bucket
    starts from the last right row of the buckets before it, so that one busy key is many tasks.  Right rows
    of equal time are ordered by ``ties``.
    """
    held = F.struct(*[F.col(v).alias(v) for v in values])
    order = F.struct(F.col(right_ts).alias("ts"), *[F.col(t).alias(f"t{i}") for i, t in enumerate(ties)])
    none = F.lit(None)
    tags = right.select(*on, F.col(right_ts).alias("__ts"), F.lit(0).alias("__side"), held.alias("__held"), order.alias("__order"))
    both = tags.schema["__held"].dataType, tags.schema["__order"].dataType
    rows = left.select(*on, F.col(left_ts).alias("__ts"), F.lit(1).alias("__side"), F.struct(*[F.col(c) for c in left.columns]).alias("__left"))
    every = tags.withColumn("__left", none.cast(rows.schema["__left"].dataType)).unionByName(rows.withColumns({"__held": none.cast(both[0]), "__order": none.cast(both[1])}))
    every = every.withColumn("__bucket", F.date_trunc(bucket, "__ts"))
    inside = Window.partitionBy(*on, "__bucket").orderBy("__ts", "__side", "__order").rowsBetween(Window.unboundedPreceding, 0)
    running = every.withColumn("__found", F.last("__held", ignorenulls=True).over(inside)).filter("__side = 1")
    ends = every.groupBy(*on, "__bucket").agg(F.max_by("__held", "__order").alias("__end"))
    carry = Window.partitionBy(*on).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.withColumn("__start", F.last("__end", ignorenulls=True).over(carry)).drop("__end")
    joined = running.join(starts, [*on, "__bucket"], "left").withColumn("__got", F.coalesce("__found", "__start"))
    return joined.select(*[F.col(f"__left.{c}").alias(c) for c in left.columns], *[F.col(f"__got.{v}").alias(v) for v in values])


def range_join(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, width: float, how: str = "inner") -> DataFrame:
    """Points with the ranges that hold them (both ends included): an equi-join on buckets of ``width``, then the exact test."""
    bucket = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    spread = ranges.withColumn("__bucket", F.explode(F.sequence(bucket(low), F.greatest(bucket(low), bucket(high)))))
    met = points.withColumn("__bucket", bucket(at)).join(spread, "__bucket", how)
    return met.filter(F.col(at).between(F.col(low), F.col(high))).drop("__bucket")


#: Rows of one key that a window looks at in one task.
BLOCK_ROWS = 1 << 16


def drift(df: DataFrame, value: str, by: list[str], order: list[str], rows: int = 20, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds z: how many standard deviations a value lies from the mean of the rows before it (null: too few, or none varies).

    Rows are numbered in the order of ``by`` and ``order`` and cut into blocks, so that one busy key is many tasks; the
    last rows of each block go along with the next one.
    """
    if rows >= block_rows:
        raise ValueError("a block must hold more rows than a window")
    own = F.floor(F.col("__row") / block_rows)
    edge = F.col("__row") % block_rows >= block_rows - rows
    ordered = numbered(df, *by, *order)
    every = ordered.withColumn("__block", F.explode(F.when(edge, F.array(own, own + 1)).otherwise(F.array(own))))
    w = Window.partitionBy(*by, "__block").orderBy("__row").rowsBetween(-rows, -1)
    mean, sd = F.avg(value).over(w), F.stddev_samp(value).over(w)
    found = every.withColumn("z", F.when(sd > 0, (F.col(value) - mean) / sd))
    return found.filter(F.col("__block") == own).drop("__row", "__block")


def as_at(df: DataFrame, ingested: str, moment) -> DataFrame:
    """Time travel: the rows that had come in by a moment."""
    return df.filter(F.col(ingested) <= F.lit(moment))


def json_fields(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Fields of a JSON column beside the others; text that is no JSON gives nulls."""
    return df.withColumn("__json", F.from_json(column, schema)).select(*df.columns, "__json.*")


def best_setting(df: DataFrame, by: str, setting: str, outcome: str) -> DataFrame:
    """For each group the setting whose mean outcome is highest (ties: the larger setting)."""
    means = df.groupBy(by, setting).agg(F.avg(outcome).alias("mean_outcome"))
    return means.groupBy(by).agg(F.max_by(setting, F.struct("mean_outcome", setting)).alias("best_setting"), F.max("mean_outcome").alias("mean_outcome"))


def running(df: DataFrame, value: str, by: list[str], order: list[str], name: str = "total", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds the sum of ``value`` up to each row of its key.  Blocks are summed first, and each starts from the sum of
    those before it, so that one busy key is many tasks."""
    ordered = numbered(df, *by, *order).withColumn("__block", F.floor(F.col("__row") / block_rows))
    inside = F.sum(value).over(Window.partitionBy(*by, "__block").orderBy("__row").rowsBetween(Window.unboundedPreceding, 0))
    sums = ordered.groupBy(*by, "__block").agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*[F.col(b).alias(f"__{b}") for b in by], F.col("__block").alias("__of"), F.sum("__sum").over(before).alias("__before"))
    same = reduce(operator.and_, [F.col(b).eqNullSafe(F.col(f"__{b}")) for b in by], F.col("__block") == F.col("__of"))
    joined = ordered.withColumn("__inside", inside).join(starts, same)
    total = F.when(F.col("__before").isNull(), F.col("__inside")).when(F.col("__inside").isNull(), F.col("__before")).otherwise(F.col("__before") + F.col("__inside"))
    return joined.select(*df.columns, total.alias(name))
