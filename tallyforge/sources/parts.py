"""Parts: directories of Parquet files in order of time, whose pages can be skipped by time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import QueryError
from ..session import settle

#: Rows in a page, the unit that a time range can skip.
PAGE_ROWS = 8192
#: Low bits of Spark's monotonic ids: the place in a partition; the partition's number is above them.
ID_BITS = 33


def write_part(df: DataFrame, path: str, ts: str = "ts", *ties: str, files: int | None = None, codec: str = "zstd", page_rows: int = PAGE_ROWS, rows_per_file: int = 0, mode: str = "errorifexists") -> None:
    """Sort by time (ties by the other columns named) and write.  Files hold ranges of time; no row is lost.

    A range exchange and local sorts replace one global sort, so that writing needs one shuffle and each file
    covers its own stretch of time.
    """
    order = [F.col(c) for c in (ts, *ties)]
    spread = df.repartitionByRange(files, *order) if files else df.repartitionByRange(*order)
    writer = spread.sortWithinPartitions(*order).write.mode(mode).option("compression", codec).option("parquet.page.row.count.limit", str(page_rows))
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", str(rows_per_file))
    writer.parquet(path)


def read_part(spark: SparkSession, *paths: str, schema: T.StructType | None = None) -> DataFrame:
    """One part or several as one table; a path that is missing is an error."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(*paths)


def merge_parts(spark: SparkSession, paths: list[str], out: str, ts: str = "ts", *ties: str, **how) -> DataFrame | None:
    """Compact parts into a new one; columns meet by name and must agree in type.  The inputs stay.  No parts: nothing."""
    if not paths:
        return None
    if out.rstrip("/") in {p.rstrip("/") for p in paths}:
        raise QueryError("a part cannot be merged into itself")
    parts = [read_part(spark, p) for p in paths]
    kinds = {f.name: f.dataType for f in parts[0].schema}
    for p, df in zip(paths, parts, strict=True):
        if {f.name: f.dataType for f in df.schema} != kinds:
            raise QueryError(f"{p} has another schema than {paths[0]}")
    write_part(reduce(DataFrame.unionByName, parts), out, ts, *ties, **how)
    return read_part(spark, out)


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """Adds __row, the place from 0 in a global order, without bringing all rows to one task.

    Rows are range-partitioned, sorted where they are, and written once with Spark's own ids (partition, then place);
    a prefix sum over the partitions' counts (one row for each) gives where each partition starts.
    """
    keys = [F.col(c) for c in order]
    spread = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__id", F.monotonically_increasing_id())
    kept = settle(spread, "numbered").withColumn("__part", F.shiftright("__id", ID_BITS))
    counts = kept.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as partitions
    starts = counts.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    inside = F.col("__id") - F.shiftleft("__part", ID_BITS)
    return kept.join(starts, "__part").withColumn("__row", F.col("__start") + inside).drop("__part", "__start", "__id")


def granule_index(df: DataFrame, ts: str = "ts", *ties: str, rows: int = PAGE_ROWS) -> DataFrame:
    """granule_id, min_ts, max_ts, n_rows of consecutive rows in order of time."""
    narrow = df.select(ts, *[t for t in ties if t != ts])
    return numbered(narrow, ts, *ties).groupBy(F.floor(F.col("__row") / rows).cast("long").alias("granule_id")).agg(F.min(ts).alias("min_ts"), F.max(ts).alias("max_ts"), F.count(F.lit(1)).alias("n_rows"))


def prune_granules(index: DataFrame, low, high) -> DataFrame:
    """Granules that a range of time (both ends included) can touch."""
    return index.filter((F.col("max_ts") >= F.lit(low)) & (F.col("min_ts") <= F.lit(high)))


def pruning_report(index: DataFrame, low, high) -> DataFrame:
    """matched, total and skipped granules for a range of time."""
    touched = (F.col("max_ts") >= F.lit(low)) & (F.col("min_ts") <= F.lit(high))
    return index.agg(F.count_if(touched).alias("matched"), F.count(F.lit(1)).alias("total"), F.count_if(~touched).alias("skipped"))


def file_sizes(spark: SparkSession, path: str) -> tuple[int, int]:
    """Number and bytes of a part's files; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    return tuple(files.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first())


def codec_sizes(df: DataFrame, path: str, codecs: list[str], ts: str = "ts", *ties: str) -> DataFrame:
    """codec, n_rows, n_bytes of the same rows written as a part with each codec below ``path``."""
    spark, found = df.sparkSession, []
    for c in codecs:
        write_part(df, f"{path}/{c}", ts, *ties, codec=c)
        rows = read_part(spark, f"{path}/{c}").agg(F.count(F.lit(1)).alias("n_rows"))
        found.append(rows.select(F.lit(c).alias("codec"), "n_rows", F.lit(file_sizes(spark, f"{path}/{c}")[1]).cast("long").alias("n_bytes")))
    return reduce(DataFrame.unionByName, found)


def status(spark: SparkSession, path: str) -> DataFrame:
    """What a part holds: whether there are files, their number and bytes, rows and columns, and the page size that parts
    are written with."""
    df = read_part(spark, path)
    n, size = file_sizes(spark, path)
    facts = [F.lit("online" if n else "empty").alias("state"), F.lit(n).cast("long").alias("n_files"), F.lit(size).cast("long").alias("n_bytes")]
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(*facts, "n_rows", F.lit(len(df.columns)).alias("n_columns"), F.lit(PAGE_ROWS).alias("page_rows"))
