"""Streams: ingestion into parts, tables that grow, windows, joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..session import folders, remove, shared_path
from ..sources.parts import merge_parts, read_part, write_part


def stream_parts(spark: SparkSession, path: str, schema: T.StructType, files: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("pathGlobFilter", files)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", str(files_per_batch))
    return reader.parquet(path)


def ingest(stream: DataFrame, into: str, checkpoint: str, ts: str = "ts", *ties: str) -> StreamingQuery:
    """Each micro-batch becomes one sorted part below ``into``, named by its number: a batch that is run again
    after a failure overwrites its own part.  The checkpoint is the log that recovery starts from."""

    def flush(batch: DataFrame, number: int) -> None:
        held = batch.persist()  # ranges are sampled before rows are dealt: the source is read once
        write_part(held, f"{into}/batch={number}", ts, *ties, mode="overwrite")
        held.unpersist()

    return stream.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class LiveTable:
    """A table that grows: each micro-batch is at once part of it, as rows in flight; from ``flush_rows`` of these on
    they become a sorted part, and ``merge_parts_at`` parts become one.

    Below ``at``, ``tail`` holds batches as they came and ``parts`` sorted ones, named by the batches that they cover, so
    that work that is done again after a failure replaces itself, and what a larger part covers counts once.
    """

    def __init__(self, spark: SparkSession, at: str, schema: T.StructType, ts: str = "ts", *ties: str, flush_rows: int = 1 << 20, merge_parts_at: int = 8):
        self.spark, self.at, self.schema, self.ts, self.ties = spark, at, schema, ts, ties
        self.flush_rows, self.merge_at = flush_rows, merge_parts_at

    def ingest(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self._take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def parts(self) -> list[tuple[int, int]]:
        """(first, last) batch of each part that counts."""
        spans = [tuple(map(int, n.split("=")[1].split("-"))) for n in folders(self.spark, f"{self.at}/parts")]
        return sorted(s for s in spans if not any(o != s and o[0] <= s[0] and s[1] <= o[1] for o in spans))

    def in_flight(self) -> list[int]:
        """Batches that no part covers yet."""
        done = max((last for _, last in self.parts()), default=-1)
        return sorted(n for n in (int(x.split("=")[1]) for x in folders(self.spark, f"{self.at}/tail")) if n > done)

    def read(self) -> DataFrame:
        """Everything that has come in: parts and rows in flight."""
        paths = [self._part(s) for s in self.parts()] + [self._tail(n) for n in self.in_flight()]
        return read_part(self.spark, *paths, schema=self.schema) if paths else self.spark.createDataFrame([], self.schema)

    def _part(self, span: tuple[int, int]) -> str:
        return f"{self.at}/parts/batches={span[0]:012d}-{span[1]:012d}"

    def _tail(self, n: int) -> str:
        return f"{self.at}/tail/batch={n:012d}"

    def _take(self, batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(self._tail(number))
        waiting = self.in_flight()
        rows = read_part(self.spark, *[self._tail(n) for n in waiting], schema=self.schema) if waiting else None
        if rows is not None and rows.count() >= self.flush_rows:
            write_part(rows, self._part((waiting[0], waiting[-1])), self.ts, *self.ties, mode="overwrite")
            self.compact()
        for n in (int(x.split("=")[1]) for x in folders(self.spark, f"{self.at}/tail")):
            if n not in waiting or any(a <= n <= b for a, b in self.parts()):
                remove(self.spark, self._tail(n))

    def compact(self) -> None:
        """Merge the parts if there are many; those that the new one covers go."""
        spans = self.parts()
        if len(spans) >= self.merge_at:
            merge_parts(self.spark, [self._part(s) for s in spans], self._part((spans[0][0], spans[-1][1])), self.ts, *self.ties, mode="overwrite")
        live = set(self.parts())
        for name in folders(self.spark, f"{self.at}/parts"):
            if tuple(map(int, name.split("=")[1].split("-"))) not in live:
                remove(self.spark, f"{self.at}/parts/{name}")


def _watermarked(events: DataFrame, ts: str, delay: str | None) -> DataFrame:
    return events.withWatermark(ts, delay) if delay else events


def tumbling(events: DataFrame, ts: str, width: str, *by: str, slide: str | None = None, delay: str | None = None, **aggregates: Column) -> DataFrame:
    """window_start and the groups' aggregates, in tumbling windows, or sliding ones.  With ``delay`` a window's state goes
    once events are so much newer; what comes later for it is dropped."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    found = _watermarked(events, ts, delay).groupBy(w.alias("w"), *by).agg(*[c.alias(n) for n, c in (aggregates or {"n": F.count(F.lit(1))}).items()])
    return found.select(F.col("w.start").alias("window_start"), *by, *(aggregates or ["n"]))


def sessions(events: DataFrame, ts: str, gap: str, *by: str, delay: str | None = None) -> DataFrame:
    """session_start, session_end and n of each key's runs of events no further apart than the gap (streams need a key)."""
    found = _watermarked(events, ts, delay).groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return found.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *by, "n")


def distinct_within(events: DataFrame, ts: str, delay: str, *keys: str) -> DataFrame:
    """The first event of each key; state is kept as long as late events may come."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def stream_join(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, within: str, delay: str, how: str = "inner") -> DataFrame:
    """Two streams: right events of the same key at, or up to ``within`` after, a left event.  Both sides' state is bounded
    by the watermarks and the interval.  Other columns must differ in name."""
    a, b = left.withWatermark(left_ts, delay).alias("a"), right.withWatermark(right_ts, delay).alias("b")
    near = (F.col(f"b.{right_ts}") >= F.col(f"a.{left_ts}")) & (F.col(f"b.{right_ts}") <= F.col(f"a.{left_ts}") + F.expr(f"INTERVAL {within}"))
    joined = a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & near, how)
    return joined.select(*[F.col(f"a.{c}") for c in left.columns], *[F.col(f"b.{c}") for c in right.columns if c != key])


def drain(result: DataFrame, mode: str = "complete", *keys: str, again: Callable[[], None] | None = None) -> DataFrame:
    """Run a stream to the end of what is there now; the result as a table in the shared folder.  With ``again`` (which
    may bring in more) it then runs once more, from its log.

    In complete mode each batch overwrites the last; in append and update mode each batch writes its own folder once, and
    in update mode the latest row of each of ``keys`` counts.
    """
    spark = result.sparkSession
    out = shared_path(spark, "stream")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={number}")

    log = shared_path(spark, "log")
    for more in (None, again) if again else (None,):
        if more:
            more()
        result.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
    if mode != "update":
        return read_part(spark, out, schema=result.schema).select(*result.columns)
    found = read_part(spark, out, schema=T.StructType([*result.schema.fields, T.StructField("batch", T.LongType())]))
    last = found.groupBy(*keys).agg(F.max_by(F.struct(*result.columns), "batch").alias("row"))
    return last.select(*[F.col(f"row.`{c}`").alias(c) for c in result.columns])


def health_table(spark: SparkSession, query: StreamingQuery) -> DataFrame:
    """A row per micro-batch of a stream: its number, and the rows that it took in."""
    rows = [(int(p["batchId"]), int(p["numInputRows"])) for p in query.recentProgress]
    return spark.createDataFrame(rows, "batch long, n_rows long")


def health(query: StreamingQuery) -> dict:
    """Rates and backlog of a running stream, from its last progress."""
    p = query.lastProgress or {}
    return {k: p.get(k) for k in ("batchId", "numInputRows", "inputRowsPerSecond", "processedRowsPerSecond", "durationMs")}
