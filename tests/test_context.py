"""Context joins, drift, and streams."""

import datetime as dt
import random
import statistics

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.operators import aggregates as A
from tallyforge.operators import context as C
from tallyforge.session import shared_path
from tallyforge.sources import parts
from tallyforge.streaming import live

T0 = dt.datetime(2024, 1, 1)


def test_as_of_is_the_latest_before(spark):
    random.seed(4)
    at = lambda: T0 + dt.timedelta(hours=random.randrange(200))
    left = [(i, random.choice("abc"), at()) for i in range(150)]
    right = [(random.choice("abd"), at(), i) for i in range(80)]
    got = C.as_of(spark.createDataFrame(left, "i int, k string, t timestamp"), spark.createDataFrame(right, "k string, rt timestamp, v int"), ["k"], "t", "rt", ["v"], ["v"])
    want = {i: max(((rt, v) for rk, rt, v in right if rk == k and rt <= t), default=(None, None))[1] for i, k, t in left}
    assert {r.i: r.v for r in got.collect()} == want


def test_range_join(spark):
    points = spark.range(100).select(F.col("id").cast("double").alias("x"))
    ranges = spark.createDataFrame([(1.0, 3.0, "a"), (2.5, 50.0, "b"), (9.0, 5.0, "empty")], "lo double, hi double, name string")
    got = C.range_join(points, ranges, "x", "lo", "hi", 7.0).groupBy("name").count().collect()
    assert {r["name"]: r["count"] for r in got} == {"a": 3, "b": 48}


def test_drift(spark):
    rows = [(i, 1.0 if i % 2 else 2.0) for i in range(30)] + [(30, 50.0)]
    got = {r.i: r.z for r in C.drift(spark.createDataFrame(rows, "i int, v double"), "v", [], ["i"], 10).collect()}
    assert got[0] is None and abs(got[15]) < 2 and got[30] > 10


def test_blocks_change_nothing(spark):
    """Drift and running totals with keys that span many blocks, or share one; null keys and values too."""
    random.seed(6)
    rows = [(i, random.choice(["a", "a", "a", "b", None]), random.choice([None, 1.0, 2.5, 7.0])) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, k string, v double").repartition(5)
    want, total = {}, {}
    for k in ("a", "b", None):
        own = [(i, v) for i, x, v in rows if x == k]
        for n, (i, _) in enumerate(own):
            before = [v for _, v in own[max(0, n - 6) : n] if v is not None]
            sd = statistics.stdev(before) if len(before) > 1 else 0
            v = own[n][1]
            want[i] = round((v - statistics.mean(before)) / sd, 6) if sd and v is not None else None
            upto = [x for _, x in own[: n + 1] if x is not None]
            total[i] = sum(upto) if upto else None
    assert {r.i: r.z for r in C.drift(df, "v", ["k"], ["i"], 6, 10).select("i", F.round("z", 6).alias("z")).collect()} == want
    assert {r.i: r.total for r in C.running(df, "v", ["k"], ["i"], block_rows=10).collect()} == total


def test_runtime_filters_are_in_the_plan(spark):
    """A selective dimension gives the fact side a filter by bitmap before the join."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0", "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1g"}
    at = shared_path(spark, "facts")
    spark.range(20000).selectExpr("id % 1000 AS k", "id AS x").write.parquet(f"{at}/f")
    spark.range(1000).selectExpr("id AS k", "id % 50 AS kind").write.parquet(f"{at}/d")
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        joined = C.with_dimension(spark.read.parquet(f"{at}/f"), spark.read.parquet(f"{at}/d").filter("kind = 3"), "k", "inner")
        assert "might_contain" in joined._jdf.queryExecution().optimizedPlan().toString()
        assert joined.count() == 400
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_json_and_snapshots(spark):
    df = spark.createDataFrame([('{"k": 7}', 1), ("broken", 2), (None, 3)], "j string, t int")
    assert [r.k for r in C.json_fields(df, "j", "k INT").orderBy("t").collect()] == [7, None, None]
    assert C.as_at(df, "t", 2).count() == 2


def test_best_setting(spark):
    df = spark.createDataFrame([("m", 1, 2.0), ("m", 1, 4.0), ("m", 2, 3.5), ("n", 5, 1.0)], "machine string, s int, y double")
    assert {r.machine: r.best_setting for r in C.best_setting(df, "machine", "s", "y").collect()} == {"m": 2, "n": 5}


SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("ts", T.TimestampType())])


def _source(spark, n=48):
    at = shared_path(spark, "in")
    rows = [(i, T0 + dt.timedelta(minutes=30 * i)) for i in range(n)]
    parts.write_part(spark.createDataFrame(rows, SCHEMA), at, "ts", files=3)
    return at


def test_windows_in_streams(spark):
    stream = live.stream_parts(spark, _source(spark), SCHEMA, files_per_batch=1)
    got = live.drain(live.tumbling(stream, "ts", "6 hours", n=A.count_rows())).orderBy("window_start").collect()
    assert [r.n for r in got] == [12, 12, 12, 12]
    gaps = live.drain(live.sessions(live.stream_parts(spark, _source(spark, 5), SCHEMA).filter("id <> 2").withColumn("k", F.col("id") * 0), "ts", "40 minutes", "k"))
    assert sorted(r.n for r in gaps.collect()) == [2, 2]


def test_ingest_recovers_and_tails(spark):
    at, into, log = _source(spark), shared_path(spark, "out"), shared_path(spark, "log")
    for _ in range(2):  # the second run finds nothing new
        q = live.ingest(live.stream_parts(spark, at, SCHEMA, files_per_batch=1), into, log)
        q.awaitTermination()
    flushed = parts.read_part(spark, into, schema=SCHEMA)
    assert flushed.count() == 48
    assert "batchId" in live.health(q)


def test_live_table_flushes_and_merges(spark):
    """Every row is there at any time, once, whether in flight, in a part or in a merged part."""
    at, table = _source(spark), None
    table = live.LiveTable(spark, shared_path(spark, "live"), SCHEMA, "ts", "id", flush_rows=20, merge_parts_at=2)
    log = shared_path(spark, "log")
    seen = []
    for k in range(4):
        if k:
            spark.createDataFrame([(1000 * k + i, T0) for i in range(15)], SCHEMA).coalesce(1).write.mode("append").parquet(at)
        table.ingest(live.stream_parts(spark, at, SCHEMA, files_per_batch=1), log).awaitTermination()
        assert table.read().count() == table.read().distinct().count() == 48 + 15 * k
        seen.append((len(table.parts()), len(table.in_flight())))
    assert any(t for _, t in seen) and any(p for p, _ in seen) and max(p for p, _ in seen) <= 2
    files = table.spark.read.parquet(*[table._part(s) for s in table.parts()])
    assert files.count() + spark.read.schema(SCHEMA).parquet(*[table._tail(n) for n in table.in_flight()] or [table._part(table.parts()[0])]).count() >= 93


def test_late_events_are_dropped(spark):
    at = shared_path(spark, "late")
    day = lambda n: T0 + dt.timedelta(days=n)
    spark.createDataFrame([(1, day(0)), (2, day(9))], SCHEMA).coalesce(1).write.parquet(at)
    more = lambda: spark.createDataFrame([(3, day(0)), (4, day(9))], SCHEMA).coalesce(1).write.mode("append").parquet(at)
    stream = live.stream_parts(spark, at, SCHEMA, files_per_batch=1)
    got = live.drain(live.tumbling(stream, "ts", "1 day", delay="2 days"), "update", "window_start", again=more)
    assert {r.window_start: r.n for r in got.collect()} == {day(0): 1, day(9): 2}


def test_streams_join_in_time(spark):
    at, bt = shared_path(spark, "left"), shared_path(spark, "right")
    spark.createDataFrame([(1, T0), (2, T0)], SCHEMA).write.parquet(at)
    spark.createDataFrame([(1, T0 + dt.timedelta(minutes=m)) for m in (-1, 0, 59, 61)], SCHEMA).write.parquet(bt)
    left = live.stream_parts(spark, at, SCHEMA).select("id", F.col("ts").alias("lt"))
    got = live.drain(live.stream_join(left, live.stream_parts(spark, bt, SCHEMA), "id", "lt", "ts", "1 hour", "1 day"), "append")
    assert sorted((r.id, (r.ts - r.lt).seconds // 60) for r in got.collect()) == [(1, 0), (1, 59)]


def test_distinct_within(spark):
    at = shared_path(spark, "dup")
    spark.createDataFrame([(1, T0), (1, T0), (2, T0)], SCHEMA).write.parquet(at)
    got = live.drain(live.distinct_within(live.stream_parts(spark, at, SCHEMA), "ts", "1 day", "id"), "append")
    assert sorted(r.id for r in got.collect()) == [1, 2]
