"""Parts: sorted writing, granules, skipping, merging (the smoke programs of the surveyed engine as assertions)."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyforge.operators import predicates as P
from tallyforge.plans.lite_sql import lite_sql
from tallyforge.schema import RECORD, QueryError
from tallyforge.sources import logs, parts


def _records(spark, rows):
    return spark.createDataFrame(rows, RECORD)


def test_ingest_and_query(spark, tmp_path):
    rows = [(1000 + i, i % 4, "Example event message 01") for i in range(100)]
    parts.write_part(_records(spark, rows), f"{tmp_path}/p", "ts", files=1)
    df = parts.read_part(spark, f"{tmp_path}/p")
    assert [r.ts for r in df.collect()] == [r[0] for r in rows]
    index = parts.granule_index(df)
    assert [tuple(r) for r in index.collect()] == [(0, 1000, 1099, 100)]
    assert df.filter(P.in_range(df, "ts", 1020, 1040)).count() == 21
    assert df.filter(P.contains(df, "message", "Example")).count() == 100
    assert df.filter(P.in_range(df, "ts", 1040, 1020)).count() == 0
    assert tuple(parts.pruning_report(index, 1020, 1040).first()) == (1, 1, 0)


def test_merge_interleaves(spark, tmp_path):
    even, odd = [(2000 + 2 * i, 100, "Part Data") for i in range(50)], [(2001 + 2 * i, 100, "Part Data") for i in range(50)]
    for name, rows in (("a", even), ("b", odd)):
        parts.write_part(_records(spark, rows), f"{tmp_path}/{name}", files=1)
    merged = parts.merge_parts(spark, [f"{tmp_path}/a", f"{tmp_path}/b"], f"{tmp_path}/m", files=1)
    assert [r.ts for r in merged.collect()] == list(range(2000, 2100))
    assert lite_sql(spark, f"SELECT SUM(1) FROM '{tmp_path}/m' WHERE 1 > 50").first()[0] == 10000
    assert lite_sql(spark, f"SELECT COUNT(*) FROM '{tmp_path}/m' WHERE 2 CONTAINS 'Data'").first()[0] == 100


def test_merge_refuses(spark, tmp_path):
    parts.write_part(_records(spark, [(1, 2, "x")]), f"{tmp_path}/a")
    assert parts.merge_parts(spark, [], f"{tmp_path}/none") is None
    with pytest.raises(QueryError):
        parts.merge_parts(spark, [f"{tmp_path}/a"], f"{tmp_path}/a/")
    spark.range(3).write.parquet(f"{tmp_path}/other")
    with pytest.raises(QueryError):
        parts.merge_parts(spark, [f"{tmp_path}/a", f"{tmp_path}/other"], f"{tmp_path}/m")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        parts.merge_parts(spark, [f"{tmp_path}/missing"], f"{tmp_path}/m")


@pytest.mark.parametrize("n", [0, 1, 99, 100, 101])
def test_granule_edges(spark, n):
    found = parts.granule_index(spark.range(n).select(F.col("id").alias("ts")), rows=100).collect()
    assert len(found) == -(-n // 100) and sum(r.n_rows for r in found) == n


def test_pages_are_skipped(spark, tmp_path):
    parts.write_part(logs.made_records(spark, 60_000), f"{tmp_path}/p", files=1, page_rows=8192)
    df = parts.read_part(spark, f"{tmp_path}/p").filter("ts between 50000 and 50020")
    assert df.count() == 21
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts,50000), LessThanOrEqual(ts,50020)]" in plan


def test_no_row_is_lost_beyond_a_million(spark, tmp_path):
    parts.write_part(logs.made_records(spark, 1_100_000), f"{tmp_path}/p", rows_per_file=500_000)
    assert parts.read_part(spark, f"{tmp_path}/p").count() == 1_100_000


def test_status(spark, tmp_path):
    parts.write_part(logs.made_records(spark, 10), f"{tmp_path}/p", files=1)
    r = parts.status(spark, f"{tmp_path}/p").first()
    assert (r.state, r.n_rows, r.n_columns, r.page_rows) == ("online", 10, 3, 8192)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(-(2**62), 2**62), st.text(max_size=300)), min_size=1, max_size=30))
def test_merge_of_a_split_is_the_whole(spark, tmp_path_factory, rows):
    at = tmp_path_factory.mktemp("split")
    df = _records(spark, rows)
    for i in range(2):
        parts.write_part(_records(spark, rows[i::2]), f"{at}/{i}")
    merged = parts.merge_parts(spark, [f"{at}/0", f"{at}/1"], f"{at}/m", "ts", files=1).collect()
    assert sorted(map(tuple, merged)) == sorted(map(tuple, df.collect()))
    assert [r.ts for r in merged] == sorted(r[0] for r in rows)
