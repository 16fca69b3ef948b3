"""The small SQL: everything it accepts, and that it drops nothing in silence."""

import pytest

from tallyforge.operators import aggregates as A
from tallyforge.plans.lite_sql import lite_sql, parse
from tallyforge.schema import RECORD, QueryError
from tallyforge.sources import logs


@pytest.fixture(scope="module")
def view(spark):
    spark.createDataFrame([(i, i * 10, f"line {i} it's") for i in range(10)], RECORD).createOrReplaceTempView("records")
    return spark


def one(spark, text):
    return tuple(lite_sql(spark, text).first())


def test_names_and_positions(view):
    assert one(view, "SELECT COUNT(*) FROM records WHERE value > 50") == (4,)
    assert one(view, "select count(*) from records where 1 > 50;") == (4,)
    assert one(view, "SELECT COUNT(0), SUM(1), MAX(value) FROM records WHERE ts BETWEEN 2 AND 4 AND value > 20") == (2, 70, 40)
    assert lite_sql(view, "SELECT SUM(1) FROM records").columns == ["sum_value"]


def test_empty_results_are_zero(view):
    assert one(view, "SELECT COUNT(*), SUM(1), MAX(1) FROM records WHERE 1 > 99999") == (0, 0, 0)


def test_quotes_and_patterns(view):
    assert one(view, "SELECT COUNT(*) FROM records WHERE message CONTAINS 'it''s'") == (10,)
    assert one(view, "SELECT COUNT(*) FROM records WHERE message CONTAINS 'LINE'") == (0,)


def test_range_with_ends_swapped(view):
    assert one(view, "SELECT COUNT(*) FROM records WHERE ts BETWEEN 4 AND 2") == (0,)


def test_comparisons(view):
    for op, n in ((">=", 5), ("<", 5), ("<=", 6), ("=", 1), ("<>", 9)):
        assert one(view, f"SELECT COUNT(*) FROM records WHERE ts {op} 5") == (n,)


def test_groups_order_limit(view):
    got = lite_sql(view, "SELECT ts, COUNT(*), SUM(value) FROM records WHERE ts > 5 GROUP BY ts ORDER BY sum_value DESC LIMIT 2").collect()
    assert [tuple(r) for r in got] == [(9, 1, 90), (8, 1, 80)]


def test_texts_lists_and_logic(view):
    n = lambda where: one(view, f"SELECT COUNT(*) FROM records WHERE {where}")[0]
    assert n("message = 'line 3 it''s'") == 1 and n("message <> 'line 3 it''s'") == 9
    assert n("value IN (10, 20, 999)") == 2 and n("message NOT IN ('line 3 it''s', 'x')") == 9
    assert n("message LIKE 'line _ %'") == 10 and n("message NOT LIKE '%3%'") == 9
    assert n("value < 20 OR value > 70") == 4 and n("NOT (value < 20 OR value > 70) AND ts <> 5") == 5
    assert n("value > 10 AND value < 30 OR ts = 9") == 2 and n("value > 10 AND (value < 30 OR ts = 9)") == 2
    assert n("value > 45.5") == 5 and n("message BETWEEN 'line 2' AND 'line 4'") == 2
    assert n("message IS NULL") == 0 and n("message IS NOT NULL") == 10


def test_rows_least_and_mean(view):
    assert one(view, "SELECT MIN(value), MAX(value), AVG(ts) FROM records WHERE ts > 3") == (40, 90, 6.5)
    assert one(view, "SELECT MIN(value), AVG(value) FROM records WHERE ts > 99") == (0, None)
    got = lite_sql(view, "SELECT message, 0 FROM records WHERE value >= 50 ORDER BY ts DESC LIMIT 2 OFFSET 1")
    assert [tuple(r) for r in got.collect()] == [("line 8 it's", 8), ("line 7 it's", 7)]
    assert lite_sql(view, "SELECT * FROM records ORDER BY message LIMIT 3").columns == ["ts", "value", "message"]


@pytest.mark.parametrize(
    "text",
    [
        "SELECT COUNT(*) FROM records WHERE nothing > 1",
        "SELECT COUNT(*) FROM records WHERE 7 > 1",
        "SELECT SUM(9) FROM records",
        "SELECT SUM(message) FROM records",
        "SELECT COUNT(*) FROM records WHERE message > 5",
        "SELECT COUNT(*) FROM records WHERE value CONTAINS '5'",
        "SELECT COUNT(*) FROM records WHERE message CONTAINS ''",
        "SELECT COUNT(*) FROM records WHERE message CONTAINS 'open",
        "SELECT COUNT(*) FROM records WHERE value > = 5",
        "SELECT COUNT(*) FROM records WHERE value = 'ERROR'",
        "SELECT COUNT(*) FROM records WHERE message = 5",
        "SELECT COUNT(*) FROM records WHERE message IN ('a', 5)",
        "SELECT COUNT(*) FROM records WHERE message NOT 'a'",
        "SELECT COUNT(*) FROM records WHERE value LIKE '5'",
        "SELECT COUNT(*) FROM records WHERE (value > 1",
        "SELECT COUNT(*) FROM records WHERE value IS 5",
        "SELECT COUNT(*) FROM records WHERE",
        "SELECT value, COUNT(*) FROM records",
        "SELECT * FROM records GROUP BY value",
        "SELECT value FROM records LIMIT 1.5",
        "SELECT MEDIAN(value) FROM records",
        "SELECT COUNT(*) FROM records extra",
        "SELECT COUNT(*)",
        "SELECT message, COUNT(*) FROM records GROUP BY value",
        "COUNT(*) FROM records",
        "",
    ],
)
def test_errors(view, text):
    with pytest.raises(QueryError):
        lite_sql(view, text)


def test_plan_is_plain_data():
    p = parse("SELECT COUNT(*) FROM 'a b''c' WHERE 0 > -3")
    assert (p.table, p.is_path, p.where.low) == ("a b'c", True, -3)


def test_generated_records(spark, tmp_path):
    logs.made_records(spark, 100_000).write.parquet(f"{tmp_path}/g")
    n = one(spark, f"SELECT COUNT(*) FROM '{tmp_path}/g' WHERE 1 > 500")[0]
    assert abs(n - 49_900) < 1_000


def test_overflow(spark):
    df = spark.createDataFrame([(2**63 - 1,), (1,)], "v long")
    with pytest.raises(Exception, match="OVERFLOW"):
        df.agg(A.sum_or_zero(df, "v")).first()
    assert df.agg(A.sum_or_zero(df, "v", wrap=True)).first()[0] == -(2**63)
    assert df.filter("v < 0").agg(A.sum_or_zero(df, "v", wrap=True)).first()[0] == 0
