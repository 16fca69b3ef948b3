"""Formats, syslog, schema discovery."""

import pytest

from tallyforge.schema import QueryError
from tallyforge.sources import logs, readers


@pytest.mark.parametrize("kind", ["parquet", "orc", "json", "csv"])
def test_round_trip(spark, tmp_path, kind):
    df = spark.createDataFrame([(1, "a", 1.5), (2, "b,c\"d", None)], "i int, s string, x double")
    readers.write_files(df, f"{tmp_path}/t", kind)
    assert sorted(map(tuple, readers.read_files(spark, f"{tmp_path}/t", kind, df.schema).collect())) == sorted(map(tuple, df.collect()))


def test_folders_and_errors(spark, tmp_path):
    readers.write_files(spark.range(10).selectExpr("id", "id % 2 AS k"), f"{tmp_path}/t", "parquet", "k")
    assert readers.read_files(spark, f"{tmp_path}/t", "parquet").filter("k = 1").count() == 5
    with pytest.raises(QueryError):
        readers.read_files(spark, f"{tmp_path}/t", "xml")


def test_syslog(spark):
    rows = readers.parse_syslog(spark.createDataFrame([("<34>Oct 11 22:14:15 m su[230]: a: b",), ("<999>x",), (None,)], "line string")).collect()
    assert (rows[0].facility, rows[0].severity, rows[0].pid, rows[0].message) == (4, "critical", 230, "a: b")
    assert rows[1].facility is None and rows[1].message is None and rows[2].raw is None


def test_schema_discovery(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 1}\n{"b": "x", "a": 2.5}\n')
    assert readers.discover_json(spark, f"{tmp_path}/a.json").simpleString() == "struct<a:double,b:string>"


@pytest.mark.parametrize("size", ["1k", "128m"])
def test_line_numbers(spark, tmp_path, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        for k, n in enumerate((0, 1, 700)):
            (tmp_path / f"f{k}.txt").write_text("".join(f"row {i}\r\n" for i in range(n)) + "end")
        got = {(r.file[-5], r.line_no): r.line for r in logs.numbered_lines(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {(str(k), i): f"row {i}" if i < n else "end" for k, n in enumerate((0, 1, 700)) for i in range(n + 1)}


@pytest.mark.parametrize("encoding", ["UTF-16LE", "UTF-16BE", "ISO-8859-1", "UTF-8"])
def test_encodings_round_trip(spark, tmp_path, encoding):
    lines = ["plain", "", "naïve \u00ff", "last"] + (["\u0a0d \u0d0a", "😀"] if "16" in encoding else [])
    logs.write_lines(spark.createDataFrame([(x,) for x in lines], "line string").coalesce(1), f"{tmp_path}/t", encoding=encoding, line_end="\r\n")
    assert [r.line for r in logs.read_lines(spark, f"{tmp_path}/t", encoding=encoding).collect()] == lines
