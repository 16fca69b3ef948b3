"""Occurrences, indicator reports, web logs, the line language."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyforge import cli
from tallyforge.functions.text import occurrences
from tallyforge.operators import linegraph as G
from tallyforge.operators import scanning as S
from tallyforge.schema import QueryError
from tallyforge.sources import logs


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("abé\n", max_size=20), min_size=1, max_size=20), st.text("abé", min_size=1, max_size=3))
def test_occurrences_are_those_of_python(spark, texts, pattern):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(occurrences("t", pattern)).collect()]
    assert got == [t.count(pattern) for t in texts]


def test_occurrence_edges(spark):
    df = spark.createDataFrame([("aaaa",), (None,), ("a",)], "t string")
    assert S.count_pattern(df, "t", "aa").first()[0] == 2
    assert S.count_pattern(df, "t", "a").first()[0] == 5
    assert S.count_pattern(df, "t", "longer than any").first()[0] == 0
    with pytest.raises(QueryError):
        occurrences("t", "")


def test_reports_over_files(spark, tmp_path):
    logs.made_weblog(spark, 5001).coalesce(1).write.text(f"{tmp_path}/a")
    found = S.scan_files(spark, [f"{tmp_path}/a", f"{tmp_path}/missing"], logs.INDICATORS)
    lines = [r.value for r in spark.read.text(f"{tmp_path}/a").collect()]
    assert {r.pattern: r.hits for r in found.collect()} == {p: sum(x.count(p) for x in lines) for p in logs.INDICATORS}
    assert S.scan_files(spark, [f"{tmp_path}/missing"], ["x"]).count() == 0


def test_reports_of_texts_without_a_hit(spark):
    df = spark.createDataFrame([("a", "xx"), ("a", None), ("b", "/admin/admin")], "g string, t string")
    assert [tuple(r) for r in S.indicator_report(df.filter("g = 'a'"), "t", ["/admin"]).collect()] == [("/admin", 0)]
    assert {tuple(r) for r in S.indicator_report(df, "t", ["/admin", "x"], "g").collect()} == {("a", "/admin", 0), ("a", "x", 2), ("b", "/admin", 2), ("b", "x", 0)}
    assert [r.hits for r in S.indicator_report(df, "t", ["/admin", "x"]).collect()] == [2, 2]


def test_line_ends(spark, tmp_path):
    (tmp_path / "mixed.log").write_bytes(b"a\r\nb\rc\n\nd\r\r\n")
    for encoding in (None, "ISO-8859-1"):
        assert logs.read_lines(spark, f"{tmp_path}/mixed.log", encoding=encoding, with_file=False).columns == ["line"]
        assert [r.line for r in logs.read_lines(spark, f"{tmp_path}/mixed.log", encoding=encoding).collect()] == ["a", "b", "c", "", "d", ""]
    assert {(r.line_no, r.line) for r in logs.numbered_lines(spark, f"{tmp_path}/mixed.log").collect()} == {(0, "a"), (1, "b"), (2, "c"), (3, ""), (4, "d"), (5, "")}


def test_weblog(spark):
    p = logs.parse_weblog(logs.made_weblog(spark, 10_001))
    assert p.filter("ts is null or status is null").count() == 0
    assert p.filter(F.col("ip").isin(*logs.ODD_IPS)).count() == 3
    odd = logs.parse_weblog(spark.createDataFrame([("no log line",), (None,)], "line string")).collect()
    assert [r.status for r in odd] == [None, None] and odd[0].raw == "no log line"
    edge = ["[2024-01-01 00:00:00] a b c 200 \t", "[2024-01-01 00:00:00] a  c 200", "[2024-13-01 00:00:00] a b c 200", "x[2024-01-01 00:00:00] a b c 200", "[2024-01-01 00:00:00] a b c 2000"]
    got = logs.parse_weblog(spark.createDataFrame([(x,) for x in edge], "line string")).collect()
    assert [r.path for r in got] == ["c", None, "c", None, None] and [r.ts is None for r in got] == [False, True, True, True, True]


def test_line_language(spark):
    lines = ["unit A energy=80 -> B", "unit B energy 55", "energy=-5 -> 0", "subunit C energy=- -> Nowhere", "", None, "-> A unit A", "unit D energy=49 -> 1x"]
    got = {r.line_no: r for r in G.with_target_energy(G.analyse(spark.createDataFrame(list(enumerate(lines)), "line_no int, text string"))).collect()}
    assert [got[i].unit for i in range(8)] == ["A", "B", "", "C", "", "", "A", "D"]
    assert [got[i].energy for i in range(8)] == [80, 55, -5, 0, -1, -1, -1, 49]
    assert [got[i].colour for i in range(8)] == ["red", "orange", "blue", "green", "blue", "blue", "blue", "green"]
    assert [got[i].resolved_idx for i in range(8)] == [1, -1, 0, -1, -1, -1, 0, 1]
    assert got[0].target_energy == 55 and got[3].target_line == -2


def test_smoothing_and_curves(spark):
    one = spark.range(1)
    at = lambda n: one.select(G.smoothed(F.lit(0), F.lit(80), n)).first()[0]
    assert at(0) == 0 and abs(at(1) - 8) < 1e-9 and at(200) == 80
    pts = G.curve(one.select(F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(1).alias("c"), F.lit(1).alias("d")), "a", "b", "c", "d").orderBy("step").collect()
    assert len(pts) == 21 and pts[0].at == 0 and pts[-1].at == 1 and abs(pts[10].at - 0.5) < 1e-12


def test_encodings_and_line_ends(spark, tmp_path):
    (tmp_path / "u.txt").write_bytes("ä one\r\ntwo\r\n".encode("utf-16-le"))
    assert [r.line for r in logs.read_lines(spark, f"{tmp_path}/u.txt", encoding="UTF-16LE").collect()] == ["ä one", "two"]


def test_command_line(spark, tmp_path):
    assert "query" in cli.run(spark, [])
    cli.run(spark, ["gen", f"{tmp_path}/g", "1000"])
    assert "1000" in cli.run(spark, ["status", f"{tmp_path}/g"])
    assert "{'count': 1000}" in cli.run(spark, ["query", f"SELECT COUNT(*) FROM '{tmp_path}/g'"])
    assert "2000" in cli.run(spark, ["merge", f"{tmp_path}/m", f"{tmp_path}/g", f"{tmp_path}/g"])
    with pytest.raises(QueryError):
        cli.run(spark, ["nonsense"])
