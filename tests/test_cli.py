from tallyforge import cli


def test_every_row_is_shown(spark, monkeypatch):
    monkeypatch.setattr(cli, "lite_sql", lambda *_: spark.range(1500))
    assert len(cli.run(spark, ["query", "SELECT"]).split("\n")) == 1500
