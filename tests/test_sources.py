"""Sources and sinks on small files."""

import json
from datetime import datetime

import pytest

from barline.sources import files as fs


def test_csv_scans(spark, tmp_path):
    (tmp_path / "b.csv").write_text("timestamp,open,high,low,close,volume,quote_volume\n2020-01-01 00:00:00,1,2,0.5,1.5,10,15\n")
    row = fs.csv_bars(spark, str(tmp_path / "b.csv"), "X", True).first()
    assert (row.symbol, row.ts, row.close, row.quote_volume) == ("X", datetime(2020, 1, 1), 1.5, 15.0)
    (tmp_path / "f.csv").write_text("timestamp,last_funding_rate,funding_interval_hours\n2020-01-01 08:00:00,0.0001,8\n")
    assert fs.csv_funding(spark, str(tmp_path / "f.csv"), "X").first().rate == 0.0001
    (tmp_path / "q.csv").write_text("2020-01-01 00:00:00,1.1,1.2\n2020-01-01 00:00:00,1.0,1.3\n")
    assert [(r.bid, r.ask) for r in fs.csv_quotes(spark, str(tmp_path / "q.csv"), "X").orderBy("seq").collect()] == [(1.1, 1.2), (1.0, 1.3)]
    (tmp_path / "bad.csv").write_text("timestamp,open,high,low,close,volume\nnever,1,2,0.5,1.5,10\n")
    with pytest.raises(Exception):
        fs.csv_bars(spark, str(tmp_path / "bad.csv"), "X").collect()


def test_pages(spark):
    rows = spark.createDataFrame([(1, 5, 0), (2, 6, 0), (2, 7, 1), (3, 8, 1)], "ts int, v int, page int")
    assert sorted((r.ts, r.v) for r in fs.pages(rows, ["ts"], "page").collect()) == [(1, 5), (2, 7), (3, 8)]


def test_minute_parts(spark, tmp_path):
    def part(n, minutes, folder):
        spark.createDataFrame([(60_000 * m, 1.0, 1.0, 1.0, 1.0, 1.0) for m in minutes], fs.MINUTES).toPandas().to_parquet(f"{folder}/part-{n:05d}.parquet")

    good, hole, gap = (tmp_path / x for x in ("good", "hole", "gap"))
    for d in (good, hole, gap):
        d.mkdir()
    part(0, range(3), good), part(1, range(3, 5), good)
    part(0, range(3), hole), part(1, range(4, 6), hole)
    part(0, range(3), gap), part(2, range(3, 5), gap)
    assert fs.minute_parts(spark, str(good)).count() == 5
    for d in (hole, gap):
        with pytest.raises(ValueError):
            fs.minute_parts(spark, str(d))


def test_bundles_brackets_and_paths(spark, tmp_path):
    points = spark.createDataFrame([("X", 0, 0, 0, 0, 5, 9.0), ("X", 0, 0, 0, 0, 1, 10.0), ("X", 0, 0, 0, 1, 1, 10.0), ("X", 0, 1, 120, 1, 130, 12.0)], "symbol string, bar_ix bigint, segment_ix int, start_minute int, side int, minute int, price double")
    nested = fs.nested_paths(points).first()
    assert [s.start_minute for s in nested.segments] == [0, 120] and [p.minute for p in nested.segments[0].lows] == [1, 5] and nested.segments[1].lows == []
    (tmp_path / "t.json").write_text(json.dumps([{"symbol": "X", "cap": 50.0, "max_leverage": 50, "mmr": 0.004, "amount": 0.0}]))
    (tmp_path / "none.json").write_text("[]")
    tiers = fs.brackets(spark, str(tmp_path / "t.json"))
    assert tiers.first().max_leverage == 50
    with pytest.raises(ValueError):
        fs.brackets(spark, str(tmp_path / "none.json"))
    fs.write_bundle(str(tmp_path / "bundle"), dict.fromkeys(fs.BUNDLE, points) | {"brackets": tiers})
    assert {k: v.count() for k, v in fs.read_bundle(spark, str(tmp_path / "bundle")).items()} == dict.fromkeys(fs.BUNDLE, 4) | {"brackets": 1}
    with pytest.raises(ValueError):
        fs.write_bundle(str(tmp_path / "b2"), {"marks": points})


def test_manifest_and_datasets(spark, tmp_path):
    data = tmp_path / "data"
    data.mkdir()
    (data / "a.txt").write_text("a"), (data / "b.txt").write_text("b")
    fs.write_manifest(spark, str(data), str(tmp_path / "manifest"))
    assert fs.changed_files(spark, str(data), str(tmp_path / "manifest")).count() == 0
    (data / "a.txt").write_text("x"), (data / "c.txt").write_text("c"), (data / "b.txt").unlink()
    assert {(r.file, r.what) for r in fs.changed_files(spark, str(data), str(tmp_path / "manifest")).collect()} == {("a.txt", "changed"), ("b.txt", "missing"), ("c.txt", "added")}
    df = spark.range(20).selectExpr("id", "id * 2 AS v")
    root = str(tmp_path / "sets")
    name = fs.publish(spark, df, root)
    assert fs.publish(spark, df.repartition(5), root, 3) == name and fs.publish(spark, df.where("id < 5"), root) != name
    assert fs.resolve(spark, root, name).count() == 20
    spark.range(1).selectExpr("id", "id AS v").write.mode("append").parquet(f"{root}/{name}")
    with pytest.raises(ValueError):
        fs.resolve(spark, root, name)


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0, "x")], "trial int, b double, a string")
    assert fs.report(df, ["trial"]).first().report == '{"a":"x","b":2.0}'
    fs.write_results(df, str(tmp_path / "r"))
    assert spark.read.csv(str(tmp_path / "r"), header=True).first().a == "x"
    fs.write_results(df, str(tmp_path / "j"), "json")
    with pytest.raises(Exception):
        fs.write_results(df, str(tmp_path / "r"))
