from datetime import datetime, timedelta

from pyspark.sql import functions as F

from barline.streaming import bars_stream as bs


def test_only_closed_bars_leave(spark, tmp_path):
    rows = [("X", datetime(2024, 1, 1) + timedelta(minutes=7 * i), float(i % 13), 1.0, i) for i in range(200)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, price double, volume double, seq bigint")
    df.where("seq < 100").coalesce(1).write.parquet(str(tmp_path / "in"))
    run = lambda: bs.write_bars(bs.closed_bars(bs.read_ticks(spark, str(tmp_path / "in"), df.schema), "1 hour"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    run()
    first = spark.read.parquet(str(tmp_path / "out")).count()
    df.where("seq >= 100").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert 0 < first < out.count() and out.groupBy("symbol", "ts").count().where("count > 1").count() == 0
    want = df.groupBy("symbol", (F.window("ts", "1 hour").end).alias("ts")).agg(F.max_by("price", "seq").alias("close"), F.sum("volume").alias("volume"))
    assert out.join(want, ["symbol", "ts", "close", "volume"], "left_anti").count() == 0
    assert out.agg(F.max("ts")).first()[0] < df.agg(F.max("ts")).first()[0]
