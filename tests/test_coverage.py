"""Coverage that refuses, and quotes filled from a second source."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barline.operators import alignment as al
from barline.sources import coverage as cv


def times(spark, rows):
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz")


def test_funding_must_span_trades(spark):
    day = datetime(2024, 1, 1)
    trades = times(spark, [("A", day + timedelta(days=i)) for i in range(5)] + [("B", day)])
    late = timedelta(milliseconds=5)  # a settlement a little late belongs to its nearest minute
    funding = [("A", day + late), ("A", day + timedelta(days=4)), ("B", day)]
    cv.check_funding(trades, times(spark, funding))
    with pytest.raises(cv.CoverageError, match="B: no funding history"):
        cv.check_funding(trades, times(spark, funding[:2]))
    with pytest.raises(cv.CoverageError, match="A: funding history covers 2024-01-01/2024-01-04 but the trade bars run 2024-01-01/2024-01-05"):
        cv.check_funding(trades, times(spark, [("A", day), ("A", day + timedelta(days=3)), ("B", day)]))
    with pytest.raises(cv.CoverageError):
        cv.check_funding(trades, times(spark, [("A", day + timedelta(minutes=1)), ("A", day + timedelta(days=9)), ("B", day)]))


def test_common_window(spark):
    day = datetime(2024, 1, 1)
    bars = times(spark, [("A", day), ("A", day + timedelta(days=9)), ("B", day + timedelta(days=3)), ("B", day + timedelta(days=12))])
    assert cv.common_window(bars) == (day + timedelta(days=3), day + timedelta(days=9))
    assert sorted(r.symbol for r in cv.cut_to_common(bars).collect()) == ["A", "B"]
    with pytest.raises(cv.CoverageError, match="no common window"):
        cv.common_window(bars.union(times(spark, [("C", day + timedelta(days=9))])))
    with pytest.raises(cv.CoverageError, match="no instruments"):
        cv.common_window(bars.where("false"))


def quotes(spark, rows):
    d = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, bid double, spread double")
    names = ("open", "high", "low", "close")
    return d.select("symbol", "ts", *[F.col("bid").alias(f"bid_{n}") for n in names], *[(F.col("bid") + F.col("spread")).alias(f"ask_{n}") for n in names], F.lit(1).cast("bigint").alias("n_ticks"))


def test_gap_fill(spark):
    friday = datetime(2024, 1, 5)
    at = lambda h: friday + timedelta(hours=h)
    price = lambda h: float(h * 37 % 101)
    # Friday whole, Saturday and Sunday empty, Monday two bars, Tuesday whole.
    have = [*range(24), 72, 73, *range(96, 120)]
    main = quotes(spark, [("A", at(h), price(h), 2.0 if h % 24 < 12 else 3.0) for h in have])
    second = spark.createDataFrame([("A", at(h - 5), *[price(h)] * 4, 1) for h in range(120)], "symbol string, ts timestamp_ntz, open double, high double, low double, close double, n_ticks bigint")
    assert [r.offset for r in al.best_offset(main, second, (4, 5, 6)).collect()] == [5]
    assert [r.day.isoformat() for r in al.missing_days(main, 20).collect()] == ["2024-01-08"]
    got = {r.ts: r for r in al.filled_quotes(main, second, 20, (4, 5, 6)).collect()}
    added = sorted(t for t, r in got.items() if r.source == "second")
    assert added == [at(h) for h in range(74, 96)] and len(got) == len(have) + 22
    assert got[at(80)].bid_close == price(80) and got[at(80)].ask_close == price(80) + 2.0 and got[at(90)].ask_low == price(90) + 3.0


def test_holidays_are_not_missing(spark):
    d = quotes(spark, [("A", datetime(2024, 12, 24), 1.0, 1.0), ("A", datetime(2024, 12, 27), 1.0, 1.0)])
    assert [r.day.isoformat() for r in al.missing_days(d, 1).orderBy("day").collect()] == ["2024-12-26"]
