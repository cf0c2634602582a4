"""Row groups that a range skips, leak checks, random entries and packed masks."""

import glob
from datetime import datetime, timedelta

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from barline.functions import features as ft
from barline.operators import chunks as ck
from barline.operators import leaks as lk
from barline.operators import masks as mk
from barline.operators import strategies as so
from barline.operators.strategies import Setup
from barline.sources import market as m


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("ranged") / "bars")
    ix = F.col("id")
    bars = spark.range(120_000).select(
        F.concat(F.lit("S"), (ix % 3).cast("string")).alias("symbol"),
        (F.lit("2020-01-01").cast("timestamp_ntz") + F.expr("make_dt_interval(0, 0, CAST(id AS INT), 0)")).alias("ts"),
        *[(ix * k % 1009).cast("double").alias(c) for k, c in enumerate(("open", "high", "low", "close", "volume"), 3)],
    )
    m.write_ranged(bars.repartition(5), path, 4, 64 << 10)
    return path


def test_row_groups_are_narrow_and_skipped(spark, folder):
    groups = []
    for f in glob.glob(f"{folder}/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        names = [meta.schema.column(i).name for i in range(meta.num_columns)]
        for g in range(meta.num_row_groups):
            stats = {n: meta.row_group(g).column(i).statistics for i, n in enumerate(names)}
            groups.append(((stats["symbol"].min, stats["ts"].min), (stats["symbol"].max, stats["ts"].max), meta.row_group(g).num_rows))
    groups.sort()
    assert len(groups) > 12 and sum(n for *_, n in groups) == 120_000
    start, end = datetime(2020, 2, 1), datetime(2020, 2, 4)
    may = sum(n for low, high, n in groups if low[0] <= "S1" <= high[0] and (low[0] != high[0] or (low[1] < end and high[1] >= start)))
    df = m.range_scan(spark, folder, str(start), str(end), ["S1"])
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = df.where("true").groupBy().count()
        rows = df.collect()[0][0]
        plan = df._jdf.queryExecution().executedPlan()
        scan = plan.collectLeaves().apply(0)
        read = scan.metrics().apply("numOutputRows").value()
        assert "PushedFilters" in scan.toString() or "PushedFilters" in plan.toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert rows == 3 * 24 * 60 / 3
    assert rows <= read <= may < 120_000 / 4


def test_range_scan_refuses(spark, folder):
    assert m.range_scan(spark, folder, "2020-01-02", "2020-01-03", holdout_start="2020-03-01").count() == 1440
    for bad in ({"start": "2020-01-01", "holdout_start": "2020-02-01"}, {"end": "2020-02-02", "holdout_start": "2020-02-01"}, {"start": "2020-01-02", "end": "2020-01-02"}):
        with pytest.raises(ValueError):
            m.range_scan(spark, folder, **bad)
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        m.write_ranged(m.range_scan(spark, folder), folder, 1)


def test_leaks_that_only_one_mode_sees(spark, small):
    bars = m.daily_bars(spark, small).where("symbol IN ('AF', 'RF')")
    whole = lambda d: F.count("*").over(ck.Window.partitionBy("symbol"))
    late = lambda d: F.coalesce(F.lead("close", 3).over(ft.order()) * 0, F.lit(0.0))

    def feature(d):
        return d.withColumns({"fair": ft.sma(F.col("close"), 5), "counts": whole(d), "level": F.max("close").over(ck.Window.partitionBy("symbol")), "nothing": late(d)})

    got = {(r["mode"], r.feature): r for r in lk.leak_check(bars, feature, ["fair", "counts", "level", "nothing"], ["1998-06-30"]).collect()}
    assert len(got) == 8
    assert got["truncated", "fair"].causal and got["perturbed", "fair"].causal and got["truncated", "nothing"].causal
    assert not got["truncated", "counts"].causal and got["perturbed", "counts"].causal  # seen by truncation alone
    assert not got["perturbed", "level"].causal
    assert got["perturbed", "level"].first_ts is not None and got["truncated", "fair"].first_ts is None
    cross = lambda d: d.withColumn("breadth", F.avg("close").over(ck.Window.partitionBy("ts")))
    assert all(r.causal for r in lk.leak_check(bars, cross, ["breadth"], ["1998-06-30"], across=True).collect())


def test_random_entries_match_frequency(spark, small):
    got = so.random_entries(m.daily_bars(spark, small), Setup("x", window=10, deviations=1.0), 15).collect()
    assert got and all(r.n_runs <= 15 and 0 <= r.percentile <= 1 and r.n_trades > 0 for r in got)
    again = so.random_entries(m.daily_bars(spark, small).repartition(3), Setup("x", window=10, deviations=1.0), 15).collect()
    key = lambda rows: sorted((r.symbol, r.n_trades, round(r.mean_r, 9), r.percentile) for r in rows)
    assert key(got) == key(again)


def test_packed_masks_and_extremes(spark):
    rows = [("A", datetime(2020, 1, 1) + timedelta(hours=i), float(i * 37 % 101), bool(i % 2), bool(i % 3 == 0), i % 5 == 0) for i in range(300)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, high double, `a.1` boolean, b boolean, win boolean")
    words = mk.packed(df, ["a.1", "b", "win"])
    assert words.agg(F.sum("n")).first()[0] == 300 and words.count() == 5
    (pair,) = mk.pair_hits(words, ["a.1", "b"], "win").collect()
    both = [r for r in rows if r[3] and r[4]]
    assert (pair.a, pair.b, pair.n_both, pair.n_either, pair.n_wins) == ("a.1", "b", len(both), sum(r[3] or r[4] for r in rows), sum(r[5] for r in both))
    for block in (64, 1000):
        got = ck.in_blocks(df, 40, lambda d: mk.with_extreme(mk.with_extreme(d, "high", 40, True, "top"), "high", 40, False, "bottom").select("ts", "top", "bottom", "__own"), block)
        told = {r.ts: (r.top, r.bottom) for r in got.collect()}
        for i, r in enumerate(rows):
            last = [x[2] for x in rows[max(0, i - 39) : i + 1]]
            assert told[r[1]] == ((max(last), min(last)) if i >= 39 else (None, None))
