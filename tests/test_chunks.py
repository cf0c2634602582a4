"""Row numbers, blocks with halos and prefix scans against plain loops."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from barline.functions import features as ft
from barline.operators import chunks as ck


@pytest.fixture(scope="module")
def series(spark):
    r = random.Random(1)
    rows = []
    for symbol, n in (("A", 700), ("B", 1), ("C", 90)):
        at = datetime(1999, 12, 25)
        for _ in range(n):
            at += timedelta(hours=r.choice([1, 5, 24, 24 * 40]))
            low = r.randint(50, 90)
            rows.append((symbol, at, low + 1.0, low + 9.0, float(low), float(low + r.randint(0, 9)), float(r.randint(1, 50))))
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double").repartition(3)
    return df.cache(), rows


def by_symbol(rows):
    out = {}
    for row in sorted(rows):
        out.setdefault(row[0], []).append(row)
    return out


def test_rows_are_numbered_without_whole_series(series):
    df, rows = series
    got = {(r.symbol, r.ts): r.row_ix for r in ck.numbered(df).collect()}
    assert got == {(s, row[1]): i for s, own in by_symbol(rows).items() for i, row in enumerate(own)}


@pytest.mark.parametrize("block", [1, 7, 64, 5000])
def test_blocks_give_the_same_features(series, block):
    df, _ = series
    columns = lambda: {"s": ft.sma(F.col("close"), 9), "d": ft.donchian_low(20), "e": ft.ema(F.col("close"), 4, 15), "m": ft.momentum_sign(F.col("close"), [2, 20])}
    whole = {(r.symbol, r.ts): r for r in df.select("symbol", "ts", *[c.alias(k) for k, c in columns().items()]).collect()}
    cut = ck.in_blocks(df, 20, lambda d: d.select("symbol", "ts", *[c.alias(k) for k, c in columns().items()], "__own"), block)
    assert {(r.symbol, r.ts): r for r in cut.collect()} == whole


def test_features_run_in_more_tasks_than_symbols(spark, series):
    df, _ = series
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "32")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        cut = ck.in_blocks(df, 20, lambda d: d.select("symbol", ft.sma(F.col("close"), 9).alias("s"), F.spark_partition_id().alias("task"), "__own"), 64)
        tasks = {r.task: r.symbols for r in cut.groupBy("task").agg(F.collect_set("symbol").alias("symbols"), F.max("s")).collect()}
        assert len(tasks) > 3 and sum("A" in symbols for symbols in tasks.values()) > 3
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_projection_must_keep_its_own_rows(series):
    with pytest.raises(ValueError):
        ck.in_blocks(series[0], 1, lambda d: d.select("symbol"))


@pytest.mark.parametrize("block, fan", [(16, 3), (256, 256), (1, 2)])
def test_recursions_over_the_whole_history(series, block, fan):
    df, rows = series
    cut = ck.blocks(ck.numbered(df.where("symbol <> 'A' OR ts < '2025-01-01'")), 0, block)
    got = ck.scanned(cut, {"v": (F.when(F.col("row_ix") % 5 == 0, -0.5).otherwise(0.75), F.col("close")), "sum": (F.lit(1.0), F.col("volume"))}, fan).collect()
    assert "v_a" not in got[0].asDict()
    told = {(r.symbol, r.ts): (r.v, r["sum"]) for r in got}
    for symbol, own in by_symbol(rows).items():
        v = total = 0.0
        for i, row in enumerate(x for x in own if x[0] != "A" or x[1] < datetime(2025, 1, 1)):
            v, total = (-0.5 if i % 5 == 0 else 0.75) * v + row[5], total + row[6]
            assert told[symbol, row[1]] == pytest.approx((v, total))


@pytest.mark.parametrize("block", [10, 256])
def test_full_history_features(series, block):
    df, rows = series
    got = {(r.symbol, r.ts): r for r in ck.full_history(df, ema=(5,), atr=(6,), rsi=(4,), block=block).collect()}
    assert len(got) == len(rows)
    for symbol, own in by_symbol(rows).items():
        close = np.array([x[5] for x in own])
        before = np.r_[np.nan, close[:-1]]
        true_range = np.fmax([x[3] - x[4] for x in own], np.fmax(abs(np.array([x[3] for x in own]) - before), abs(np.array([x[4] for x in own]) - before)))

        def wilder(values, n, alpha):
            out, v = [None] * len(values), None
            for k in range(n - 1, len(values)):
                v = float(np.mean(values[:n])) if v is None else v + alpha * (values[k] - v)
                out[k] = v
            return out

        ema, atr, moves = wilder(close, 5, 2 / 6), wilder(true_range, 6, 1 / 6), np.diff(close)
        up, down = wilder(np.maximum(moves, 0), 4, 1 / 4), wilder(np.maximum(-moves, 0), 4, 1 / 4)
        rsi = [None] + [None if u is None else 100.0 if d == 0 else 100 - 100 / (1 + u / d) for u, d in zip(up, down)]
        for row, e, a, x in zip(own, ema, atr, rsi):
            r = got[symbol, row[1]]
            assert (r.ema_5, r.atr_6, r.rsi_4) == (e and pytest.approx(e), a and pytest.approx(a), x if x is None else pytest.approx(x))


def test_no_rows(spark, series):
    none = series[0].where("false")
    assert ck.full_history(none, ema=(3,)).count() == 0
    assert ck.in_blocks(none, 5, lambda d: d.select("symbol", "__own")).count() == 0
