"""Bundles as a whole: packed arrays against loops, cuts that join again, refusals."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barline.sources import bundles as bd

T0 = datetime(2024, 1, 1)
POINTS = "symbol string, bar_ix bigint, segment_ix int, start_minute int, side int, minute int, price double"


def made(spark, seed=3, sizes=(("A", 11), ("B", 4)), at=T0, paths=True):
    rng = random.Random(seed)
    marks, funding, mark_points, trade_points = [], [], [], []
    for symbol, n in sizes:
        for b in range(n):
            marks.append((symbol, b, at + timedelta(minutes=60 * (b + 1)), float(rng.randint(90, 110))))
            for minute in rng.sample([0, 30, 31], rng.randint(0, 2)):
                funding.append((symbol, b, at + timedelta(minutes=60 * b + minute, seconds=rng.choice([0, 10])), rng.random(), 100.0))
            for points in (mark_points, trade_points):
                for k in range(2 if rng.random() < 0.8 else 1):
                    level = 100.0
                    for side, sign in ((0, -1), (1, 1)):
                        for j, minute in enumerate(sorted(rng.sample(range(30), rng.randint(1 - side, 4)))):
                            points.append((symbol, b, k, 30 * k, side, minute, level + sign * j))
    return {
        "marks": spark.createDataFrame(marks, "symbol string, bar_ix bigint, ts timestamp_ntz, close double"),
        "funding": spark.createDataFrame(funding, "symbol string, bar_ix bigint, ts timestamp_ntz, rate double, mark double"),
        "paths": spark.createDataFrame(mark_points, POINTS),
        "trade_paths": spark.createDataFrame(trade_points, POINTS),
        "brackets": spark.createDataFrame([(s, 1e9, 10, 0.05, 0.0) for s, _ in sizes], "symbol string, cap double, max_leverage int, mmr double, amount double"),
    }


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def walked(points, bars):
    """Flat arrays by loops over sorted rows."""
    out = {"bar_ptr": [0], "seg_start": []} | {f"{k}_{c}": [0] * (c == "ptr") for k in ("low", "high") for c in ("ptr", "ix", "px")}
    for b in bars:
        for k in sorted({p.segment_ix for p in points if p.bar_ix == b}):
            mine = [p for p in points if (p.bar_ix, p.segment_ix) == (b, k)]
            out["seg_start"].append(mine[0].start_minute)
            for side, name in enumerate(("low", "high")):
                for p in sorted((p for p in mine if p.side == side), key=lambda p: p.minute):
                    out[f"{name}_ix"].append(p.minute)
                    out[f"{name}_px"].append(p.price)
                out[f"{name}_ptr"].append(len(out[f"{name}_ix"]))
        out["bar_ptr"].append(len(out["seg_start"]))
    return out


@pytest.mark.parametrize("per", [1, 4, 100])
def test_packed_equals_loops(spark, per):
    b = made(spark)
    local = {k: v.collect() for k, v in b.items()}
    got = bd.packed(b, 60, per).collect()
    assert sum(len(r.bad) for r in got) == len(local["marks"]) and any(any(r.bad) for r in got) and not all(all(r.bad) for r in got)
    for r in got:
        bars = sorted(m.bar_ix for m in local["marks"] if m.symbol == r.symbol and m.bar_ix // per == r.block)
        for name, prefix in (("paths", ""), ("trade_paths", "t_")):
            for key, want in walked([p for p in local[name] if p.symbol == r.symbol], bars).items():
                assert r[prefix + key] == want, (key, r.symbol, r.block)
        ptr, minutes, bad = [0], [], []
        for x in bars:
            due = sorted((f for f in local["funding"] if (f.symbol, f.bar_ix) == (r.symbol, x)), key=lambda f: f.ts)
            here = [round((f.ts - T0 - timedelta(minutes=60 * x)).total_seconds() / 60) for f in due]
            minutes += here
            ptr.append(len(minutes))
            starts = [{p.start_minute for p in local[k] if (p.symbol, p.bar_ix) == (r.symbol, x)} for k in ("paths", "trade_paths")]
            bad.append(starts[0] != starts[1] or bool(set(here) - starts[0]))
        assert (r.fund_ptr, r.fund_minute, r.bad) == (ptr, minutes, bad)


def test_first_touch_of_a_segment(spark):
    d = spark.createDataFrame([([1, 4, 9, 2, 3], [100.0, 98.0, 95.0, 99.0, 97.0], 0, 3), ([1, 4, 9, 2, 3], [100.0, 98.0, 95.0, 99.0, 97.0], 3, 5)], "ix array<int>, px array<double>, a bigint, b bigint")
    touch = lambda level, above: [r.t for r in d.select(bd.first_touch(F.col("ix"), F.col("px"), F.col("a"), F.col("b"), F.lit(level), above).alias("t")).collect()]
    assert touch(98.0, False) == [4, 3] and touch(90.0, False) == [None, None] and touch(99.5, True) == [1, None]


def test_cuts_join_again(spark):
    b = made(spark)
    n = {"A": 11, "B": 4}
    head = bd.sliced(b, spark.createDataFrame([(s, 0, 3) for s in n], "symbol string, start bigint, stop bigint"))
    tail = bd.sliced(b, spark.createDataFrame([(s, 3, k) for s, k in n.items()], "symbol string, start bigint, stop bigint"))
    assert {r.symbol: r.n for r in tail["marks"].groupBy("symbol").agg(F.min("bar_ix").alias("n")).collect()} == {"A": 0, "B": 0}
    whole = bd.followed_by(head, tail)
    assert all(rows(whole[k]) == rows(b[k]) for k in b)
    late = bd.from_time(b, F.lit(T0 + timedelta(minutes=60 * 5)).cast("timestamp_ntz"))
    assert {r.symbol for r in late["marks"].collect()} == {"A"} and late["marks"].count() == 7  # B ends before
    assert rows(late["funding"]) == sorted((r.symbol, r.bar_ix - 4, r.ts, r.rate, r.mark) for r in b["funding"].collect() if r.symbol == "A" and r.bar_ix >= 4)
    for wrong in ((tail, head), (head, late), (head, head)):
        with pytest.raises(ValueError, match="follow"):
            bd.followed_by(*wrong)


def test_desynchronised_bundles_are_refused(spark):
    b = made(spark)
    bd.require(b)
    short = b | {"paths": b["paths"].where("NOT (symbol = 'A' AND bar_ix = 10)")}
    outside = b | {"funding": b["funding"].withColumn("bar_ix", F.col("bar_ix") + 100)}
    for broken, text in ((short, "bars without paths"), (outside, "funding outside"), (b | {"brackets": b["brackets"].where("symbol = 'A'")}, "B: no margin tiers"), (b | {"marks": b["marks"].where("bar_ix > 0")}, "not numbered")):
        with pytest.raises(ValueError, match=text):
            bd.require(broken)
