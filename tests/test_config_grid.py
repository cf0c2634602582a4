"""A grid in one plan against each setup on its own."""

import pytest
from pyspark.sql import functions as F

from barline.operators import config_grid as cg
from barline.operators import strategies as so
from barline.operators.strategies import Setup
from barline.plans.strategy_queries import CONFIGS, SETUPS
from barline.sources import market as m


def rounded(rows):
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else v for v in r) for r in rows)


#: One setup for each mode, filter, exit and limit.
CHOSEN = {"short_rsi", "long_atr_ratio", "long_volume", "long_fade_v2", "short_volfilter", "exit_rsi", "exit_donchian", "exit_chandelier", "exit_pctb", "exit_trailing", "three_positions", "long_pullback"}


def test_every_setup_in_one_grid(spark, small):
    bars = m.daily_bars(spark, small).where("symbol IN ('AF', 'NO')").cache()
    # More configurations than a word holds; each setup stands in the first word or the third one.
    filler = [Setup(f"x{i}", window=12, deviations=5.0 + i / 100) for i in range(120)]
    setups = [*SETUPS[:13], *filler, *SETUPS[13:]]
    got = {}
    for r in cg.trades(bars, setups).collect():
        got.setdefault(r.config_id, []).append(tuple(r)[1:])
    for i, s in enumerate(setups):
        if s.name in CHOSEN:
            assert rounded(got.get(i, [])) == rounded(so.trades_of(bars, s).collect()), s.name
    bars.unpersist()


def test_words_hold_the_last_bit(spark, small):
    bars = m.daily_bars(spark, small).where("symbol = 'AF'")
    setups = [Setup(f"s{i}", window=10, deviations=1.0, take_profit=1.0 + i / 64) for i in range(64)]
    done = cg.trades(bars, setups)
    counts = {r.config_id: r["count"] for r in done.groupBy("config_id").count().collect()}
    assert len(counts) == 64 and len(set(counts.values())) == 1
    assert {r.outcome for r in done.where("config_id = 63").collect()} >= {"stop", "target"}


def test_one_scan_and_no_nested_loop(spark, small):
    plan = cg.totals(cg.trades(m.wide_bars(spark, small), CONFIGS))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 2 and "Cross" not in plan  # read for the counts by span and for the rows
    physical = cg.totals(cg.trades(m.wide_bars(spark, small), CONFIGS))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in physical and "CartesianProduct" not in physical


def test_refusals(spark, small):
    bars = m.daily_bars(spark, small)
    for bad in ([], [Setup("a", hold=0)], [Setup("a", mode="x")], [Setup("a", -1, trail=1.0)], [Setup("a", exit_rule="rsi")], [Setup("a")] * (cg.MOST_CONFIGS + 1)):
        with pytest.raises(ValueError):
            cg.trades(bars, bad)


def test_features_are_shared():
    have = cg.Features.of(CONFIGS)
    assert len(have.bands) == 5 and have.others == (("rsi", 7),)
    # 200 configurations ask for 20 conditions on bands and 2 on the index.
    assert len({k for s in CONFIGS for k in cg.conditions(s, have)}) == 22


def test_no_bars(spark, small):
    assert cg.trades(m.daily_bars(spark, small).where(F.lit(False)), SETUPS).count() == 0
