"""Golden values and brute force for single operators."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from barline.functions import features as ft
from barline.functions import stats as st
from barline.operators import replay as rp
from barline.operators import rules as rl
from barline.operators import trades as tr
from barline.plans.ledger import Ledger, LedgerError
from barline.sources import market


def bars_of(spark, closes, symbol="X"):
    rows = [(symbol, datetime(2020, 1, 1) + timedelta(days=i), float(c), float(c), float(c), float(c), 1.0) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double")


def test_sma_and_ema_goldens(spark):
    rows = bars_of(spark, [1, 2, 3, 4, 5]).select("ts", ft.sma(F.col("close"), 3).alias("s"), ft.ema(F.col("close"), 3, 5).alias("e")).orderBy("ts").collect()
    assert [r.s for r in rows] == [None, None, 2.0, 3.0, 4.0]
    assert [r.e for r in rows] == [None, None, 2.0, 3.0, 4.0]


def test_rsi_goldens(spark):
    up = bars_of(spark, range(1, 20)).select("ts", ft.rsi_of(ft.window_array(F.col("close"), 19), 5).alias("r")).orderBy("ts").collect()
    assert up[-1].r == 100.0 and up[3].r is None
    down = bars_of(spark, range(20, 1, -1)).select("ts", ft.rsi_of(ft.window_array(F.col("close"), 19), 5).alias("r")).orderBy("ts").collect()
    assert down[-1].r == 0.0


def test_features_are_causal(spark):
    rng = np.random.default_rng(1)
    closes = (100 + np.cumsum(rng.integers(-3, 4, 80))).tolist()
    every = {"z": ft.zscore(F.col("close"), 10), "b": ft.band_ratio(F.col("close"), 5, 20), "e": ft.ema(F.col("close"), 5, 30), "d": ft.donchian_low(7)}
    cut = lambda n: {r.ts: r for r in bars_of(spark, closes[:n]).select("ts", *[c.alias(k) for k, c in every.items()]).collect()}
    short, long = cut(50), cut(80)
    assert all(long[t] == r for t, r in short.items())
    with pytest.raises(ValueError):
        ft.ago(F.col("close"), -1)


def test_rule_round_trip_and_checks():
    r = rl.Rule((rl.Clause("cross", rl.Feature("sma", 5), True, rl.Feature("sma", 20)),), take_profit=2.0)
    assert rl.Rule.from_json(r.to_json()) == r
    with pytest.raises(ValueError):
        rl.Rule((rl.Clause("compare", rl.Feature("close"), True, rl.Feature("volume")),)).check()
    with pytest.raises(ValueError):
        rl.Rule((rl.Clause("threshold", rl.Feature("close"), True, level=3.0),)).check()
    with pytest.raises(ValueError):
        rl.Formula("__import__('os')", ("x",)).column()


def test_bracket_stop_wins_ties_and_gaps_fill_at_the_open(spark):
    rows = [("X", datetime(2020, 1, i + 1), *v, 1.0) for i, v in enumerate([(10.0, 10.0, 10.0, 10.0), (10.0, 10.5, 9.8, 10.0), (10.0, 13.0, 7.0, 10.0), (6.0, 6.0, 6.0, 6.0)])]
    b = tr.numbered(spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"))
    s = spark.createDataFrame([("X", 0, 2.0, 2.0), ("X", 1, 4.0, 9.0), ("X", 2, 3.0, 3.0), ("X", 3, 3.0, 3.0)], "symbol string, bar_ix bigint, stop_distance double, target_distance double")
    got = {r.bar_ix: (r.outcome, r.exit_price, r.exit_ix) for r in tr.bracket_trades(b, s, 5).collect()}
    assert got == {0: ("stop", 8.0, 2), 1: ("stop", 6.0, 3), 2: ("stop", 6.0, 3)}


def replayed(opens, highs, lows, closes, signals, **rules):
    """One account over hand-made bars; ``signals``: bar to distances of stop and target."""
    bars = {k: np.array(v, float) for k, v in {"open": opens, "high": highs, "low": lows, "close": closes}.items()}
    stop, target = np.zeros(len(opens)), np.zeros(len(opens))
    for i, (d, t) in signals.items():
        stop[i], target[i] = d, t
    return rp.replay(bars, np.array(sorted(signals), int), stop, target, rp.Account(**({"cash": 1000, "fee": 0.0, "lot": 1.0, "risk": 0.01} | rules)))


def test_replay_matches_a_hand_made_account():
    run = replayed([10, 10, 11, 12], [10, 11, 14, 12], [10, 9.5, 11, 12], [10, 11, 13, 12], {0: (2.0, 3.0)})
    assert run.trades == [(1, 2, 10.0, 13.0, 5.0, "target")] and run.equity.tolist() == [1000, 1005, 1015, 1015]


def test_replay_gaps_denials_and_ties():
    # The gap up at the entry makes the risk larger, so the quantity is what the open's distance allows.
    assert replayed([10, 12, 12], [10, 12, 12], [10, 12, 12], [10, 12, 12], {0: (3.0, 9.0)}).trades == [] and replayed([10, 12, 12], [10, 12, 12], [10, 12, 12], [10, 12, 12], {0: (3.0, 9.0)}).equity[-1] == 1000
    # Outside of stop and target at the open: denied, and counted.
    for opening in (7.0, 6.0, 19.0, 20.0):
        assert replayed([10, opening, 10], [10, 20, 10], [10, 5, 10], [10, 10, 10], {0: (3.0, 9.0)}).denied == 1
    # A gap below the stop fills at the open; a gap above the target at the target; a touch of the target alone is none.
    down = replayed([10, 10, 5, 5], [10, 10, 5, 5], [10, 10, 5, 5], [10, 10, 5, 5], {0: (2.0, 3.0)})
    assert [(t[3], t[5]) for t in down.trades] == [(5.0, "stop")]
    up = replayed([10, 10, 20, 20], [10, 10, 20, 20], [10, 10, 20, 20], [10, 10, 20, 20], {0: (2.0, 3.0)})
    assert [(t[3], t[5]) for t in up.trades] == [(13.0, "target")]
    assert replayed([10, 10, 12], [10, 13, 13], [10, 10, 12], [10, 12, 12], {0: (2.0, 3.0)}).trades == []
    # Both in one bar: the stop, and the bar is ambiguous.
    both = replayed([10, 10], [10, 14], [10, 7], [10, 10], {0: (2.0, 3.0)})
    assert both.trades[0][5] == "stop" and both.ambiguous == 1
    # After its last bar the next open ends a position, and that bar may signal again.
    flat = [10.0] * 6
    late = replayed(flat, flat, flat, flat, {0: (2.0, 3.0), 1: (2.0, 3.0), 3: (2.0, 3.0)}, hold=2)
    assert [(t[0], t[1], t[5]) for t in late.trades] == [(1, 3, "timeout")] and late.equity[-1] == 1000
    assert replayed(flat, flat, flat, flat, {5: (2.0, 3.0)}).trades == []  # no bar left to enter


def test_statistics():
    assert st.expected_max_sharpe(1) == 0 and 2.4 < st.expected_max_sharpe(100) < 2.6
    years = st.min_backtest_years(45, 1.0)
    assert st.max_trials_within(years, 1.0) >= 45 and st.min_backtest_years(st.max_trials_within(years, 1.0) + 1, 1.0) > years
    sr0 = math.sqrt(0.5 / 250) * st.expected_max_sharpe(100)
    assert sr0 * math.sqrt(250) == pytest.approx(1.7894, abs=2e-3)
    assert st.deflated_sharpe(2.5 / math.sqrt(250), 1250, -3, 10, 100, 0.5 / 250) == pytest.approx(0.9004, abs=2e-3)
    for train, test in st.purged_splits(60):
        assert not set(train) & set(test) and len(test) == 20
    assert st.greedy_decorrelate({'a': 2, 'b': 1, 'c': 0}, {('a', 'b'): -0.9}, 0.5) == ['a']
    assert st.greedy_decorrelate({"a": 3, "b": 2, "c": 1}, {("a", "b"): 0.9, ("a", "c"): 0.1, ("b", "c"): 0.2}, 0.5) == ["a", "c"]


def test_cscv_against_numpy(spark):
    import itertools

    rng = np.random.default_rng(3)
    x = rng.integers(-50, 60, (5, 40)).astype(float)
    rows = [(c, t, float(x[c, t])) for c in range(5) for t in range(40)]
    got = {r.split: (r.best, r.omega) for r in st.cscv(spark.createDataFrame(rows, "config_id bigint, obs_ix bigint, ret double"), 4).collect()}
    blocks = np.array_split(np.arange(40), 4)
    for i, chosen in enumerate(itertools.combinations(range(4), 2)):
        inside = np.concatenate([blocks[b] for b in chosen])
        outside = np.setdiff1d(np.arange(40), inside)
        sharpe = lambda ix: x[:, ix].mean(axis=1) / x[:, ix].std(axis=1)  # noqa: E731, B023
        best, out = int(np.argmax(sharpe(inside))), sharpe(outside)
        assert got[i][0] == best and got[i][1] == pytest.approx(((out < out[best]).sum() + 1) / 6)


def test_ledger_refuses(spark, tmp_path):
    led = Ledger(spark, str(tmp_path))
    led.append("campaigns", spark.createDataFrame([(1,)], "campaign_id bigint"))
    trial = lambda t, c: spark.createDataFrame([(t, c)], "trial_id bigint, campaign_id bigint")
    led.append("trials", trial(1, 1))
    for bad in (trial(1, 1), trial(2, 9)):
        with pytest.raises(LedgerError):
            led.append("trials", bad)
    led.append("abandonments", spark.createDataFrame([(1,)], "campaign_id bigint"))
    with pytest.raises(LedgerError):
        led.append("trials", trial(3, 1))
    assert led.table("trials").count() == 1


def test_sources(spark, tmp_path):
    b = bars_of(spark, [1, 2, 3])
    market.write_bars(b, str(tmp_path / "bars"))
    assert market.read_bars(spark, str(tmp_path / "bars"), "X").count() == 3
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        market.write_bars(b, str(tmp_path / "bars"))
    assert market.in_sample(b, "2021-01-01").count() == 3
    with pytest.raises(ValueError):
        market.in_sample(b, "2020-01-02")


def test_imports_without_a_session():
    import subprocess
    import sys

    assert subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries(); e.oracle_sql()"], cwd=__file__.rsplit("/", 2)[0], timeout=120).returncode == 0


def test_clusters_of_series():
    from barline.functions import validation as va

    r = np.random.default_rng(0)
    x = np.vstack([g + 0.3 * r.normal(size=(4, 300)) for g in r.normal(size=(3, 300))])
    label = va.cluster_series(np.sqrt(np.clip(1 - np.corrcoef(x), 0, None) / 2))
    assert len(set(label.tolist())) == 3 and all(len(set(label[i : i + 4].tolist())) == 1 for i in (0, 4, 8))
    stats = [{"name": "a", "decile_rank": 0.9, "week_t": 4}, {"name": "b", "decile_rank": -0.8, "week_t": -5}, {"name": "c", "decile_rank": 0.5, "week_t": 9}]
    assert va.select_features(stats, {("a", "b"): 0.9}) == ["b"] and va.select_features(stats, {}) == ["b", "a"]


def test_alignment_on_the_driver(spark):
    from datetime import date

    from barline.operators import alignment as al

    assert al.timeframe_seconds("15m") == 900 and al.timeframe_seconds("4h") == 14_400
    with pytest.raises(ValueError):
        al.timeframe_seconds("0h")
    assert al.normalized_window(datetime(2020, 1, 1, 0, 10), datetime(2020, 1, 1, 3, 5), "1h") == (datetime(2020, 1, 1, 1), datetime(2020, 1, 1, 3))
    with pytest.raises(ValueError):
        al.normalized_window(datetime(2020, 1, 1, 0, 10), datetime(2020, 1, 1, 0, 50), "1h")
    assert al.add_months(date(2020, 1, 31), 1) == date(2020, 2, 29) and al.add_months(date(2020, 11, 30), 3) == date(2021, 2, 28)
    folds = al.fold_schedule(date(2020, 2, 10), date(2021, 12, 31), 12)
    assert folds[0] == (date(2020, 4, 1), date(2021, 4, 1), date(2021, 7, 1)) and folds[-1][2] <= date(2021, 12, 31)
    a = spark.createDataFrame([("X", datetime(2020, 1, i), i) for i in (1, 2)], "symbol string, ts timestamp_ntz, bar_ix bigint")
    with pytest.raises(ValueError):
        al.followed_by(a, a)
    with pytest.raises(ValueError):
        al.assert_aligned(a, a.where("bar_ix = 1"), ["symbol", "ts"])
    al.assert_aligned(a, a, ["symbol", "ts"])


def test_normal_distribution(spark):
    from pyspark.sql import functions as F

    zs = [-40.0, -8.0, -7.1, -3.3, -1.0, 0.0, 0.5, 2.0, 6.9, 7.2, 30.0]
    got = [r.p for r in spark.createDataFrame([(z,) for z in zs], "z double").select(st.normal_cdf(F.col("z")).alias("p")).collect()]
    assert got == pytest.approx([0.5 * math.erfc(-z / math.sqrt(2)) for z in zs], rel=1e-7, abs=1e-14)


def test_portfolio_by_steps(spark):
    from datetime import timedelta

    from pyspark.sql import functions as F

    from barline.functions import validation as va

    r = np.random.default_rng(5)
    base = r.normal(0, 0.01, (3, 80))
    series = {1: base[0], 2: base[0] + r.normal(0, 0.001, 80), 3: base[1], 4: 2 * base[2], 5: base[1]}
    rows = [(k, datetime(2020, 1, 1) + timedelta(days=i), float(v)) for k, x in series.items() for i, v in enumerate(x)]
    trials = spark.createDataFrame([(1, "a", 5.0), (2, "b", 4.0), (3, "c", 3.0), (4, "d", 2.0), (5, "c", 3.0)], "trial_id bigint, cell string, score double")
    returns = spark.createDataFrame(rows, "member bigint, ts timestamp_ntz, ret double")
    steps, weights, out = va.build_portfolio(trials, returns, F.year("ts") * 100 + F.month("ts"))
    assert steps == {"representatives": [1, 2, 3, 4], "decorrelated": [1, 3, 4], "capped": [1, 3, 4]}
    w = {x.member: x.weight for x in weights.collect()}
    inverse = {k: 1 / np.std(series[k], ddof=1) for k in (1, 3, 4)}
    assert w == pytest.approx({k: v / sum(inverse.values()) for k, v in inverse.items()})
    held, want, month = None, [], None
    for i in range(80):
        ts = datetime(2020, 1, 1) + timedelta(days=i)
        held = dict(w) if held is None or ts.month != month else held
        month, before = ts.month, sum(held.values())
        held = {k: v * (1 + series[k][i]) for k, v in held.items()}
        want.append(sum(held.values()) / before - 1)
    assert [x.ret for x in out.orderBy("ts").collect()] == pytest.approx(want)
    with pytest.raises(ValueError):
        va.build_portfolio(trials, returns.where("ts < TIMESTAMP_NTZ '2020-01-10'"), F.year("ts"))
