"""Portfolios in rounds equal the walk on one machine; the robustness gate fails closed."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barline.functions import gates as gt
from barline.functions import portfolios as pf
from barline.functions import stats as st

T0 = datetime(2020, 1, 1)


@pytest.mark.parametrize("seed,share", [(1, 0.2), (2, 0.5), (3, 0.9)])
def test_filter_in_rounds_equals_the_walk(spark, seed, share):
    rng = random.Random(seed)
    ranked, rho, want = [], [], {}
    for campaign, n in enumerate((1, 2, 9, 25)):
        scores = {t: float(n - t) for t in range(n)}
        pairs = {}
        for a in range(n):
            for b in range(a):
                x = rng.choice([0.1, -0.1]) if rng.random() > share else rng.choice([0.9, -0.9, None, float("nan"), "absent"])
                if x != "absent":
                    pairs[(a, b)] = float("nan") if x is None else x
                    rho.append((campaign, a, b, x))
        ranked += [(campaign, t, scores[t], t + 1) for t in range(n)]
        want[campaign] = st.greedy_decorrelate(scores, pairs, 0.5)
    d = spark.createDataFrame(ranked, "campaign bigint, trial bigint, score double, place bigint")
    got = pf.decorrelated(d, spark.createDataFrame(rho, "campaign bigint, trial bigint, other bigint, rho double"), 0.5).collect()
    assert {c: sorted(r.trial for r in got if r.campaign == c and r.kept) for c in want} == {c: sorted(v) for c, v in want.items()}
    assert all(r.kept is not None for r in got) and len(got) == len(ranked)


def test_a_chain_of_conflicts_is_settled(spark):
    n = 7
    d = spark.createDataFrame([(0, t, float(-t), t + 1) for t in range(n)], "campaign bigint, trial bigint, score double, place bigint")
    rho = [(0, a, b, 0.9 if a - b == 1 else 0.0) for a in range(n) for b in range(a)]
    got = pf.decorrelated(d, spark.createDataFrame(rho, "campaign bigint, trial bigint, other bigint, rho double"), 0.5).collect()
    assert sorted(r.trial for r in got if r.kept) == [0, 2, 4, 6]


def test_representatives(spark):
    rows = [(0, 3, 1, 2.0), (0, 1, 1, 2.0), (0, 2, None, 1.0), (0, 4, None, 3.0), (0, 5, 2, None), (0, 6, 2, float("nan")), (1, 1, 1, -1.0)]
    got = pf.representatives(spark.createDataFrame(rows, "campaign bigint, trial bigint, cell bigint, score double")).collect()
    assert sorted((r.campaign, r.trial, r.place) for r in got) == [(0, 1, 2), (0, 2, 3), (0, 4, 1), (1, 1, 1)]


def test_portfolio_drifts_within_a_period(spark):
    rng = random.Random(5)
    ret = {t: [rng.uniform(-0.1, 0.1) for _ in range(40)] for t in (1, 2)} | {3: [0.0] * 40}
    rows = [(0, t, T0 + timedelta(days=i), x) for t, xs in ret.items() for i, x in enumerate(xs)]
    rows += [(0, 1, T0 + timedelta(days=99), 0.5)]  # not common
    rows += [(1, 1, T0 + timedelta(days=i), 0.01 * (i % 2)) for i in range(10)]  # too few points
    returns = spark.createDataFrame(rows, "campaign bigint, trial bigint, ts timestamp_ntz, ret double")
    chosen = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (0, 3, 3), (1, 1, 1)], "campaign bigint, trial bigint, place bigint")
    common = pf.common_points(chosen, returns)
    shares = pf.weights(common, 30)
    w = {(r.campaign, r.trial): r for r in shares.collect()}
    assert w[1, 1].weight is None and w[1, 1].reason == "too few common points" and w[0, 3].weight == 0.0
    assert w[0, 1].weight + w[0, 2].weight == pytest.approx(1.0) and w[0, 1].n_common == 40
    month = F.struct(F.year("ts"), F.month("ts"))
    got = [r.ret for r in pf.combined(common, shares, month).orderBy("ts").collect()]
    start = [w[0, t].weight for t in (1, 2, 3)]
    holdings, want = list(start), []
    for i in range(40):
        day, before = T0 + timedelta(days=i), T0 + timedelta(days=i - 1)
        if i and day.month != before.month:
            total = sum(holdings)
            holdings = [x * total for x in start]
        value = sum(holdings)
        holdings = [h * (1 + ret[t][i]) for h, t in zip(holdings, (1, 2, 3))]
        want.append(sum(holdings) / value - 1)
    assert got == pytest.approx(want, abs=1e-12)


def test_costs_and_days(spark):
    bars = spark.createDataFrame([("a", T0 + timedelta(hours=12 * i), c) for i, c in enumerate([10.0, 11.0, 12.0, 6.0])], "symbol string, ts timestamp_ntz, close double")
    got = [r.ret for r in pf.net_returns(bars, F.when(F.col("close") > 10.5, 1.0), 0.01).orderBy("ts").collect()]
    assert got == pytest.approx([0.0, 12 / 11 - 1 - 0.01, -0.5])
    days = pf.on_days(spark.createDataFrame([("a", T0, 0.1), ("a", T0 + timedelta(hours=12), 0.2), ("a", T0 + timedelta(days=1), 0.5)], "k string, ts timestamp_ntz, ret double"), ["k"]).orderBy("ts").collect()
    assert [(r.ts, r.ret) for r in days] == [(T0, 0.1), (T0 + timedelta(days=1), pytest.approx(0.8))]


def test_robustness_fails_closed(spark):
    rng = random.Random(2)
    good = [rng.gauss(0.02, 0.02) for _ in range(80)]
    rows = lambda c, xs: [(c, T0 + timedelta(days=i), x) for i, x in enumerate(xs)]
    schema = "campaign bigint, ts timestamp_ntz, ret double"
    mk = lambda *parts: spark.createDataFrame([r for p in parts for r in p], schema)
    names = range(7)  # 0 passes; 1 no second source; 2 short overlap; 3 falls; 4 loses under stress; 5 has nothing; 6 a loss on the first source
    loss = [-x for x in good]
    stressed = mk(*[rows(c, good) for c in (0, 1, 2, 3, 6)], rows(4, loss))
    primary = mk(*[rows(c, good) for c in (0, 1, 2, 3, 4)], rows(6, loss))
    second = mk(rows(0, good), rows(2, good[:59]), rows(3, [x - 0.012 for x in good]), rows(4, good), rows(6, good))
    counts = spark.createDataFrame([(c, 10, 4, 0.5) for c in names], "campaign bigint, n_raw bigint, n_eff bigint, var_score double")
    got = {r.campaign: r for r in gt.robustness_gate(spark.createDataFrame([(c,) for c in names], "campaign bigint"), stressed, primary, second, counts, 1, 252.0, 0.95).collect()}
    assert {c for c, r in got.items() if r.passed} == {0} and len(got) == 7
    assert got[0].sharpe_drop == 0.0 and got[0].n_eff == 5 and got[0].n_raw == 11 and got[0].reason.startswith("costs x 2: Sharpe ")
    assert got[1].reason == "no returns on a second source" and got[2].reason == "only 59 common bars with the second source"
    assert "a drop above 0.3" in got[3].reason and got[3].reason.startswith("Sharpe ")
    assert "is not > 0" in got[4].reason and "DSR" in got[4].reason
    assert got[5].reason.startswith("Sharpe no with costs x 2") and "second source" in got[5].reason
    assert got[6].sharpe_drop == float("inf") and not got[6].passed
