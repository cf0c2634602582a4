"""Gates fail closed, and tell why; the inverse distribution against the library's."""

from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from barline.functions import gates as gt
from barline.functions import stats as st


def test_inverse_and_expected_maximum(spark):
    ps = [1e-9, 0.001, 0.3, 0.5, 0.9, 0.999, 1 - 1e-7]
    for r in spark.createDataFrame([(p,) for p in [*ps, 0.0, 1.0]], "p double").select("p", gt.normal_inverse(F.col("p")).alias("z")).collect():
        assert r.z is None if r.p in (0.0, 1.0) else r.z == pytest.approx(NormalDist().inv_cdf(r.p), abs=1e-8)
    for r in spark.createDataFrame([(n,) for n in (0, 1, 2, 7, 1000, 10**6)], "n bigint").select("n", gt.expected_max(F.col("n")).alias("z")).collect():
        assert r.z == pytest.approx(st.expected_max_sharpe(r.n), abs=1e-9)


def test_limits_fail_closed(spark):
    rows = [("ok", 1.0, 60, 5.0, 0.3), ("few", 1.0, 10, 5.0, 0.3), ("nan", 1.0, 60, float("nan"), 0.3), ("null", None, None, None, None), ("both", 1.0, 10, 1.0, 0.9)]
    d = spark.createDataFrame(rows, "name string, sharpe double, n_trades bigint, avg_holding double, indicator_corr double")
    got = {r.name: r for r in gt.in_sample_gate(d, 50, 2.0, 0.7).collect()}
    assert {k: r.passed for k, r in got.items()} == {"ok": True, "few": False, "nan": False, "null": False, "both": False}
    assert got["ok"].reason == "IS Sharpe 1.00, 60 trades" and got["few"].reason == "10 trades < min_trades 50"
    assert got["both"].reason == "10 trades < min_trades 50; average holding 1.00 bars < min_holding_bars 2; indicators |rho| 0.900 > max_indicator_corr 0.7"
    assert got["null"].reason.startswith("no trades < min_trades 50; average holding no bars")


def test_ceiling_and_length(spark):
    d = spark.createDataFrame([(0.2,), (0.5,), (None,), (float("nan"),)], "pbo double")
    got = [(r.passed, r.reason) for r in gt.ceiling_gate(d, "g4_pbo", F.col("pbo"), 0.5, "PBO").collect()]
    assert got[0] == (True, "PBO 0.200 < 0.5") and got[1] == (False, "PBO 0.500 >= 0.5") and not got[2][0] and not got[3][0]
    d = spark.createDataFrame([(1.0, 1), (3.0, 1), (3.0, 500), (None, 1)], "years double, n bigint")
    rows = gt.min_length_gate(d, F.col("years"), F.col("n"), 1.0).collect()
    assert [r.passed for r in rows] == [y is not None and y >= st.min_backtest_years(n + 1, 1.0) for y, n in ((1.0, 1), (3.0, 1), (3.0, 500), (None, 1))]


def test_deflation_at_both_counts(spark):
    moments = spark.createDataFrame([("a", 500, 0.25, -0.2, 4.0), ("b", 500, 0.02, 0.0, 3.0)], "name string, n bigint, sharpe double, skew double, kurtosis double")
    counts = spark.createDataFrame([(40, 7, 0.6)], "n_raw bigint, n_eff bigint, var_score double")
    for r in gt.deflated(moments, counts, 3, 252.0).collect():
        for k, n in (("n_eff", 10), ("n_raw", 43)):
            assert r[k] == n
            assert r[f"dsr_{k}"] == pytest.approx(st.deflated_sharpe(r.sharpe, r.n, r.skew, r.kurtosis, n, 0.6 / 252), abs=1e-9)
    passed = {r.name: r.passed for r in gt.deflated_gate(gt.deflated(moments, counts, 3, 252.0), 0.95).collect()}
    assert passed == {"a": True, "b": False}
    with pytest.raises(ValueError):
        gt.deflated(moments, counts, -1, 252.0)
