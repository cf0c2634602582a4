"""Gate verdicts as relations: minimum length, in-sample limits, overfitting and deflated ratios at both trial counts.

A comparison with NULL or NaN fails its gate. Reasons tell the figures, in the order in which limits are looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.functions import portfolios as pf
from barline.functions import stats as st

#: Steps of Newton's method for the inverse distribution: from 0 it nears the root from one side.
STEPS = 40
ROOT = math.sqrt(2 * math.pi)


def normal_inverse(p: Column) -> Column:
    """The inverse of the normal distribution function for 0 < p < 1, by Newton's method on the upper half; NULL elsewhere."""
    upper = F.greatest(p, 1 - p)
    step = lambda z, _: z + (upper - st.normal_cdf(z)) * ROOT * F.exp(z * z / 2)
    z = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.lit(0.0), step)
    return F.when((p > 0) & (p < 1), F.when(p >= 0.5, z).otherwise(-z))


def normal_inverse_sql(p: str) -> str:
    z = f"list_reduce(list_prepend(0.0::DOUBLE, [0.0::DOUBLE for i in range({STEPS})]), lambda z, i: z + (greatest({p}, 1 - {p}) - ({st.normal_cdf_sql('z')})) * {ROOT!r}::DOUBLE * exp(z * z / 2))"
    return f"CASE WHEN {p} > 0 AND {p} < 1 THEN CASE WHEN {p} >= 0.5 THEN {z} ELSE -({z}) END END"


def expected_max(trials: Column) -> Column:
    """Expected largest of so many standard normal ratios; 0 for one trial or none."""
    n = trials.cast("double")
    z = (1 - st.EULER) * normal_inverse(1 - 1 / n) + st.EULER * normal_inverse(1 - 1 / (n * math.e))
    return F.when(trials <= 1, 0.0).otherwise(z)


def expected_max_sql(n: str) -> str:
    return f"CASE WHEN {n} <= 1 THEN 0.0 ELSE {1 - st.EULER!r}::DOUBLE * ({normal_inverse_sql(f'(1 - 1 / {n}::DOUBLE)')}) + {st.EULER!r}::DOUBLE * ({normal_inverse_sql(f'(1 - 1 / ({n}::DOUBLE * {math.e!r}::DOUBLE))')}) END"


def deflated(moments: DataFrame, trial_stats: DataFrame, variants: int, periods_per_year: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """``moments`` (n, sharpe, skew, kurtosis) with the ratio deflated by effective and by raw trials side by side.

    ``trial_stats``: one row (or one for each of ``keys``) with n_raw, n_eff and var_score, the variance of the trials' annual ratios.
    Portfolio variants count as trials. Adds n_eff, n_raw, var_sr, benchmark_n_eff, benchmark_n_raw, dsr_n_eff, dsr_n_raw.
    """
    if variants < 0 or periods_per_year <= 0:
        raise ValueError("variants must not be negative, and periods a year must be positive")
    one = trial_stats.select(*keys, (F.col("n_eff") + variants).alias("n_eff"), (F.col("n_raw") + variants).alias("n_raw"), (F.greatest("var_score", F.lit(0.0)) / periods_per_year).alias("var_sr"))
    one = one.withColumns({f"benchmark_{k}": F.sqrt("var_sr") * expected_max(F.col(k)) for k in ("n_eff", "n_raw")})
    d = moments.join(one, list(keys)) if keys else moments.crossJoin(F.broadcast(one))  # one row
    z = lambda k: st.sharpe_z(F.col("sharpe"), F.col(f"benchmark_{k}"), F.col("n"), F.col("skew"), F.col("kurtosis"))
    return d.withColumns({f"dsr_{k}": st.normal_cdf(z(k)) for k in ("n_eff", "n_raw")})


def shown(form: str, value: Column) -> Column:
    """A number as text; "no" without one."""
    return F.when(value.isNull(), "no").otherwise(F.format_string(form, value.cast("double")))


def min_length_gate(d: DataFrame, years: Column, trials: Column, target: float) -> DataFrame:
    """Gate 2 of rows: the years of data reach those below which the best of ``trials`` and this one reaches the target by luck."""
    need = F.pow(expected_max(trials + 1) / target, F.lit(2.0))
    ok = F.coalesce(years >= need, F.lit(False)) & ~F.isnan(years)
    text = F.concat(F.lit("IS "), shown("%.2f", years), F.lit(" y vs MinBTL "), shown("%.2f", need), F.lit(" y (N="), (trials + 1).cast("string"), F.lit(f", target Sharpe {target:g})"))
    return d.withColumns({"gate": F.lit("g2_minbtl"), "value": years, "passed": ok, "reason": text})


def in_sample_gate(d: DataFrame, min_trades: int, min_holding: float, max_corr: float | None = None) -> DataFrame:
    """Gate 3 of rows with sharpe, n_trades, avg_holding (and indicator_corr): limits, with every one that fails in the reason."""
    held = lambda c, ok: ~(F.coalesce(ok, F.lit(False)) & ~F.isnan(c.cast("double")))
    trades, holding = F.col("n_trades"), F.col("avg_holding")
    problems = [
        F.when(held(trades, trades >= min_trades), F.concat(shown("%.0f", trades), F.lit(f" trades < min_trades {min_trades}"))),
        F.when(held(holding, holding >= min_holding), F.concat(F.lit("average holding "), shown("%.2f", holding), F.lit(f" bars < min_holding_bars {min_holding:g}"))),
    ]
    if max_corr is not None:
        corr = F.col("indicator_corr")
        problems.append(F.when(held(corr, corr <= max_corr), F.concat(F.lit("indicators |rho| "), shown("%.3f", corr), F.lit(f" > max_indicator_corr {max_corr:g}"))))
    text = F.concat_ws("; ", *problems)
    summary = F.concat(F.lit("IS Sharpe "), shown("%.2f", F.col("sharpe")), F.lit(", "), shown("%.0f", trades), F.lit(" trades"))
    return d.withColumns({"gate": F.lit("g3_is"), "value": F.col("sharpe"), "passed": text == "", "reason": F.when(text == "", summary).otherwise(text)})


def ceiling_gate(d: DataFrame, name: str, value: Column, most: float, label: str) -> DataFrame:
    """A gate that a value must stay below (PBO, say)."""
    ok = F.coalesce(value < most, F.lit(False)) & ~F.isnan(value)
    return d.withColumns({"gate": F.lit(name), "value": value, "passed": ok, "reason": F.concat(F.lit(f"{label} "), shown("%.3f", value), F.when(ok, " < ").otherwise(" >= "), F.lit(f"{most:g}"))})


def deflated_gate(d: DataFrame, least: float) -> DataFrame:
    """Gate 5 of rows of :func:`deflated`: the ratio by effective trials reaches ``least``; that by raw trials stands beside it."""
    ok = F.coalesce(F.col("dsr_n_eff") >= least, F.lit(False)) & ~F.isnan("dsr_n_eff")
    return d.withColumns({"gate": F.lit("g5_dsr"), "value": F.col("dsr_n_eff"), "passed": ok, "reason": F.concat(F.lit("DSR "), shown("%.3f", F.col("dsr_n_eff")), F.lit(" (N_eff="), F.col("n_eff").cast("string"), F.lit("), "), shown("%.3f", F.col("dsr_n_raw")), F.lit(" (N_raw="), F.col("n_raw").cast("string"), F.lit(f") vs {least:g}"))})


def robustness_gate(campaigns: DataFrame, stressed: DataFrame, primary: DataFrame, second: DataFrame, trial_stats: DataFrame, variants: int, periods_per_year: float, least_dsr: float, multiplier: float = 2.0, most_drop: float = 0.30, least_common: int = 60) -> DataFrame:
    """Gate 6 of each campaign's portfolio: it bears stressed costs and a second source.

    ``campaigns``: campaign; ``stressed``, ``primary``, ``second``: campaign, ts, ret of the portfolio with costs times ``multiplier``, as
    it is, and on the second source. Under stress the ratio must stay above 0 and its deflated one (by effective trials) reach
    ``least_dsr``; on the bars that both sources have, the ratio may fall by ``most_drop`` at most. ``trial_stats`` is keyed by campaign.
    A campaign without returns, without a second source or with fewer than ``least_common`` common bars fails.
    """
    s = stressed.groupBy(*pf.KEY).agg(pf.annual_ratio(F.col("ret"), periods_per_year).alias("sharpe_stressed"))
    dsr = deflated(st.sharpe_moments(stressed, pf.KEY), trial_stats, variants, periods_per_year, tuple(pf.KEY)).select(*pf.KEY, "n_eff", "n_raw", "dsr_n_eff", "dsr_n_raw")
    has = second.select(*pf.KEY).distinct().withColumn("has_second", F.lit(True))
    both = primary.where("ret IS NOT NULL").select(*pf.KEY, "ts", F.col("ret").alias("x")).join(second.where("ret IS NOT NULL").select(*pf.KEY, "ts", F.col("ret").alias("y")), [*pf.KEY, "ts"])
    c = both.groupBy(*pf.KEY).agg(F.count("*").alias("n_common"), *[F.when(F.count("*") >= least_common, pf.annual_ratio(F.col(k), periods_per_year)).alias(n) for k, n in (("x", "sharpe_primary"), ("y", "sharpe_second"))])
    d = campaigns.select(*pf.KEY).distinct()
    for other in (s, dsr, has, c):
        d = d.join(other, pf.KEY, "left")
    pri, alt = F.col("sharpe_primary"), F.col("sharpe_second")
    drop = F.when(pri > 0, 1 - alt / pri).when(pri.isNotNull(), F.lit(float("inf")))
    d = d.withColumn("n_common", F.coalesce("n_common", F.lit(0))).withColumn("sharpe_drop", drop)
    fails = lambda c, ok: ~(F.coalesce(ok, F.lit(False)) & ~F.isnan(c))
    sh, ds, fall = F.col("sharpe_stressed"), F.col("dsr_n_eff"), F.col("sharpe_drop")
    problems = [
        F.when(fails(sh, sh > 0), F.concat(F.lit("Sharpe "), shown("%.2f", sh), F.lit(f" with costs x {multiplier:g} is not > 0"))),
        F.when(fails(ds, ds >= least_dsr), F.concat(F.lit(f"costs x {multiplier:g}: DSR "), shown("%.3f", ds), F.lit(f" < {least_dsr:g}"))),
        F.when(F.col("has_second").isNull(), F.lit("no returns on a second source"))
        .when(F.col("n_common") < least_common, F.concat(F.lit("only "), F.col("n_common").cast("string"), F.lit(" common bars with the second source")))
        .when(fails(fall, fall <= most_drop), F.concat(F.lit("Sharpe "), shown("%.2f", pri), F.lit(" -> "), shown("%.2f", alt), F.lit(f" on the second source (a drop above {most_drop:g})"))),
    ]
    text = F.concat_ws("; ", *problems)
    summary = F.concat(F.lit(f"costs x {multiplier:g}: Sharpe "), shown("%.2f", sh), F.lit(", DSR "), shown("%.3f", ds), F.lit("; second source drop "), shown("%.2f", fall))
    return d.withColumns({"gate": F.lit("g6_robustness"), "value": sh, "passed": text == "", "reason": F.when(text == "", summary).otherwise(text)}).drop("has_second")
