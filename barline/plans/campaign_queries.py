"""Queries on portfolios of campaigns and their robustness: contrarian trials on weekly bars, a campaign every two years."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.functions import features as ft
from barline.functions import gates as gt
from barline.functions import portfolios as pf
from barline.functions import stats as st
from barline.operators.lineage import cut
from barline.registry import Registry
from barline.sources import market as m

R = Registry()
COST, LAGS, MOST_RHO, MOST, LEAST, A_YEAR, LEAST_DSR = 0.02, 4, 0.15, 5, 30, 52.0, 0.95
QUOTED, NET = "l_extendedprice * 100 / l_quantity", "l_extendedprice * (1 - l_discount) * 100 / l_quantity"
_CLOSE = "last(floor({}) ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)"
_W = "OVER (PARTITION BY trial ORDER BY ts)"


def _source_sql(name: str, price: str) -> str:
    return f"""{name}_side AS (SELECT trial, ts, CASE WHEN close < lag(close, {LAGS}) {_W} THEN 1.0::DOUBLE ELSE 0.0 END AS side, close / NULLIF(lag(close) {_W}, 0) - 1 AS move
FROM (SELECT (l_linenumber * 8 + l_suppkey % 8)::BIGINT AS trial, date_trunc('week', l_shipdate)::TIMESTAMP AS ts, {_CLOSE.format(price)} AS close FROM lineitem GROUP BY ALL)),
{name}_held AS (SELECT trial, ts, move, coalesce(lag(side) {_W}, 0) AS held, coalesce(lag(side, 2) {_W}, 0) AS before FROM {name}_side)"""


def _net_sql(name: str, held: str, cost: float) -> str:
    return f"{name} AS (SELECT (year(ts) - 1992) // 2 AS campaign, trial, ts, held * move - {cost!r}::DOUBLE * abs(held - before) AS ret FROM {held}_held WHERE move IS NOT NULL)"


def _combined_sql(name: str, returns: str) -> str:
    w = "PARTITION BY campaign, trial, year(ts), month(ts) ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND"
    return f"""{name}_full AS (SELECT r.campaign, r.ts FROM {returns} r JOIN members USING (campaign, trial) GROUP BY r.campaign, r.ts HAVING count(*) = (SELECT count(*) FROM members k WHERE k.campaign = r.campaign)),
{name}_common AS (SELECT r.* FROM {returns} r JOIN members USING (campaign, trial) JOIN {name}_full USING (campaign, ts)),
{name} AS (SELECT campaign, ts, sum(after) / NULLIF(sum(before), 0) - 1 AS ret FROM (SELECT c.campaign, c.ts, weight * product(1 + ret) OVER ({w} CURRENT ROW) AS after, weight * coalesce(product(1 + ret) OVER ({w} 1 PRECEDING), 1) AS before FROM {name}_common c JOIN shares USING (campaign, trial) WHERE weight IS NOT NULL) GROUP BY campaign, ts)"""


_STEPS = f"""WITH RECURSIVE {_source_sql('quoted', QUOTED)}, {_net_sql('base', 'quoted', COST)},
trials AS (SELECT campaign, trial, trial // 3 AS cell, CASE WHEN stddev_samp(ret) > 0 THEN avg(ret) / stddev_samp(ret) * sqrt({A_YEAR!r}::DOUBLE) ELSE 0.0 END AS score FROM base GROUP BY campaign, trial),
ranked AS (SELECT campaign, trial, score, row_number() OVER (PARTITION BY campaign ORDER BY score DESC, trial) AS place FROM (SELECT * FROM trials QUALIFY row_number() OVER (PARTITION BY campaign, cell ORDER BY score DESC, trial) = 1)),
mine AS (SELECT base.*, place FROM base JOIN ranked USING (campaign, trial)),
fits AS (SELECT campaign, trial, list(other) AS fit FROM (SELECT a.campaign, a.trial, b.trial AS other FROM mine a JOIN mine b ON a.campaign = b.campaign AND a.ts = b.ts AND b.place < a.place GROUP BY ALL HAVING count(*) >= {LEAST} AND abs(corr(a.ret, b.ret)) <= {MOST_RHO!r}) GROUP BY ALL),
walk AS (SELECT DISTINCT campaign, 0::BIGINT AS place, []::BIGINT[] AS kept FROM ranked UNION ALL
SELECT w.campaign, r.place, CASE WHEN len(list_intersect(w.kept, coalesce(f.fit, []))) = len(w.kept) THEN list_append(w.kept, r.trial) ELSE w.kept END FROM walk w JOIN ranked r ON r.campaign = w.campaign AND r.place = w.place + 1 LEFT JOIN fits f ON f.campaign = r.campaign AND f.trial = r.trial),
stays AS (SELECT campaign, unnest(kept) AS trial FROM (SELECT campaign, arg_max(kept, place) AS kept FROM walk GROUP BY campaign)),
steps AS (SELECT r.*, s.trial IS NOT NULL AS kept FROM ranked r LEFT JOIN stays s USING (campaign, trial)),
members AS (SELECT campaign, trial FROM steps WHERE kept QUALIFY row_number() OVER (PARTITION BY campaign ORDER BY place) <= {MOST}),
full_ AS (SELECT r.campaign, r.ts FROM base r JOIN members USING (campaign, trial) GROUP BY r.campaign, r.ts HAVING count(*) = (SELECT count(*) FROM members k WHERE k.campaign = r.campaign)),
spread AS (SELECT r.campaign, r.trial, count(*) AS n_common, CASE WHEN stddev_samp(ret) > 0 THEN 1 / stddev_samp(ret) ELSE 0.0 END AS inverse FROM base r JOIN members USING (campaign, trial) JOIN full_ USING (campaign, ts) GROUP BY ALL),
shares AS (SELECT campaign, trial, n_common, CASE WHEN n_common >= {LEAST} AND sum(inverse) OVER c > 0 THEN inverse / sum(inverse) OVER c END AS weight FROM spread WINDOW c AS (PARTITION BY campaign))"""


def _bars(spark: SparkSession, sf: str, price: str) -> DataFrame:
    """Weekly closes of 56 series: line items by line number and supplier."""
    d = m.read(spark, sf, "lineitem")
    ticks = d.select((F.col("l_linenumber") * 8 + F.col("l_suppkey") % 8).alias("symbol"), F.col("l_shipdate").alias("ts"), F.floor(F.expr(price)).cast("double").alias("price"), F.col("l_quantity").alias("volume"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("seq"))
    return m.bars(ticks, F.date_trunc("week", "ts").cast("timestamp_ntz"))


def _net(bars: DataFrame, cost: float) -> DataFrame:
    side = (F.col("close") < ft.ago(F.col("close"), LAGS)).cast("double")
    r = pf.net_returns(bars, side, cost)
    return r.select(F.floor((F.year("ts") - 1992) / 2).cast("bigint").alias("campaign"), F.col("symbol").cast("bigint").alias("trial"), "ts", "ret")


def _month() -> Column:
    return F.struct(F.year("ts"), F.month("ts"))


def _built(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, pf.Portfolios]:
    bars = cut(_bars(spark, sf, QUOTED))
    base = cut(_net(bars, COST))
    trials = base.groupBy("campaign", "trial").agg(pf.annual_ratio(F.col("ret"), A_YEAR).alias("score")).withColumn("cell", F.floor(F.col("trial") / 3))
    return bars, base, trials, pf.build(trials, base, _month(), MOST_RHO, MOST, LEAST)


@R.query(_STEPS + " SELECT s.campaign, s.trial, s.score, s.place, s.kept, m.trial IS NOT NULL AS member, h.weight, h.n_common FROM steps s LEFT JOIN members m USING (campaign, trial) LEFT JOIN shares h USING (campaign, trial)")
def campaign_portfolios(spark: SparkSession, sf: str) -> DataFrame:
    """Each campaign's representatives, which of them the correlation filter keeps, and the members' weights (five are the portfolio's cap)."""
    p = _built(spark, sf)[3]
    shares = p.shares.select("campaign", "trial", "n_common", "weight", F.lit(True).alias("member"))
    return p.steps.join(shares, ["campaign", "trial"], "left").select("campaign", "trial", "score", "place", "kept", F.coalesce("member", F.lit(False)).alias("member"), "weight", "n_common")


@R.query(_STEPS + f", {_combined_sql('portfolio', 'base')} SELECT campaign, ts, ret FROM portfolio")
def campaign_returns(spark: SparkSession, sf: str) -> DataFrame:
    """Weekly returns of each campaign's portfolio, rebalanced by month."""
    return _built(spark, sf)[3].returns


_Z = "CASE WHEN 1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe * sharpe > 0 AND n > 1 THEN (sharpe - benchmark_{0}) * sqrt(n - 1.0) / sqrt(1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe * sharpe) END AS z_{0}"
_RATIO = "CASE WHEN stddev_samp({0}) > 0 THEN avg({0}) / stddev_samp({0}) * sqrt(52.0::DOUBLE) ELSE 0.0 END"


@R.query(_STEPS + f""", {_net_sql('dear', 'quoted', 2 * COST)}, {_source_sql('other', NET)}, {_net_sql('alternative', 'other', COST)}, {_combined_sql('portfolio', 'base')}, {_combined_sql('stressed', 'dear')}, {_combined_sql('second', 'alternative')},
mean AS (SELECT campaign, count(*) AS n, avg(ret) AS mean FROM stressed GROUP BY campaign), mom AS (SELECT campaign, any_value(n) AS n, any_value(mean) AS mean, avg((ret - mean) ** 2) AS m2, avg((ret - mean) ** 3) AS m3, avg((ret - mean) ** 4) AS m4, {_RATIO.format('ret')} AS sharpe_stressed FROM stressed JOIN mean USING (campaign) GROUP BY campaign),
tk AS (SELECT campaign, count(*) + 1 AS n_raw, count(DISTINCT cell) + 1 AS n_eff, var_pop(score) / {A_YEAR!r}::DOUBLE AS var_sr FROM trials GROUP BY campaign),
q AS (SELECT campaign, n, sharpe_stressed, n_raw, n_eff, mean / sqrt(m2) AS sharpe, m3 / m2 ** 1.5 * sqrt(n * (n - 1.0)) / (n - 2) AS skew, (n - 1.0) / ((n - 2.0) * (n - 3.0)) * ((n + 1.0) * (m4 / (m2 * m2) - 3) + 6) + 3 AS kurtosis, sqrt(var_sr) * ({gt.expected_max_sql('n_eff')}) AS benchmark_n_eff, sqrt(var_sr) * ({gt.expected_max_sql('n_raw')}) AS benchmark_n_raw FROM mom JOIN tk USING (campaign)),
z AS MATERIALIZED (SELECT *, {_Z.format('n_eff')}, {_Z.format('n_raw')} FROM q), dsr AS MATERIALIZED (SELECT *, {st.normal_cdf_sql('z_n_eff')} AS dsr_n_eff, {st.normal_cdf_sql('z_n_raw')} AS dsr_n_raw FROM z),
both_ AS (SELECT p.campaign, count(*) AS n_common, CASE WHEN count(*) >= 60 THEN {_RATIO.format('p.ret')} END AS sharpe_primary, CASE WHEN count(*) >= 60 THEN {_RATIO.format('s.ret')} END AS sharpe_second FROM portfolio p JOIN second s USING (campaign, ts) GROUP BY p.campaign),
v AS (SELECT c.campaign, sharpe_stressed, n_eff, n_raw, dsr_n_eff, dsr_n_raw, coalesce(n_common, 0) AS n_common, sharpe_primary, sharpe_second, CASE WHEN sharpe_primary > 0 THEN 1 - sharpe_second / sharpe_primary WHEN sharpe_primary IS NOT NULL THEN 'inf'::DOUBLE END AS sharpe_drop FROM (SELECT DISTINCT campaign FROM trials) c LEFT JOIN dsr USING (campaign) LEFT JOIN both_ USING (campaign))
SELECT *, coalesce(sharpe_stressed > 0 AND dsr_n_eff >= {LEAST_DSR!r} AND n_common >= 60 AND sharpe_drop <= 0.3, false) AS passed FROM v""")
def robustness_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Each campaign's portfolio under doubled costs and on a second source (prices net of discounts)."""
    bars, base, trials, p = _built(spark, sf)
    shares = cut(p.shares)

    def again(returns: DataFrame) -> DataFrame:
        return pf.combined(pf.common_points(shares, returns), shares, _month())

    counts = trials.groupBy("campaign").agg(F.count("*").alias("n_raw"), F.count_distinct("cell").alias("n_eff"), F.var_pop("score").alias("var_score"))
    v = gt.robustness_gate(trials, cut(again(_net(bars, 2 * COST))), again(base), again(_net(_bars(spark, sf, NET), COST)), counts, 1, A_YEAR, LEAST_DSR)
    return v.select("campaign", "sharpe_stressed", "n_eff", "n_raw", "dsr_n_eff", "dsr_n_raw", "n_common", "sharpe_primary", "sharpe_second", "sharpe_drop", "passed")
