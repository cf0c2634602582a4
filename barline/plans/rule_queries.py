"""Queries on the rule grammar: every clause, both directions, stops and targets by bands and ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.operators.rules import LOOKBACK, Clause, Feature, Rule, with_ranges
from barline.plans.feature_queries import SMA, STD, W
from barline.registry import Registry
from barline.sources import market as m

R = Registry()
LAG = "OVER (PARTITION BY symbol ORDER BY ts)"


def _smoothed(values: str, n: int, alpha: float) -> str:
    return f"CASE WHEN len({values}) >= {n} THEN list_reduce({values}[{n + 1}:], lambda v, x: v + {alpha} * (x - v), list_reduce({values}[1:{n}], lambda v, x: v + x, 0.0) / {n}) END"


_BAND = lambda n: f"CASE WHEN ({SMA('close', n)}) > 0 AND ({STD('close', n)}) > 0 THEN 4 * ({STD('close', n)}) / (({SMA('close', n)}) * sqrt({float(n)})) END"
#: Every feature that the rules below look at, in steps.
FEATURES = f"""WITH {m.DAILY_SQL}, f0 AS (SELECT *, greatest(high - low, abs(high - lag(close) {LAG}), abs(low - lag(close) {LAG})) AS range, lag(close) {LAG} AS before, list(close) OVER {W(LOOKBACK)} AS closes FROM bars),
f1 AS (SELECT *, list(range) OVER {W(LOOKBACK)} AS ranges, close - before AS step, [closes[i + 1] - closes[i] for i in range(1, len(closes))] AS moves FROM f0),
f2 AS (SELECT *, {_smoothed('ranges', 14, 1 / 14)} AS atr14, {_smoothed('ranges', 5, 1 / 5)} AS atr5, {_smoothed('ranges', 20, 1 / 20)} AS atr20, {_smoothed('closes', 10, 2 / 11)} AS ema10, {SMA('close', 5)} AS sma5, {SMA('close', 20)} AS sma20, {SMA('close', 20)} + 2.0 * ({STD('close', 20)}) AS up20, {SMA('close', 20)} + -2.0 * ({STD('close', 20)}) AS low20,
 {_BAND(5)} AS bw5, {_BAND(20)} AS bw20, CASE WHEN count(close) OVER {W(10)} = 10 THEN max(close) OVER {W(10)} END AS max10, (close - ({SMA('close', 20)})) / NULLIF({STD('close', 20)}, 0) AS z20, {_smoothed('[greatest(x, 0.0) for x in moves]', 7, 1 / 7)} AS gain, {_smoothed('[greatest(-x, 0.0) for x in moves]', 7, 1 / 7)} AS loss FROM f1),
f3 AS (SELECT *, CASE WHEN loss = 0 THEN 100.0 ELSE 100 - 100 / (1 + gain / loss) END AS rsi7, close - sma20 AS gap20 FROM f2), f4 AS (SELECT *, NULLIF({STD('gap20', 20)}, 0) AS spread20 FROM f3)"""

#: Rules with what their entry, stop and target are in SQL; a prior value is a lag.
_L = lambda x: f"lag({x}) {LAG}"
RULES = {
    "distance_atr": (Rule((Clause("distance", Feature("close"), True, Feature("sma", 20), 0.5),), stop_kind="atr", stop_period=20, take_profit=2.0), "(close - sma20) / NULLIF(atr14, 0) > 0.5", "1.0 * atr20", "2.0 * atr20"),
    "distance_spread": (Rule((Clause("distance", Feature("close"), False, Feature("sma", 20), -1.0, "spread"),), stop_multiple=1.5, take_profit=3.0, target_kind="atr"), "(close - sma20) / spread20 < -1.0", "1.5 * (close - low20)", "3.0 * atr14"),
    "breakout_ratio": (Rule((Clause("breakout", Feature("max", 10), True), Clause("threshold", Feature("atr_ratio", 5, 20), False, None, 1.5)), stop_kind="atr", stop_period=14), f"close > {_L('max10')} AND atr5 / NULLIF(atr20, 0) < 1.5", "1.0 * atr14", "NULL::DOUBLE"),
    "short_cross": (Rule((Clause("cross", Feature("close"), False, Feature("ema", 10)), Clause("slope", Feature("sma", 5), False)), "and", 20, 1.0, 1.5, "short"), f"{_L('close')} >= {_L('ema10')} AND close < ema10 AND sma5 < {_L('sma5')}", "1.0 * (up20 - close)", "1.5 * (1.0 * (up20 - close))"),
    "either_level": (Rule((Clause("cross_level", Feature("rsi", 7), True, None, 50.0), Clause("threshold", Feature("band_ratio", 5, 20), True, None, 2.5)), "or", stop_kind="atr", stop_period=5, take_profit=1.0), f"coalesce({_L('rsi7')} <= 50.0 AND rsi7 > 50.0, false) OR coalesce(bw5 / bw20 > 2.5, false)", "1.0 * atr5", "1.0 * (1.0 * atr5)"),
    "compare_zscore": (Rule((Clause("compare", Feature("sma", 5), True, Feature("sma", 20)), Clause("threshold", Feature("zscore", 20), False, None, 1.0)), stop_kind="atr", stop_period=14, take_profit=2.0, target_kind="atr"), "sma5 > sma20 AND z20 < 1.0", "1.0 * atr14", "2.0 * atr14"),
}


def _sql(name: str) -> str:
    rule, entry, stop, target = RULES[name]
    return f"{FEATURES}, s AS (SELECT symbol, ts, '{rule.direction}' AS direction, 1.0::DOUBLE AS strength, {stop} AS stop_distance, {target} AS take_profit, coalesce({entry}, false) AND coalesce(atr14 > 0, false) AS hit FROM f4) SELECT symbol, ts, direction, strength, stop_distance, take_profit FROM s WHERE hit AND stop_distance > 0"


def _register(name: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return Rule.from_json(RULES[name][0].to_json()).signals(m.daily_bars(spark, sf))

    run.__name__ = f"rule_{name}"
    run.__doc__ = f"Signals of the rule {name}, read back from its text."
    R.query(_sql(name))(run)


for _name in RULES:
    _register(_name)


@R.query(f"{FEATURES}, c AS (SELECT symbol, unnest([" + ", ".join(f"{{'rule': '{k}', 'hit': coalesce({v[1].replace(LAG, '')}, false)}}" if "lag(" not in v[1] else f"{{'rule': '{k}', 'hit': h_{k}}}" for k, v in RULES.items()) + "], recursive := true) FROM (SELECT *, " + ", ".join(f"coalesce({v[1]}, false) AS h_{k}" for k, v in RULES.items() if "lag(" in v[1]) + " FROM f4)) SELECT symbol, rule, count(*) FILTER (hit) AS n_fired, count(*) FILTER (hit) / count(*) AS rate, count(*) FILTER (hit) = 0 OR count(*) FILTER (hit) / count(*) > 0.95 AS degenerate FROM c GROUP BY symbol, rule")
def rule_fire_rates(spark: SparkSession, sf: str) -> DataFrame:
    """All rules over one pass of the bars, which computes what they share once."""
    d = with_ranges(m.daily_bars(spark, sf)).select("symbol", *[v[0].entry().alias(k) for k, v in RULES.items()])
    rate = F.count_if("hit") / F.count("*")
    g = d.unpivot(["symbol"], list(RULES), "rule", "hit").groupBy("symbol", "rule").agg(F.count_if("hit").alias("n_fired"), rate.alias("rate"))
    return g.withColumn("degenerate", (F.col("n_fired") == 0) | (F.col("rate") > 0.95))
