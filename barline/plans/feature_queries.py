"""Queries on features, predicates, windows and trades."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barline.functions import features as ft
from barline.operators import chunks as ck
from barline.operators import rules as rl
from barline.operators import trades as tr
from barline.registry import Registry
from barline.sources import market as m

R = Registry()
D = f"WITH {m.DAILY_SQL} "
#: Last n rows of a symbol, as SQL.
W = lambda n: f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
SMA = lambda x, n: f"CASE WHEN count({x}) OVER {W(n)} = {n} THEN sum({x}) OVER {W(n)} / {n} END"
STD = lambda x, n: f"CASE WHEN count({x}) OVER {W(n)} = {n} THEN sqrt(greatest({n} * sum({x} * {x}) OVER {W(n)} - (sum({x}) OVER {W(n)}) * (sum({x}) OVER {W(n)}), 0.0)) / {n} END"
LAG = "OVER (PARTITION BY symbol ORDER BY ts)"


def daily(spark: SparkSession, sf: str) -> DataFrame:
    return m.daily_bars(spark, sf)


def daily_features(spark: SparkSession, sf: str, lookback: int, **steps: dict) -> DataFrame:
    """symbol, ts and the columns of the last step of features on daily bars, computed block by block.

    A step is a mapping of names to a function that gives a column; each step sees the columns of those before it.
    """

    def project(d: DataFrame) -> DataFrame:
        for columns in steps.values():
            d = d.withColumns({k: f() for k, f in columns.items()})
        return d.select("symbol", "ts", *columns, "__own")

    return ck.in_blocks(daily(spark, sf), lookback, project)


@R.query(D + f"SELECT symbol, ts, {SMA('close', 10)} AS sma_10, {SMA('close', 50)} AS sma_50, {SMA('volume', 20)} AS volume_20 FROM bars")
def feature_sma(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("close")
    return daily_features(spark, sf, 49, of={"sma_10": lambda: ft.sma(c, 10), "sma_50": lambda: ft.sma(c, 50), "volume_20": lambda: ft.sma(F.col("volume"), 20)})


@R.query(D + f"SELECT symbol, ts, CASE WHEN count(close) OVER {W(20)} = 20 THEN max(close) OVER {W(20)} END AS high_20, CASE WHEN count(close) OVER {W(20)} = 20 THEN min(close) OVER {W(20)} END AS low_20, CASE WHEN count(low) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) = 20 THEN min(low) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END AS donchian_20 FROM bars")
def feature_extremes(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("close")
    return daily_features(spark, sf, 20, of={"high_20": lambda: ft.rolling_max(c, 20), "low_20": lambda: ft.rolling_min(c, 20), "donchian_20": lambda: ft.donchian_low(20)})


@R.query(D + f", f AS (SELECT symbol, ts, close, {SMA('close', 20)} AS mean, {STD('close', 20)} AS dev FROM bars) SELECT symbol, ts, (close - mean) / NULLIF(dev, 0) AS zscore, mean + 2.0 * dev AS upper, mean + -2.0 * dev AS lower, CASE WHEN mean > 0 AND dev > 0 THEN 4 * dev / (mean * sqrt(20.0)) END AS bandwidth FROM f")
def feature_bands(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("close")
    return daily_features(spark, sf, 19, of={"zscore": lambda: ft.zscore(c, 20), "upper": lambda: ft.bollinger(c, 20, 2.0, True), "lower": lambda: ft.bollinger(c, 20, 2.0, False), "bandwidth": lambda: ft.bandwidth(c, 20)})


@R.query(D + f", f AS (SELECT symbol, ts, {SMA('close', 10)} AS m1, {STD('close', 10)} AS d1, {SMA('close', 40)} AS m2, {STD('close', 40)} AS d2, {STD('(high - low)', 20)} AS spread FROM bars) SELECT symbol, ts, CASE WHEN m1 > 0 AND d1 > 0 THEN 4 * d1 / (m1 * sqrt(10.0)) END / CASE WHEN m2 > 0 AND d2 > 0 THEN 4 * d2 / (m2 * sqrt(40.0)) END AS band_ratio, NULLIF(spread, 0) AS spread_std FROM f")
def feature_ratios(spark: SparkSession, sf: str) -> DataFrame:
    return daily_features(spark, sf, 39, of={"band_ratio": lambda: ft.band_ratio(F.col("close"), 10, 40), "spread_std": lambda: ft.spread_std(F.col("high"), F.col("low"), 20)})


FOLD = lambda xs, n, a: f"CASE WHEN len({xs}) >= {n} THEN list_reduce({xs}[{n + 1}:], lambda acc, x: acc + {a} * (x - acc), list_reduce({xs}[1:{n}], lambda acc, x: acc + x, 0.0) / {n}) END"


@R.query(D + f", f AS (SELECT symbol, ts, list(close) OVER {W(64)} AS xs FROM bars) SELECT symbol, ts, {FOLD('xs', 12, 2 / 13)} AS ema_12 FROM f")
def feature_ema(spark: SparkSession, sf: str) -> DataFrame:
    """Exponential mean, restarted in each bar's window of 64 bars."""
    return daily_features(spark, sf, 63, of={"ema_12": lambda: ft.ema(F.col("close"), 12, 64)})


@R.query(D + f", t AS (SELECT symbol, ts, greatest(high - low, abs(high - lag(close) {LAG}), abs(low - lag(close) {LAG})) AS tr FROM bars), f AS (SELECT symbol, ts, list(tr) OVER {W(64)} AS xs FROM t) SELECT symbol, ts, {FOLD('xs', 14, 1 / 14)} AS atr_14 FROM f")
def feature_atr(spark: SparkSession, sf: str) -> DataFrame:
    return daily_features(spark, sf, 64, first={"tr": ft.true_range}, of={"atr_14": lambda: ft.atr_of(ft.window_array(F.col("tr"), 64), 14)})


@R.query(D + f", a AS (SELECT symbol, ts, list(close) OVER {W(64)} AS c FROM bars), d AS (SELECT symbol, ts, [c[i + 1] - c[i] for i in range(1, len(c))] AS d FROM a), g AS (SELECT symbol, ts, [greatest(x, 0.0) for x in d] AS up, [greatest(-x, 0.0) for x in d] AS down FROM d), f AS (SELECT symbol, ts, {FOLD('up', 14, 1 / 14)} AS gain, {FOLD('down', 14, 1 / 14)} AS loss FROM g) SELECT symbol, ts, CASE WHEN loss = 0 THEN 100.0 ELSE 100 - 100 / (1 + gain / loss) END AS rsi_14 FROM f")
def feature_rsi(spark: SparkSession, sf: str) -> DataFrame:
    return daily_features(spark, sf, 63, first={"c": lambda: ft.window_array(F.col("close"), 64)}, of={"rsi_14": lambda: ft.rsi_of(F.col("c"), 14)})


def _seeded_sql(x: str, n: int, alpha: float, place: str = "n.ix") -> str:
    return f"CASE WHEN {place} < {n - 1} THEN go.{x}_v + n.{x} WHEN {place} = {n - 1} THEN (go.{x}_v + n.{x}) / {n} ELSE go.{x}_v + {alpha} * (n.{x} - go.{x}_v) END"


#: One row a symbol and step: each value from the one before it.
FULL_SQL = f"""WITH RECURSIVE {m.DAILY_SQL},
n AS MATERIALIZED (SELECT symbol, ts, close AS ema, greatest(high - low, abs(high - lag(close) {LAG}), abs(low - lag(close) {LAG})) AS atr, coalesce(greatest(close - lag(close) {LAG}, 0.0), 0.0) AS up, coalesce(greatest(lag(close) {LAG} - close, 0.0), 0.0) AS down, row_number() {LAG} - 1 AS ix FROM bars),
go AS (SELECT symbol, ts, ix, ema AS ema_v, atr AS atr_v, 0.0::DOUBLE AS up_v, 0.0::DOUBLE AS down_v FROM n WHERE ix = 0
 UNION ALL SELECT n.symbol, n.ts, n.ix, {_seeded_sql('ema', 12, 2 / 13)}, {_seeded_sql('atr', 14, 1 / 14)}, {_seeded_sql('up', 14, 1 / 14, 'n.ix - 1')}, {_seeded_sql('down', 14, 1 / 14, 'n.ix - 1')} FROM go JOIN n ON n.symbol = go.symbol AND n.ix = go.ix + 1)"""


@R.query(FULL_SQL + " SELECT symbol, ts, CASE WHEN ix >= 13 THEN atr_v END AS atr_14 FROM go")
def feature_atr_full(spark: SparkSession, sf: str) -> DataFrame:
    """Wilder's range over each symbol's whole history, by a prefix scan over blocks."""
    return ck.full_history(daily(spark, sf), atr=(14,))


@R.query(FULL_SQL + " SELECT symbol, ts, CASE WHEN ix >= 11 THEN ema_v END AS ema_12, CASE WHEN ix >= 14 THEN CASE WHEN down_v = 0 THEN 100.0 ELSE 100 - 100 / (1 + up_v / down_v) END END AS rsi_14 FROM go")
def feature_recursive_full(spark: SparkSession, sf: str) -> DataFrame:
    """Exponential mean and Wilder's index over each symbol's whole history, by prefix scans over blocks."""
    return ck.full_history(daily(spark, sf), ema=(12,), rsi=(14,))


@R.query(D + f", f AS (SELECT *, {SMA('close', 5)} AS fast, {SMA('close', 20)} AS slow FROM bars) SELECT symbol, ts, coalesce(lag(fast) {LAG} <= lag(slow) {LAG} AND fast > slow, false) AS up, coalesce(lag(fast) {LAG} >= lag(slow) {LAG} AND fast < slow, false) AS down, lag(close, 3) {LAG} AS ago_3 FROM f")
def predicate_cross(spark: SparkSession, sf: str) -> DataFrame:
    fast, slow = F.col("fast"), F.col("slow")
    return daily_features(spark, sf, 20, first={"fast": lambda: ft.sma(F.col("close"), 5), "slow": lambda: ft.sma(F.col("close"), 20)}, of={"up": lambda: ft.cross_up(fast, slow), "down": lambda: ft.cross_down(fast, slow), "ago_3": lambda: ft.ago(F.col("close"), 3)})


@R.query(D + f", f AS (SELECT symbol, ts, close / NULLIF(lag(close, 5) {LAG}, 0) - 1 AS ret_5, (sign(close - lag(close, 5) {LAG}) + sign(close - lag(close, 20) {LAG}) + sign(close - lag(close, 60) {LAG})) / 3 AS momentum, (2 * close - high - low) / NULLIF(high - low, 0) AS location, CASE WHEN count(close) OVER {W(30)} = 30 THEN (close - min(low) OVER {W(30)}) / NULLIF(max(high) OVER {W(30)} - min(low) OVER {W(30)}, 0) END AS place_30 FROM bars) SELECT * FROM f")
def feature_momentum(spark: SparkSession, sf: str) -> DataFrame:
    c, low, high = F.col("close"), F.col("low_30"), F.col("high_30")
    extremes = {"low_30": lambda: F.min("low").over(ft.last(30)), "high_30": lambda: F.max("high").over(ft.last(30))}
    return daily_features(spark, sf, 60, first=extremes, of={"ret_5": lambda: ft.growth(c, 5), "momentum": lambda: ft.momentum_sign(c, [5, 20, 60]), "location": ft.close_location, "place_30": lambda: ft.full(c, 30, F.try_divide(c - low, F.nullif(high - low, F.lit(0.0))))})


@R.query(D + f", f AS (SELECT symbol, ts, close < {SMA('close', 50)} AS below FROM bars) SELECT ts + INTERVAL 1 DAY AS known_ts, sum(below::BIGINT)::BIGINT AS n_below, count(below) AS n FROM f WHERE below IS NOT NULL GROUP BY ts HAVING count(below) >= 3")
def market_breadth(spark: SparkSession, sf: str) -> DataFrame:
    f = daily(spark, sf).select("ts", (F.col("close") < ft.sma(F.col("close"), 50)).alias("below")).where("below IS NOT NULL")
    return f.groupBy("ts").agg(F.sum(F.col("below").cast("bigint")).alias("n_below"), F.count("below").alias("n")).where("n >= 3").select((F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("known_ts"), "n_below", "n")


@R.query(D + "SELECT symbol, ts, max(close) OVER w AS high_30d, count(*) OVER w AS n_30d, sum(volume) OVER w AS volume_30d FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND CURRENT ROW)")
def window_time_range(spark: SparkSession, sf: str) -> DataFrame:
    w = "OVER (PARTITION BY symbol ORDER BY ts RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND CURRENT ROW)"
    return daily(spark, sf).select("symbol", "ts", F.expr(f"max(close) {w}").alias("high_30d"), F.expr(f"count(*) {w}").alias("n_30d"), F.expr(f"sum(volume) {w}").alias("volume_30d"))


@R.query(D + ", e AS (SELECT *, max(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak FROM bars) SELECT symbol, ts, close - peak AS drawdown, 1 - close / NULLIF(peak, 0) AS drawdown_share, ntile(10) OVER (PARTITION BY symbol ORDER BY close, ts) AS decile, (rank() OVER (PARTITION BY symbol ORDER BY close) - 1)::BIGINT AS place FROM e")
def window_drawdown(spark: SparkSession, sf: str) -> DataFrame:
    d = daily(spark, sf).withColumn("peak", F.max("close").over(ft.running()))
    by_close = Window.partitionBy("symbol").orderBy("close")
    return d.select("symbol", "ts", (F.col("close") - F.col("peak")).alias("drawdown"), (1 - F.try_divide("close", F.nullif(F.col("peak"), F.lit(0.0)))).alias("drawdown_share"), F.ntile(10).over(Window.partitionBy("symbol").orderBy("close", "ts")).cast("bigint").alias("decile"), (F.rank().over(by_close) - 1).cast("bigint").alias("place"))


RULE = rl.Rule((rl.Clause("cross", rl.Feature("sma", 5), True, rl.Feature("sma", 20)), rl.Clause("threshold", rl.Feature("zscore", 20), True, level=-1.0)), stop_period=20)
RULE_SQL = D + f""", f AS (SELECT *, {SMA('close', 5)} AS fast, {SMA('close', 20)} AS slow, {STD('close', 20)} AS dev, row_number() {LAG} - 1 AS bar_ix FROM bars),
s AS (SELECT symbol, ts, bar_ix, close, coalesce(lag(fast) {LAG} <= lag(slow) {LAG} AND fast > slow, false) AND coalesce((close - slow) / NULLIF(dev, 0) > -1.0, false) AS hit, close - (slow + -2.0 * dev) AS distance FROM f),
signals AS (SELECT symbol, ts, bar_ix, close, distance AS stop_distance FROM s WHERE hit AND distance > 0)"""


def rule_signals(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    b = tr.numbered(daily(spark, sf))
    s = b.withColumn("hit", RULE.entry()).withColumn("stop_distance", RULE.stop()).where("hit AND stop_distance IS NOT NULL")
    return b, s.select("symbol", "ts", "bar_ix", "stop_distance")


@R.query(RULE_SQL + " SELECT symbol, ts, bar_ix, stop_distance FROM signals")
def rule_signal_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of one compiled rule with their stop distances."""
    return rule_signals(spark, sf)[1]


TRADES_SQL = RULE_SQL + """, nb AS (SELECT symbol, open, high, low, close, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ix FROM bars),
o AS (SELECT s.symbol, s.bar_ix, s.stop_distance, s.close - s.stop_distance AS stop, s.close + 2.0 * s.stop_distance AS target, n.open AS entry_price FROM signals s JOIN nb n ON s.symbol = n.symbol AND n.ix = s.bar_ix + 1),
p AS (SELECT o.*, n.ix, n.close, CASE WHEN n.low <= o.stop THEN 'stop' WHEN n.high >= o.target THEN 'target' END AS hit, CASE WHEN n.low <= o.stop THEN least(n.open, o.stop) WHEN n.high >= o.target THEN greatest(n.open, o.target) END AS price
  FROM o JOIN nb n ON n.symbol = o.symbol AND n.ix > o.bar_ix AND n.ix <= o.bar_ix + 20),
trades AS (SELECT symbol, bar_ix, entry_price, stop_distance, coalesce(min(ix) FILTER (hit IS NOT NULL), max(ix)) AS exit_ix,
  coalesce(arg_min(price, ix) FILTER (hit IS NOT NULL), arg_max(close, ix)) AS exit_price, coalesce(arg_min(hit, ix) FILTER (hit IS NOT NULL), 'timeout') AS outcome FROM p GROUP BY symbol, bar_ix, entry_price, stop_distance)"""


def rule_trades(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    b, s = rule_signals(spark, sf)
    return b, tr.bracket_trades(b, s.withColumn("target_distance", 2.0 * F.col("stop_distance")), 20)


@R.query(TRADES_SQL + " SELECT symbol, bar_ix, entry_price, exit_ix, exit_price, outcome, (exit_price - entry_price) / stop_distance AS gross_r FROM trades")
def bracket_trades(spark: SparkSession, sf: str) -> DataFrame:
    """Signals of the rule as bracket trades, any number open at once."""
    return rule_trades(spark, sf)[1]


@R.query(TRADES_SQL + " SELECT symbol, outcome, count(*) AS n_trades, sum((exit_price > entry_price)::BIGINT)::BIGINT AS n_wins, sum(exit_ix - bar_ix)::BIGINT AS bars_held, max(exit_price - entry_price) AS best, min(exit_price - entry_price) AS worst FROM trades GROUP BY symbol, outcome")
def trade_metrics(spark: SparkSession, sf: str) -> DataFrame:
    move = F.col("exit_price") - F.col("entry_price")
    return rule_trades(spark, sf)[1].groupBy("symbol", "outcome").agg(F.count("*").alias("n_trades"), F.sum((move > 0).cast("bigint")).alias("n_wins"), F.sum(F.col("exit_ix") - F.col("bar_ix")).alias("bars_held"), F.max(move).alias("best"), F.min(move).alias("worst"))


@R.query(TRADES_SQL + " SELECT n.symbol, n.ix AS bar_ix, count(t.bar_ix) AS n_open FROM nb n LEFT JOIN trades t ON t.symbol = n.symbol AND n.ix > t.bar_ix AND n.ix < t.exit_ix GROUP BY n.symbol, n.ix")
def open_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Open trades at the close of each bar."""
    return tr.open_positions(*rule_trades(spark, sf))


@R.query(D + f", f AS (SELECT *, {SMA('close', 5)} AS m5, {SMA('close', 20)} AS m20, {STD('close', 20)} AS d20 FROM bars), c AS (SELECT symbol, unnest([{{'name': 'above_sma', 'hit': close > m20}}, {{'name': 'fast_above', 'hit': m5 > m20}}, {{'name': 'stretched', 'hit': (close - m20) / NULLIF(d20, 0) > 1.0}}]) AS x FROM f) SELECT symbol, x.name AS clause, sum(coalesce(x.hit, false)::BIGINT)::BIGINT AS n_fired, count(*) AS n_bars FROM c GROUP BY symbol, x.name")
def fire_rates(spark: SparkSession, sf: str) -> DataFrame:
    """How often each clause fires, by symbol."""
    c = F.col("close")
    f = daily(spark, sf).withColumns({"above_sma": c > ft.sma(c, 20), "fast_above": ft.sma(c, 5) > ft.sma(c, 20), "stretched": ft.zscore(c, 20) > 1.0})
    return f.unpivot(["symbol"], ["above_sma", "fast_above", "stretched"], "clause", "hit").groupBy("symbol", "clause").agg(F.sum(F.coalesce("hit", F.lit(False)).cast("bigint")).alias("n_fired"), F.count("*").alias("n_bars"))


@R.query(D + f", g AS (SELECT a.n AS fast, b.n AS slow FROM (VALUES (3), (5), (8)) a(n), (VALUES (20), (30)) b(n)), f AS (SELECT symbol, ts, {', '.join(f'{SMA("close", n)} AS m{n}' for n in (3, 5, 8, 20, 30))} FROM bars), l AS (SELECT g.fast, g.slow, f.symbol, f.ts, CASE g.fast WHEN 3 THEN m3 WHEN 5 THEN m5 ELSE m8 END AS a, CASE g.slow WHEN 20 THEN m20 ELSE m30 END AS b FROM f, g), x AS (SELECT *, coalesce(lag(a) OVER w <= lag(b) OVER w AND a > b, false) AS hit FROM l WINDOW w AS (PARTITION BY fast, slow, symbol ORDER BY ts)) SELECT fast::BIGINT AS fast, slow::BIGINT AS slow, symbol, sum(hit::BIGINT)::BIGINT AS n_entries FROM x GROUP BY ALL")
def grid_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of a parameter grid: each feature is computed once, configurations are expressions on them."""
    c = F.col("close")
    f = daily(spark, sf).select("symbol", "ts", *[ft.sma(c, n).alias(f"m{n}") for n in (3, 5, 8, 20, 30)])
    grid = [(a, b) for a in (3, 5, 8) for b in (20, 30)]
    hits = f.select("symbol", *[ft.cross_up(F.col(f"m{a}"), F.col(f"m{b}")).cast("bigint").alias(f"{a}_{b}") for a, b in grid])
    sums = hits.groupBy("symbol").agg(*[F.sum(f"{a}_{b}").alias(f"{a}_{b}") for a, b in grid])
    return sums.unpivot(["symbol"], [f"{a}_{b}" for a, b in grid], "config", "n_entries").select(F.split("config", "_")[0].cast("bigint").alias("fast"), F.split("config", "_")[1].cast("bigint").alias("slow"), "symbol", "n_entries")


@R.query(D + "SELECT symbol, ts, CASE WHEN volume > 0 THEN (high - low) / volume - 2 * close ** 2 / 1000000.0 END AS score FROM bars")
def score_formula(spark: SparkSession, sf: str) -> DataFrame:
    formula = rl.Formula("(high - low) / volume - 2 * close ** 2 / 1000000.0", ("high", "low", "volume", "close"))
    return daily(spark, sf).select("symbol", "ts", formula.column().alias("score"))


@R.query(D + f", f AS (SELECT symbol, ts, 4 * ({STD('close', 20)}) AS width FROM bars), g AS (SELECT symbol, ts, width, quantile_cont(width, 0.5) OVER {W(60)} AS usual, count(width) OVER {W(60)} AS n FROM f) SELECT symbol, ts, CASE WHEN n >= 20 THEN width / NULLIF(usual, 0) END AS width_ratio FROM g")
def feature_width_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """Band width against its trailing median, which needs a third of its window."""
    d = daily(spark, sf).select("symbol", "ts", (4 * ft.std(F.col("close"), 20)).alias("width"))
    w = ft.last(60)
    return d.select("symbol", "ts", F.when(F.count("width").over(w) >= 20, F.try_divide("width", F.nullif(F.percentile("width", 0.5).over(w), F.lit(0.0)))).alias("width_ratio"))


@R.query(D + f", a AS (SELECT symbol, ts, list(close) OVER {W(64)} AS c FROM bars), d AS (SELECT symbol, ts, [c[i + 1] - c[i] for i in range(1, len(c))] AS d FROM a), g AS (SELECT symbol, ts, len(d) AS n, list_reduce([greatest(x, 0.0) for x in d], lambda v, x: v + {1 / 14} * (x - v), 0.0) AS gain, list_reduce([greatest(-x, 0.0) for x in d], lambda v, x: v + {1 / 14} * (x - v), 0.0) AS loss FROM d) SELECT symbol, ts, CASE WHEN n >= 13 THEN CASE WHEN loss = 0 THEN 100.0 ELSE 100 - 100 / (1 + gain / loss) END END AS rsi_zero FROM g")
def feature_rsi_zero_seeded(spark: SparkSession, sf: str) -> DataFrame:
    d = daily(spark, sf).withColumn("c", ft.window_array(F.col("close"), 64))
    return d.select("symbol", "ts", ft.zero_seeded_rsi(F.col("c"), 14).alias("rsi_zero"))


@R.query(D + f", m AS (SELECT symbol, ts, close - lag(close) {LAG} AS ret FROM bars), a AS (SELECT symbol, ts, list(ret) OVER {W(90)} AS xs FROM m WHERE ret IS NOT NULL), s AS (SELECT symbol, ts, len(xs) AS n, list_reduce([x * x for x in xs], lambda v, x: v * {0.5 ** (1 / 30)} + x, 0.0) AS s, list_reduce([1.0 for x in xs], lambda v, x: v * {0.5 ** (1 / 30)} + x, 0.0) AS w FROM a) SELECT symbol, ts, CASE WHEN n >= 60 THEN sqrt(s / w) END AS deviation FROM s")
def feature_half_life_deviation(spark: SparkSession, sf: str) -> DataFrame:
    d = daily(spark, sf).select("symbol", "ts", (F.col("close") - F.lag("close").over(ft.order())).alias("ret")).where("ret IS NOT NULL")
    return d.select("symbol", "ts", ft.half_life_deviation(ft.window_array(F.col("ret"), 90), 30.0, 60).alias("deviation"))
