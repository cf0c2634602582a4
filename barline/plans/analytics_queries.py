"""Queries on joins, aggregations, statistics, portfolios and replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barline.functions import features as ft
from barline.functions import stats as st
from barline.operators import replay as rp
from barline.plans.feature_queries import SMA, STD, TRADES_SQL, rule_trades
from barline.registry import Registry
from barline.sources import market as m

R = Registry()
D = f"WITH {m.DAILY_SQL} "
#: Whole-unit moves of daily closes: sums of them are exact.
MOVES = D + ", moves AS (SELECT symbol, ts, close - lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS ret FROM bars)"


def moves(spark: SparkSession, sf: str) -> DataFrame:
    return m.daily_bars(spark, sf).select("symbol", "ts", (F.col("close") - F.lag("close").over(ft.order())).alias("ret"))


@R.query(MOVES + """, p AS (SELECT a.symbol AS a, b.symbol AS b, count(*) AS n, sum(a.ret) AS sa, sum(b.ret) AS sb, sum(a.ret * b.ret) AS sab, sum(a.ret * a.ret) AS saa, sum(b.ret * b.ret) AS sbb
FROM moves a JOIN moves b ON a.ts = b.ts AND a.symbol < b.symbol WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY ALL)
SELECT a, b, n, CASE WHEN n >= 30 AND n * saa - sa * sa > 0 AND n * sbb - sb * sb > 0 THEN (n * sab - sa * sb) / sqrt(n * saa - sa * sa) / sqrt(n * sbb - sb * sb) END AS rho FROM p""")
def correlation_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return st.pairwise_correlation(moves(spark, sf).where("ret IS NOT NULL"), "symbol", "ts", "ret")


@R.query(MOVES + """, r AS (SELECT symbol, ts, (rank() OVER (PARTITION BY symbol ORDER BY ret) - 1) * 2 + count(*) OVER (PARTITION BY symbol, ret) - 1 AS place FROM moves WHERE ret IS NOT NULL)
SELECT a.symbol AS a, b.symbol AS b, count(*) AS n, sum(a.place * b.place)::DOUBLE AS dot FROM r a JOIN r b ON a.ts = b.ts AND a.symbol < b.symbol GROUP BY ALL""")
def rank_products(spark: SparkSession, sf: str) -> DataFrame:
    """Doubled average ranks of moves and their products on common days: what a rank correlation is made of."""
    r = moves(spark, sf).where("ret IS NOT NULL")
    place = (F.rank().over(Window.partitionBy("symbol").orderBy("ret")) - 1) * 2 + F.count("*").over(Window.partitionBy("symbol", "ret")) - 1
    r = r.select("symbol", "ts", place.cast("double").alias("place"))
    a, b = r.select(F.col("symbol").alias("a"), "ts", F.col("place").alias("pa")), r.select(F.col("symbol").alias("b"), "ts", F.col("place").alias("pb"))
    return a.join(b, "ts").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), F.sum(F.col("pa") * F.col("pb")).alias("dot"))


@R.query(MOVES + " SELECT ts, count(*) AS n_symbols, max(ret) AS best, min(ret) AS worst FROM moves WHERE ret IS NOT NULL GROUP BY ts HAVING count(*) = (SELECT count(DISTINCT symbol) FROM moves)")
def common_days(spark: SparkSession, sf: str) -> DataFrame:
    """Days on which every series has a return: an inner join of all series in long form."""
    d = moves(spark, sf)
    n = d.agg(F.count_distinct("symbol").alias("m"))
    return d.where("ret IS NOT NULL").groupBy("ts").agg(F.count("*").alias("n_symbols"), F.max("ret").alias("best"), F.min("ret").alias("worst")).crossJoin(F.broadcast(n)).where("n_symbols = m").drop("m")


@R.query(MOVES + " SELECT symbol, year(ts)::BIGINT AS year, count(ret) AS n, sum(ret) AS total, quantile_cont(ret, 0.5) AS median, quantile_cont(ret, 0.75) - quantile_cont(ret, 0.25) AS iqr, sqrt(sum(least(ret, 0) * least(ret, 0)) / count(ret)) AS downside FROM moves WHERE ret IS NOT NULL GROUP BY ALL")
def yearly_returns(spark: SparkSession, sf: str) -> DataFrame:
    low = F.least("ret", F.lit(0.0))
    return moves(spark, sf).where("ret IS NOT NULL").groupBy("symbol", F.year("ts").cast("bigint").alias("year")).agg(F.count("ret").alias("n"), F.sum("ret").alias("total"), F.percentile("ret", 0.5).alias("median"), (F.percentile("ret", 0.75) - F.percentile("ret", 0.25)).alias("iqr"), F.sqrt(F.sum(low * low) / F.count("ret")).alias("downside"))


@R.query(MOVES + """, s AS (SELECT symbol, count(*) AS n, avg(ret) AS mean FROM moves WHERE ret IS NOT NULL GROUP BY symbol),
p AS (SELECT symbol, any_value(n) AS n, any_value(mean) AS mean, avg((ret - mean) ** 2) AS m2, avg((ret - mean) ** 3) AS m3, avg((ret - mean) ** 4) AS m4 FROM moves JOIN s USING (symbol) WHERE ret IS NOT NULL GROUP BY symbol)
SELECT symbol, n, mean / sqrt(m2) AS sharpe, m3 / m2 ** 1.5 * sqrt(n * (n - 1.0)) / (n - 2) AS skew, (n - 1.0) / ((n - 2.0) * (n - 3.0)) * ((n + 1.0) * (m4 / (m2 * m2) - 3) + 6) + 3 AS kurtosis FROM p""")
def sharpe_moments(spark: SparkSession, sf: str) -> DataFrame:
    return st.sharpe_moments(moves(spark, sf).where("ret IS NOT NULL"), ["symbol"])


CONFIGS = [(a, b) for a in (3, 5, 8, 12) for b in (20, 30)]
CONFIG_SQL = D + f""", f AS (SELECT symbol, ts, close, {', '.join(f'{SMA("close", n)} AS m{n}' for n in (3, 5, 8, 12, 20, 30))} FROM bars),
nx AS (SELECT symbol, ts, lead(close) OVER (PARTITION BY symbol ORDER BY ts) - close AS ret, {', '.join(f'm{a} > m{b} AS h{i}' for i, (a, b) in enumerate(CONFIGS))} FROM f),
l AS (SELECT ts, unnest([{', '.join(f"{{'c': {i}, 'x': CASE WHEN h{i} THEN ret ELSE 0 END}}" for i in range(len(CONFIGS)))}]) AS u FROM nx WHERE ret IS NOT NULL),
returns AS (SELECT u.c AS config_id, ts AS obs_ix, sum(u.x) AS ret FROM l GROUP BY ALL)"""


def config_returns(spark: SparkSession, sf: str) -> DataFrame:
    """config_id, obs_ix (day), ret: daily moves while the fast mean is above the slow one, summed over symbols."""
    c = F.col("close")
    d = m.daily_bars(spark, sf)
    means = {n: ft.sma(c, n) for n in (3, 5, 8, 12, 20, 30)}
    r = d.select("ts", (F.lead("close").over(ft.order()) - c).alias("ret"), *[(means[a] > means[b]).alias(f"h{i}") for i, (a, b) in enumerate(CONFIGS)]).where("ret IS NOT NULL")
    held = r.groupBy(F.col("ts").alias("obs_ix")).agg(*[F.sum(F.when(F.col(f"h{i}"), F.col("ret")).otherwise(F.lit(0.0))).alias(str(i)) for i in range(len(CONFIGS))])
    return held.unpivot(["obs_ix"], [str(i) for i in range(len(CONFIGS))], "config", "ret").select(F.col("config").cast("bigint").alias("config_id"), "obs_ix", "ret")


@R.query(CONFIG_SQL + " SELECT config_id::BIGINT AS config_id, count(*) AS n_days, sum(ret) AS total, max(ret) AS best, sum((ret > 0)::BIGINT)::BIGINT AS n_up FROM returns GROUP BY config_id")
def config_totals(spark: SparkSession, sf: str) -> DataFrame:
    return config_returns(spark, sf).groupBy("config_id").agg(F.count("*").alias("n_days"), F.sum("ret").alias("total"), F.max("ret").alias("best"), F.sum((F.col("ret") > 0).cast("bigint")).alias("n_up"))


@R.query(CONFIG_SQL + """, t AS (SELECT obs_ix, ntile(6) OVER (ORDER BY obs_ix) - 1 AS block FROM (SELECT DISTINCT obs_ix FROM returns)),
b AS (SELECT config_id, block, sum(ret) AS s, sum(ret * ret) AS q, count(*) AS k FROM returns JOIN t USING (obs_ix) GROUP BY ALL),
c AS (SELECT a, b, c, row_number() OVER (ORDER BY a, b, c) - 1 AS split FROM range(6) x(a), range(6) y(b), range(6) z(c) WHERE a < b AND b < c),
g AS (SELECT split, config_id, block IN (a, b, c) AS inside, sum(s) AS s, sum(q) AS q, sum(k) AS k FROM b, c GROUP BY ALL),
h AS (SELECT *, CASE WHEN k * q - s * s > 0 THEN s / k / (sqrt(k * q - s * s) / k) ELSE 0 END AS sharpe FROM g),
w AS (SELECT split, config_id, max(sharpe) FILTER (inside) AS fit, max(sharpe) FILTER (NOT inside) AS outside FROM h GROUP BY ALL),
r AS (SELECT *, rank() OVER (PARTITION BY split ORDER BY outside) + (count(*) OVER (PARTITION BY split, outside) - 1) / 2 AS place, count(*) OVER (PARTITION BY split) AS m, row_number() OVER (PARTITION BY split ORDER BY fit DESC, config_id) AS pick FROM w)
SELECT split::BIGINT AS split, config_id::BIGINT AS best, place / (m + 1) AS omega, place / (m + 1) < 0.5 AS overfit FROM r WHERE pick = 1""")
def pbo_splits(spark: SparkSession, sf: str) -> DataFrame:
    """Probability of backtest overfitting, one row a split of six blocks in halves."""
    return st.cscv(config_returns(spark, sf), 6).select(F.col("split").cast("bigint").alias("split"), "best", "omega", "overfit")


@R.query(CONFIG_SQL + """, y AS (SELECT config_id, year(obs_ix)::BIGINT AS year, sum(ret) AS ret FROM returns GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY ret DESC, config_id) AS place FROM y)
SELECT a.year, a.config_id::BIGINT AS config_id, a.ret AS train_ret, b.ret AS test_ret, b.place AS test_place FROM r a JOIN r b ON b.year = a.year + 1 AND b.config_id = a.config_id WHERE a.place <= 2""")
def walk_forward(spark: SparkSession, sf: str) -> DataFrame:
    """The two best configurations of a year and how they did in the next."""
    y = config_returns(spark, sf).groupBy("config_id", F.year("obs_ix").cast("bigint").alias("year")).agg(F.sum("ret").alias("ret"))
    r = y.withColumn("place", F.row_number().over(Window.partitionBy("year").orderBy(F.desc("ret"), "config_id")).cast("bigint"))
    b = r.select((F.col("year") - 1).alias("year"), "config_id", F.col("ret").alias("test_ret"), F.col("place").alias("test_place"))
    return r.where("place <= 2").join(b, ["year", "config_id"]).select("year", "config_id", F.col("ret").alias("train_ret"), "test_ret", "test_place")


@R.query(CONFIG_SQL + f""", g AS (SELECT unnest([{', '.join(f"{{'c': {i}, 'f': {(3, 5, 8, 12).index(a)}, 's': {(20, 30).index(b)}}}" for i, (a, b) in enumerate(CONFIGS))}]) AS u), t AS (SELECT config_id, sum(ret) AS total FROM returns GROUP BY config_id),
p AS (SELECT u.c AS config_id, u.f AS f, u.s AS s, total FROM g JOIN t ON t.config_id = u.c)
SELECT a.config_id::BIGINT AS config_id, count(*) AS n_near, quantile_cont(b.total, 0.5) AS near_median FROM p a JOIN p b ON abs(a.f - b.f) <= 1 AND abs(a.s - b.s) <= 1 GROUP BY a.config_id""")
def grid_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """Each configuration with the median of its neighbours on the grid (and itself).

    Every neighbour lies at one of nine offsets, so the join is an equi-join on exploded places.
    """
    grid = spark.createDataFrame([(i, (3, 5, 8, 12).index(a), (20, 30).index(b)) for i, (a, b) in enumerate(CONFIGS)], "config_id bigint, f int, s int")
    p = grid.join(config_returns(spark, sf).groupBy("config_id").agg(F.sum("ret").alias("total")), "config_id")
    near = p.select("config_id", F.explode(F.expr("flatten(transform(array(-1, 0, 1), i -> transform(array(-1, 0, 1), j -> struct(f + i AS f, s + j AS s))))")).alias("o")).select("config_id", "o.f", "o.s")
    return near.join(p.select("f", "s", "total"), ["f", "s"]).groupBy("config_id").agg(F.count("*").alias("n_near"), F.percentile("total", 0.5).alias("near_median"))


@R.query(TRADES_SQL + """, k AS (SELECT symbol, exit_ix // 21 AS period, exit_price - entry_price AS gain FROM trades), e AS (SELECT symbol, period, sum(gain) AS gain FROM k GROUP BY ALL),
c AS (SELECT *, sum(gain) OVER (PARTITION BY symbol ORDER BY period) AS equity FROM e), d AS (SELECT *, max(equity) OVER (PARTITION BY symbol ORDER BY period) AS peak FROM c)
SELECT symbol, count(*) AS n_periods, sum(gain) AS total, max(greatest(peak, 0) - equity) AS worst_drawdown, sum((gain > 0)::BIGINT)::BIGINT AS n_up FROM d GROUP BY symbol""")
def trade_periods(spark: SparkSession, sf: str) -> DataFrame:
    """Gains by 21-bar period, their running sum and its worst fall."""
    t = rule_trades(spark, sf)[1]
    e = t.groupBy("symbol", F.floor(F.col("exit_ix") / 21).alias("period")).agg(F.sum(F.col("exit_price") - F.col("entry_price")).alias("gain"))
    w = Window.partitionBy("symbol").orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    d = e.withColumn("equity", F.sum("gain").over(w)).withColumn("peak", F.max("equity").over(w))
    return d.groupBy("symbol").agg(F.count("*").alias("n_periods"), F.sum("gain").alias("total"), F.max(F.greatest("peak", F.lit(0.0)) - F.col("equity")).alias("worst_drawdown"), F.sum((F.col("gain") > 0).cast("bigint")).alias("n_up"))


@R.query(TRADES_SQL + ", g AS (SELECT symbol, count(*) AS n, sum((outcome = 'target')::BIGINT)::BIGINT AS hits FROM trades GROUP BY symbol) SELECT symbol, n, hits, (hits / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(hits / n * (1 - hits / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n) AS wilson FROM g")
def win_rate_bound(spark: SparkSession, sf: str) -> DataFrame:
    g = rule_trades(spark, sf)[1].groupBy("symbol").agg(F.count("*").alias("n"), F.sum((F.col("outcome") == "target").cast("bigint")).alias("hits"))
    return g.withColumn("wilson", st.wilson_lower(F.col("hits"), F.col("n")))


@R.query(MOVES + f""", v AS (SELECT symbol, ts, ret, {STD('ret', 60)} AS dev FROM moves WHERE ret IS NOT NULL), x AS (SELECT symbol, ts, ret, lag(dev) OVER (PARTITION BY symbol ORDER BY ts) AS dev, date_trunc('month', ts)::TIMESTAMP AS month FROM v),
f AS (SELECT symbol, month, first(dev ORDER BY ts) AS dev FROM x GROUP BY ALL)
SELECT month, count(dev) AS n_active, max(dev) AS widest, arg_min(symbol, dev) AS calmest FROM f WHERE dev > 0 GROUP BY month""")
def volatility_allocation(spark: SparkSession, sf: str) -> DataFrame:
    """At each month's first bar, deviations known the bar before: what inverse-volatility weights rest on."""
    v = moves(spark, sf).where("ret IS NOT NULL").withColumn("dev", ft.std(F.col("ret"), 60))
    x = v.select("symbol", "ts", F.lag("dev").over(ft.order()).alias("dev"), F.date_trunc("month", "ts").cast("timestamp_ntz").alias("month"))
    f = x.groupBy("symbol", "month").agg(F.min_by("dev", "ts").alias("dev")).where("dev > 0")
    return f.groupBy("month").agg(F.count("dev").alias("n_active"), F.max("dev").alias("widest"), F.min_by("symbol", "dev").alias("calmest"))


@R.query("""WITH e AS (SELECT user_id, event_type, ts, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, ts) AS best, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS latest FROM e)
SELECT user_id, max(event_type) FILTER (latest = 1) AS latest_type, max(event_type) FILTER (best = 1) AS best_type, count(*) AS n, count(DISTINCT event_type) AS n_types, sum(k)::BIGINT AS sum_k FROM r GROUP BY user_id""")
def latest_and_best(spark: SparkSession, sf: str) -> DataFrame:
    """Last and best row of each key with ties settled, and a value out of JSON."""
    e = m.read(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    return e.groupBy("user_id").agg(F.max_by("event_type", "ts").alias("latest_type"), F.max_by("event_type", F.struct(F.col("value"), -F.unix_micros(F.col("ts").cast("timestamp")))).alias("best_type"), F.count("*").alias("n"), F.count_distinct("event_type").alias("n_types"), F.sum("k").alias("sum_k"))


@R.query(MOVES + ", y AS (SELECT symbol, year(ts)::BIGINT AS year, sum(ret) AS total FROM moves WHERE ret IS NOT NULL GROUP BY ALL) SELECT year, sum(total) FILTER (symbol LIKE 'A%') AS a, sum(total) FILTER (symbol LIKE 'N%') AS n, sum(total) FILTER (symbol LIKE 'R%') AS r FROM y GROUP BY year")
def yearly_pivot(spark: SparkSession, sf: str) -> DataFrame:
    y = moves(spark, sf).where("ret IS NOT NULL").withColumn("flag", F.lower(F.substring("symbol", 1, 1))).groupBy(F.year("ts").cast("bigint").alias("year"))
    return y.pivot("flag", ["a", "n", "r"]).agg(F.sum("ret"))


#: One step of an account for each bar; the same rules as the replay, bar by bar.
REPLAY_RULES = rp.Account(hold=20, lot=0.001)
_L = lambda x: f"CASE WHEN {x} > 0 THEN floor(({x}) / {REPLAY_RULES.lot} + 1e-9) * {REPLAY_RULES.lot} ELSE 0.0 END"
REPLAY_SQL = D.replace("WITH", "WITH RECURSIVE", 1) + f""", w AS (SELECT symbol, ts, open, high, low, close, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ix, count(*) OVER (PARTITION BY symbol) AS n, 2 * ({STD('close', 20)}) AS d, {', '.join(f"{SMA('close', k)} AS m{k}" for k in sorted({x for c in CONFIGS for x in c}))} FROM bars),
x AS (SELECT *, {', '.join(f"coalesce(lag(m{a}) OVER (PARTITION BY symbol ORDER BY ts) <= lag(m{b}) OVER (PARTITION BY symbol ORDER BY ts) AND m{a} > m{b}, false) AND coalesce(d > 0, false) AS hit{i}" for i, (a, b) in enumerate(CONFIGS))} FROM w),
s AS (SELECT symbol, ix, n, open, high, low, close, d, unnest([{', '.join(f"{{'config_id': {i}::BIGINT, 'hit': hit{i}}}" for i in range(len(CONFIGS)))}], recursive := true) FROM x),
go AS (
 SELECT symbol, config_id, -1::BIGINT AS ix, {REPLAY_RULES.cash}::DOUBLE AS cash, 0.0::DOUBLE AS qty, 0.0::DOUBLE AS stop, 0.0::DOUBLE AS target, 0::BIGINT AS opened, 0.0::DOUBLE AS paid, NULL::DOUBLE AS p_stop, NULL::DOUBLE AS p_target, false AS p_timeout, 0::BIGINT AS denied, 0::BIGINT AS ambiguous, {REPLAY_RULES.cash}::DOUBLE AS equity, 0.0::DOUBLE AS turned, NULL::VARCHAR AS outcome, NULL::DOUBLE AS price, 0.0::DOUBLE AS sold, 0::BIGINT AS entry_ix, 0.0::DOUBLE AS entry_price FROM (SELECT DISTINCT symbol, config_id FROM s)
 UNION ALL
 SELECT symbol, config_id, ix, cash4, qty4, stop3, target3, opened3, paid3,
   CASE WHEN qty4 = 0 AND hit AND ix + 1 < n THEN close - d END, CASE WHEN qty4 = 0 AND hit AND ix + 1 < n THEN close + 2 * d END, qty4 > 0 AND ix - opened3 + 1 >= {REPLAY_RULES.hold} AND ix + 1 < n,
   denied3, ambiguous4, cash4 + qty4 * close, turned4, coalesce(outcome4, outcome2), coalesce(price4, price2), CASE WHEN outcome4 IS NOT NULL THEN qty3 ELSE sold2 END, CASE WHEN outcome4 IS NOT NULL THEN opened3 ELSE opened2 END, CASE WHEN outcome4 IS NOT NULL THEN paid3 ELSE paid2 END
 FROM (SELECT *, CASE WHEN qty3 > 0 AND low <= stop3 THEN 'stop' WHEN qty3 > 0 AND high > target3 THEN 'target' END AS outcome4, CASE WHEN qty3 > 0 AND low <= stop3 THEN least(stop3, open) WHEN qty3 > 0 AND high > target3 THEN target3 END AS price4,
   cash3 + coalesce(qty3 * price4 * (1 - {REPLAY_RULES.fee}), 0) AS cash4, CASE WHEN outcome4 IS NULL THEN qty3 ELSE 0.0 END AS qty4, ambiguous + (qty3 > 0 AND low <= stop3 AND high > target3)::BIGINT AS ambiguous4, turned3 + coalesce(qty3 * price4, 0) AS turned4
  FROM (SELECT *, coalesce(p_stop > 0 AND p_stop < open AND open < p_target AND qty2 = 0, false) AS fits, CASE WHEN fits THEN least({_L(f'equity * {REPLAY_RULES.risk} / (open - p_stop)')}, {_L(f'cash2 / (open * (1 + {REPLAY_RULES.fee}))')}) ELSE 0.0 END AS bought,
    CASE WHEN bought > 0 THEN bought ELSE qty2 END AS qty3, CASE WHEN bought > 0 THEN cash2 - bought * open * (1 + {REPLAY_RULES.fee}) ELSE cash2 END AS cash3, CASE WHEN bought > 0 THEN p_stop ELSE stop END AS stop3, CASE WHEN bought > 0 THEN p_target ELSE target END AS target3, CASE WHEN bought > 0 THEN ix ELSE opened END AS opened3, CASE WHEN bought > 0 THEN open ELSE paid END AS paid3, denied + (p_stop IS NOT NULL AND qty2 = 0 AND NOT bought > 0)::BIGINT AS denied3, turned2 + bought * open AS turned3
   FROM (SELECT g.*, s.open, s.high, s.low, s.close, s.d, s.hit, s.n, s.ix AS ix_now, CASE WHEN g.p_timeout THEN g.cash + g.qty * s.open * (1 - {REPLAY_RULES.fee}) ELSE g.cash END AS cash2, CASE WHEN g.p_timeout THEN 0.0 ELSE g.qty END AS qty2, CASE WHEN g.p_timeout THEN 'timeout' END AS outcome2, CASE WHEN g.p_timeout THEN s.open END AS price2, g.qty AS sold2, g.opened AS opened2, g.paid AS paid2, g.turned + CASE WHEN g.p_timeout THEN g.qty * s.open ELSE 0.0 END AS turned2
    FROM (SELECT * EXCLUDE (ix, outcome, price, sold, entry_ix, entry_price), ix + 1 AS ix FROM go) g JOIN s ON s.symbol = g.symbol AND s.config_id = g.config_id AND s.ix = g.ix))))"""


def replayable(spark: SparkSession, sf: str) -> DataFrame:
    """Daily bars with a stop distance and the mean-crossing configurations that fire."""
    c = F.col("close")
    fired = F.array(*[F.when(ft.cross_up(ft.sma(c, a), ft.sma(c, b)), F.lit(i)) for i, (a, b) in enumerate(CONFIGS)])
    return m.daily_bars(spark, sf).select("symbol", "ts", "open", "high", "low", "close", (2 * ft.std(c, 20)).alias("stop_distance"), F.array_compact(fired).alias("fired"))


@R.query(REPLAY_SQL + """, k AS (SELECT *, max(equity) OVER (PARTITION BY symbol, config_id ORDER BY ix) AS peak, equity / lag(equity) OVER (PARTITION BY symbol, config_id ORDER BY ix) - 1 AS r FROM go WHERE ix >= 0)
SELECT symbol, config_id, count(outcome) AS n_trades, count(*) FILTER (outcome = 'stop') AS n_stops, count(*) FILTER (outcome = 'target') AS n_targets, count(*) FILTER (outcome = 'timeout') AS n_timeouts, max(denied) AS n_denied, max(ambiguous) AS n_ambiguous,
  coalesce(sum(ix - entry_ix + (outcome <> 'timeout')::BIGINT) FILTER (outcome IS NOT NULL), 0)::BIGINT AS bars_held, arg_max(equity, ix) AS final_equity, max(1 - equity / peak) AS max_drawdown, arg_max(turned, ix) AS turned, avg(equity) AS mean_equity,
  coalesce(avg(r) / NULLIF(stddev_samp(r), 0) * sqrt(365.0), 0) AS sharpe, coalesce(avg(r) / NULLIF(sqrt(avg(least(r, 0) * least(r, 0)) FILTER (r IS NOT NULL)), 0) * sqrt(365.0), 0) AS sortino FROM k GROUP BY symbol, config_id""")
def replay_grid(spark: SparkSession, sf: str) -> DataFrame:
    """A grid of mean-crossing rules replayed as accounts of one position each."""
    return rp.replay_grid(replayable(spark, sf), len(CONFIGS), REPLAY_RULES)


@R.query(REPLAY_SQL + " SELECT symbol, config_id, entry_ix, ix AS exit_ix, entry_price, price AS exit_price, sold AS quantity, outcome FROM go WHERE outcome IS NOT NULL")
def replay_trades(spark: SparkSession, sf: str) -> DataFrame:
    """The same accounts, trade by trade."""
    return rp.replay_trades(replayable(spark, sf), len(CONFIGS), REPLAY_RULES)
