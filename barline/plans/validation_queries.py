"""Queries on validation, nulls, gates, portfolios and trade metrics."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barline.functions import features as ft
from barline.functions import stats as st
from barline.functions import validation as va
from barline.operators import leaks as lk
from barline.operators import strategies as so
from barline.plans.analytics_queries import CONFIG_SQL, config_returns
from barline.plans.research_queries import GROWTH, growth
from barline.plans.feature_queries import SMA, STD, W
from barline.plans.strategy_queries import SETUPS, setup_sql
from barline.registry import Registry
from barline.sources import market as m

R = Registry()
D = f"WITH {m.DAILY_SQL} "
LAG = "OVER (PARTITION BY symbol ORDER BY ts)"

_GROUPS, _TESTED = 6, 2
_CHOICES = list(itertools.combinations(range(1, _GROUPS + 1), _TESTED))
_SPLITS = ", ".join(f"({s}, {g}, {g in c}, {g + 1 in c}, {g - 1 in c})" for s, c in enumerate(_CHOICES) for g in range(1, _GROUPS + 1))
_PATHS = ", ".join(f"({s}, {g}, {sum(g in c for c in _CHOICES[:s])})" for s, c0 in enumerate(_CHOICES) for g in c0)
PATHS = CONFIG_SQL + f""", ax AS (SELECT obs_ix, ntile({_GROUPS}) OVER (ORDER BY obs_ix) AS tile, row_number() OVER (ORDER BY obs_ix) - 1 AS at_ix, count(*) OVER () AS total FROM (SELECT DISTINCT obs_ix FROM returns)),
pl AS (SELECT obs_ix, tile, max(at_ix) OVER (PARTITION BY tile) - at_ix < 1 AS reaches, at_ix - min(at_ix) OVER (PARTITION BY tile) < floor(total * 0.01) AS waits FROM ax),
sp(split, tile, test, before, behind) AS (VALUES {_SPLITS}), pa(split, tile, path) AS (VALUES {_PATHS}),
rw AS (SELECT s.split, s.test, s.before, s.behind, p.tile, p.reaches, p.waits, r.config_id, r.ret FROM returns r JOIN pl p USING (obs_ix) JOIN sp s USING (tile)),
sc AS (SELECT split, config_id, CASE WHEN stddev_samp(ret) > 0 THEN avg(ret) / stddev_samp(ret) ELSE 0.0 END AS score FROM rw WHERE NOT test AND NOT (before AND reaches) AND NOT (behind AND waits) GROUP BY split, config_id),
bs AS (SELECT split, arg_max(config_id, (score, -config_id)) AS config_id FROM sc GROUP BY split),
paths AS (SELECT path::BIGINT AS path, count(*) AS n, CASE WHEN stddev_samp(ret) > 0 THEN avg(ret) / stddev_samp(ret) ELSE 0.0 END AS sharpe FROM rw JOIN bs USING (split, config_id) JOIN pa USING (split, tile) WHERE test GROUP BY path)"""


@R.query(PATHS + " SELECT path, n, sharpe FROM paths")
def out_of_sample_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Paths of combinatorial purged cross-validation."""
    return va.cross_validation_paths(config_returns(spark, sf))


@R.query(PATHS + " SELECT quantile_cont(sharpe, 0.5) AS median, count(*) FILTER (sharpe < 0) / count(*) AS negative_share, min(sharpe) AS worst, count(*) AS n_paths FROM paths")
def path_summary_statistics(spark: SparkSession, sf: str) -> DataFrame:
    p = va.cross_validation_paths(config_returns(spark, sf))
    return p.agg(F.percentile("sharpe", F.lit(0.5)).alias("median"), (F.count_if(F.col("sharpe") < 0) / F.count("*")).alias("negative_share"), F.min("sharpe").alias("worst"), F.count("*").alias("n_paths"))


@R.query(CONFIG_SQL + """, y AS (SELECT config_id, year(obs_ix)::BIGINT AS step, sum(ret) AS ret FROM returns GROUP BY ALL), p AS (SELECT step, max(ret) AS in_sample, median(ret) AS out_of_sample FROM y GROUP BY step), g AS (SELECT count(*) AS n, regr_slope(in_sample, step) AS in_slope, regr_slope(out_of_sample, step) AS out_slope FROM p)
SELECT n, in_slope, out_slope, coalesce(n >= 3 AND in_slope > 1e-9 AND out_slope <= 1e-9, false) AS diverging FROM g""")
def divergence(spark: SparkSession, sf: str) -> DataFrame:
    """Slopes of the record and of the median over the years."""
    y = config_returns(spark, sf).groupBy("config_id", F.year("obs_ix").cast("bigint").alias("step")).agg(F.sum("ret").alias("ret"))
    return va.diverging(y.groupBy("step").agg(F.max("ret").alias("in_sample"), F.percentile("ret", F.lit(0.5)).alias("out_of_sample")))


MEMBERS = f"WITH {m.HOURLY_SQL}, growth AS (SELECT * FROM (SELECT symbol, ts, close / NULLIF(lag(close) {LAG}, 0) - 1 AS ret FROM hours) WHERE ret IS NOT NULL)" + """, days AS (SELECT ts FROM growth GROUP BY ts HAVING count(*) = (SELECT count(DISTINCT symbol) FROM growth)), mem AS (SELECT symbol AS member, ts, ret * 0.1 AS ret, epoch(ts)::BIGINT // 86400 AS period FROM growth JOIN days USING (ts)),
inv AS (SELECT member, 1 / stddev_samp(ret) AS inverse FROM mem GROUP BY member), weights AS (SELECT member, inverse / (SELECT sum(inverse) FROM inv) AS weight FROM inv),
held AS (SELECT ts, weight * product(1 + ret) OVER (PARTITION BY member, period ORDER BY ts ROWS UNBOUNDED PRECEDING) AS after, weight * coalesce(product(1 + ret) OVER (PARTITION BY member, period ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1.0) AS before FROM mem JOIN weights USING (member))"""


def day() -> Column:
    """The number of a bar's day: the period of rebalancing."""
    return F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 86_400)


def members(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly returns of each series (a tenth of them, so that holdings stay positive) at the times that all have."""
    g = m.hourly_bars(spark, sf).select("symbol", "ts", ft.growth(F.col("close")).alias("ret")).where("ret IS NOT NULL")
    n = g.agg(F.count_distinct("symbol").alias("m"))
    days = g.groupBy("ts").agg(F.count("*").alias("k")).crossJoin(F.broadcast(n)).where("k = m").select("ts")
    return g.join(days, "ts", "left_semi").select(F.col("symbol").alias("member"), "ts", (F.col("ret") * 0.1).alias("ret"))


@R.query(MEMBERS + " SELECT member, weight FROM weights")
def risk_parity_weights(spark: SparkSession, sf: str) -> DataFrame:
    return va.inverse_volatility(members(spark, sf))


@R.query(MEMBERS + " SELECT ts, sum(after) / sum(before) - 1 AS ret FROM held GROUP BY ts")
def rebalanced_portfolio(spark: SparkSession, sf: str) -> DataFrame:
    """Daily rebalanced inverse-volatility portfolio with drifting holdings."""
    r = members(spark, sf)
    return va.rebalanced(r, va.inverse_volatility(r), day())


@R.query(MEMBERS + ", p AS (SELECT ts, sum(after) / sum(before) - 1 AS ret FROM held GROUP BY ts), k AS (SELECT ts, ret, epoch(ts)::BIGINT // 86400 AS period FROM p) SELECT ts, period IS DISTINCT FROM lag(period) OVER (ORDER BY ts) AS starts, sum((ret > 0)::BIGINT) OVER (PARTITION BY period ORDER BY ts ROWS UNBOUNDED PRECEDING)::BIGINT AS ups FROM k")
def rebalance_days(spark: SparkSession, sf: str) -> DataFrame:
    """Where a period changes, and days of gain since."""
    r = members(spark, sf)
    p = va.rebalanced(r, va.inverse_volatility(r), day()).withColumn("period", day())
    return p.select("ts", (~F.col("period").eqNullSafe(F.lag("period").over(Window.orderBy("ts")))).alias("starts"), F.sum((F.col("ret") > 0).cast("bigint")).over(Window.partitionBy("period").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)).alias("ups"))


@R.query("""WITH s AS (SELECT o_orderkey AS trial, o_orderpriority AS instrument, o_orderstatus AS direction, o_totalprice AS score, o_custkey % 200 AS cell FROM orders), e AS (SELECT * FROM s WHERE score > 1000), b AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY instrument, direction ORDER BY score DESC, trial) = 1)
SELECT instrument, direction, trial, score, row_number() OVER (ORDER BY score DESC, trial) AS place FROM b""")
def slot_winners(spark: SparkSession, sf: str) -> DataFrame:
    """The best eligible trial of each slot; a slot without one stays empty."""
    s = m.read(spark, sf, "orders").select(F.col("o_orderkey").alias("trial"), F.col("o_orderpriority").alias("instrument"), F.col("o_orderstatus").alias("direction"), F.col("o_totalprice").alias("score")).where("score > 1000")
    order = [F.desc("score"), "trial"]
    b = s.withColumn("n", F.row_number().over(Window.partitionBy("instrument", "direction").orderBy(*order))).where("n = 1")
    return b.select("instrument", "direction", "trial", "score", F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("place"))


@R.query("""WITH q AS (SELECT o_orderdate AS ts, o_orderpriority AS instrument, o_orderkey AS id, CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE o_totalprice END AS stop_distance, (year(o_orderdate) * 12 + month(o_orderdate)) % 3 AS held FROM orders),
p AS (SELECT *, sum((stop_distance IS NOT NULL)::INT) OVER (PARTITION BY ts ORDER BY instrument, id ROWS UNBOUNDED PRECEDING) AS place FROM q)
SELECT ts, id, CASE WHEN stop_distance IS NULL THEN 'no_stop_distance' WHEN held * 1000.0 + place * (100000.0 * 0.01) > 100000.0 * 0.04 THEN 'portfolio_risk_cap' END AS reason, stop_distance IS NOT NULL AND NOT held * 1000.0 + place * (100000.0 * 0.01) > 100000.0 * 0.04 AS admitted FROM p""")
def batch_admission(spark: SparkSession, sf: str) -> DataFrame:
    """Requests of one time against one equity and what is already open, with the reasons of refusals."""
    q = m.read(spark, sf, "orders").select(F.col("o_orderdate").alias("ts"), F.col("o_orderpriority").alias("instrument"), F.col("o_orderkey").alias("id"), F.when(F.col("o_custkey") % 10 != 0, F.col("o_totalprice")).alias("stop_distance"), ((F.year("o_orderdate") * 12 + F.month("o_orderdate")) % 3).alias("held"))
    return va.admitted(q, "ts", ["instrument", "id"], F.lit(100000.0), 0.01, 0.04, F.col("held") * 1000.0).select("ts", "id", "reason", "admitted")


@R.query("""WITH f AS (SELECT l_suppkey AS account, l_partkey % 5 AS instrument, l_shipdate AS ts, l_orderkey, l_linenumber, l_partkey, l_extendedprice, CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS signed, floor(l_extendedprice) AS paid FROM lineitem),
r AS (SELECT *, sum(signed) OVER w AS position, row_number() OVER w AS n FROM f WINDOW w AS (PARTITION BY account, instrument ORDER BY ts, l_orderkey, l_linenumber, l_partkey, l_extendedprice ROWS UNBOUNDED PRECEDING)),
i AS (SELECT *, coalesce(sum((position = 0)::INT) OVER (PARTITION BY account, instrument ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS trip FROM r)
SELECT account, instrument, trip::BIGINT AS trip, count(*) AS n_fills, min(ts) AS opened, max(ts) AS closed, sum(CASE WHEN signed > 0 THEN -paid ELSE paid END) AS gain, bool_or(position = 0) AS flat FROM i GROUP BY ALL""")
def round_trips(spark: SparkSession, sf: str) -> DataFrame:
    """Excursions from flat to flat of each position, as islands between zeros."""
    f = m.read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("account"), (F.col("l_partkey") % 5).alias("instrument"), F.col("l_shipdate").alias("ts"), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("signed"), F.floor("l_extendedprice").cast("double").alias("paid"))
    w = Window.partitionBy("account", "instrument").orderBy("ts", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    r = f.withColumn("position", F.sum("signed").over(run))
    i = r.withColumn("trip", F.coalesce(F.sum((F.col("position") == 0).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint"))
    return i.groupBy("account", "instrument", "trip").agg(F.count("*").alias("n_fills"), F.min("ts").alias("opened"), F.max("ts").alias("closed"), F.sum(F.when(F.col("signed") > 0, -F.col("paid")).otherwise(F.col("paid"))).alias("gain"), F.bool_or(F.col("position") == 0).alias("flat"))


@R.query(GROWTH + f""", s AS (SELECT k.seed, g.symbol, g.ret * CASE WHEN substr(md5(k.seed || ':' || g.symbol || ':' || (epoch(g.ts)::BIGINT // 604800)), 1, 1) < '8' THEN 1 ELSE -1 END AS ret FROM growth g, (SELECT unnest(range(0, 50)) AS seed) k),
n AS (SELECT symbol, seed, sum(ret) AS total FROM s GROUP BY symbol, seed), a AS (SELECT symbol, sum(ret) AS total FROM growth GROUP BY symbol)
SELECT n.symbol, any_value(a.total) AS total, quantile_cont(n.total, 0.95) AS null_95, count(*) FILTER (n.total < a.total) / count(*) AS beaten FROM n JOIN a USING (symbol) GROUP BY n.symbol""")
def random_sign_nulls(spark: SparkSession, sf: str) -> DataFrame:
    """Each series against fifty of its own with signs redrawn each week by a seeded digest."""
    g = growth(spark, sf).withColumn("week", F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 604800))
    s = g.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(49))))
    sign = F.when(F.substring(F.md5(F.concat_ws(":", F.col("seed").cast("string"), "symbol", F.col("week").cast("string"))), 1, 1) < "8", 1).otherwise(-1)
    n = s.groupBy("symbol", "seed").agg(F.sum(F.col("ret") * sign).alias("drawn"))
    a = g.groupBy("symbol").agg(F.sum("ret").alias("total"))
    return n.join(a, "symbol").groupBy("symbol").agg(F.first("total").alias("total"), F.percentile("drawn", F.lit(0.95)).alias("null_95"), (F.count_if(F.col("drawn") < F.col("total")) / F.count("*")).alias("beaten"))


@R.query(D + f""", b AS (SELECT symbol, close, high, low, row_number() {LAG} - 1 AS ix FROM bars), p AS (SELECT a.symbol, a.ix, n.ix AS later, n.high >= a.close * 1.3 AS up, n.low <= a.close * 0.8 AS down FROM b a JOIN b n ON n.symbol = a.symbol AND n.ix > a.ix AND n.ix <= a.ix + 10),
f AS (SELECT symbol, ix, min(later) FILTER (up) AS u, min(later) FILTER (down) AS d FROM p GROUP BY symbol, ix)
SELECT symbol, count(*) AS n, count(*) FILTER (u < d OR (u IS NOT NULL AND d IS NULL)) AS n_up, count(*) FILTER (d <= u OR (d IS NOT NULL AND u IS NULL)) AS n_down, any_value(0.2 / (0.3 + 0.2)) AS baseline FROM f GROUP BY symbol""")
def first_passages(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a bar's upper or lower barrier is passed first within ten bars (a tie is the lower), against a fair walk's share."""
    b = m.daily_bars(spark, sf).select("symbol", "ts", "close", "high", "low")
    after = F.collect_list(F.struct("high", "low")).over(ft.order().rowsBetween(1, 10))  # ten rows a bar
    p = b.withColumn("after", after).where(F.size("after") > 0)
    first = lambda cond: F.get(F.filter(F.transform("after", lambda x, i: F.when(cond(x), i)), lambda i: i.isNotNull()), F.lit(0))
    f = p.select("symbol", first(lambda x: x["high"] >= F.col("close") * 1.3).alias("u"), first(lambda x: x["low"] <= F.col("close") * 0.8).alias("d"))
    up, down = F.col("u").isNotNull() & (F.col("d").isNull() | (F.col("u") < F.col("d"))), F.col("d").isNotNull() & (F.col("u").isNull() | (F.col("d") <= F.col("u")))
    return f.groupBy("symbol").agg(F.count("*").alias("n"), F.count_if(up).alias("n_up"), F.count_if(down).alias("n_down"), F.lit(0.2 / (0.3 + 0.2)).alias("baseline"))


@R.query(D + f""", cut AS (SELECT *, row_number() {LAG} <= count(*) OVER (PARTITION BY symbol) // 2 AS early FROM bars), full_run AS (SELECT symbol, ts, early, {SMA('close', 10)} AS sma, {STD('close', 10)} AS dev, lead(close) {LAG} AS leaky FROM cut), half AS (SELECT symbol, ts, {SMA('close', 10)} AS sma, {STD('close', 10)} AS dev, lead(close) {LAG} AS leaky FROM cut WHERE early),
j AS (SELECT unnest([{{'feature': 'sma', 'same': f.sma IS NOT DISTINCT FROM h.sma}}, {{'feature': 'dev', 'same': f.dev IS NOT DISTINCT FROM h.dev}}, {{'feature': 'leaky', 'same': f.leaky IS NOT DISTINCT FROM h.leaky}}], recursive := true) FROM full_run f JOIN half h USING (symbol, ts))
SELECT feature, count(*) AS n, count(*) FILTER (NOT same) AS n_changed, count(*) FILTER (NOT same) = 0 AS causal FROM j GROUP BY feature""")
def leak_check(spark: SparkSession, sf: str) -> DataFrame:
    """Features over all bars against the same over the first half alone: what changes has looked ahead. One of the three does."""
    b = m.daily_bars(spark, sf)
    cut = b.withColumn("early", F.row_number().over(ft.order()) <= F.floor(F.count("*").over(Window.partitionBy("symbol")) / 2))
    made = {"sma": ft.sma(F.col("close"), 10), "dev": ft.std(F.col("close"), 10), "leaky": F.lead("close").over(ft.order())}
    full = cut.select("symbol", "ts", *[x.alias(f"f_{k}") for k, x in made.items()])
    half = cut.where("early").select("symbol", "ts", *[x.alias(k) for k, x in made.items()])
    near = lambda a, b: a.eqNullSafe(b) | F.coalesce(F.abs(a - b) <= 1e-9, F.lit(False))
    j = half.join(full, ["symbol", "ts"]).select(*[near(F.col(k), F.col(f"f_{k}")).alias(k) for k in made])
    long = j.unpivot([], list(made), "feature", "same")
    return long.groupBy("feature").agg(F.count("*").alias("n"), F.count_if(~F.col("same")).alias("n_changed")).withColumn("causal", F.col("n_changed") == 0)


@R.query(CONFIG_SQL + """, g AS (SELECT config_id::BIGINT AS config_id, count(*) AS n, avg(ret) / stddev_pop(ret) AS sharpe, count(*) FILTER (ret > 0) / count(*) AS hit, sum(ret) AS total FROM returns GROUP BY config_id),
v AS (SELECT config_id, unnest([{'gate': 'g1_length', 'value': n::DOUBLE, 'passed': n >= 500}, {'gate': 'g2_sharpe', 'value': sharpe, 'passed': sharpe > 0}, {'gate': 'g3_hits', 'value': hit, 'passed': hit >= 0.2}, {'gate': 'g4_total', 'value': total, 'passed': total > 0}], recursive := true) FROM g)
SELECT config_id, gate, value, passed, bool_and(passed) OVER (PARTITION BY config_id ORDER BY gate ROWS UNBOUNDED PRECEDING) AS reached FROM v""")
def gate_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Each configuration at each gate, and whether it passed all up to there."""
    r = F.col("ret")
    g = config_returns(spark, sf).groupBy("config_id").agg(F.count("*").alias("n"), (F.avg(r) / F.stddev_pop(r)).alias("sharpe"), (F.count_if(r > 0) / F.count("*")).alias("hit"), F.sum(r).alias("total"))
    gates = (("g1_length", F.col("n").cast("double"), F.col("n") >= 500), ("g2_sharpe", F.col("sharpe"), F.col("sharpe") > 0), ("g3_hits", F.col("hit"), F.col("hit") >= 0.2), ("g4_total", F.col("total"), F.col("total") > 0))
    v = g.select("config_id", F.explode(F.array(*[F.struct(F.lit(k).alias("gate"), x.alias("value"), ok.alias("passed")) for k, x, ok in gates])).alias("v")).select("config_id", "v.*")
    return v.withColumn("reached", F.bool_and("passed").over(Window.partitionBy("config_id").orderBy("gate").rowsBetween(Window.unboundedPreceding, 0)))


@R.query(CONFIG_SQL + """, g AS (SELECT config_id::BIGINT AS config_id, sum(ret) AS total, stddev_pop(ret) AS dev, count(*) FILTER (ret > 0) AS ups FROM returns GROUP BY config_id), n AS (SELECT count(*) AS m FROM g),
k AS (SELECT config_id, (rank() OVER (ORDER BY total) - 1 + (count(*) OVER (PARTITION BY total) - 1) / 2) / (m - 1) AS p1, (rank() OVER (ORDER BY -dev) - 1 + (count(*) OVER (PARTITION BY dev) - 1) / 2) / (m - 1) AS p2, (rank() OVER (ORDER BY ups) - 1 + (count(*) OVER (PARTITION BY ups) - 1) / 2) / (m - 1) AS p3 FROM g, n)
SELECT config_id, p1, p2, p3, 0.5 * p1 + 0.25 * p2 + 0.25 * p3 AS fitness, greatest(p1, p2, p3) - least(p1, p2, p3) AS dispersion FROM k""")
def ranking_terms(spark: SparkSession, sf: str) -> DataFrame:
    """A fitness of normalised ranks, and how far these lie apart. Configurations are few, so ranks over all are one task."""
    r = F.col("ret")
    g = config_returns(spark, sf).groupBy("config_id").agg(F.sum(r).alias("total"), (-F.stddev_pop(r)).alias("calm"), F.count_if(r > 0).alias("ups"))
    m_ = F.count("*").over(Window.partitionBy())
    place = lambda c: (F.rank().over(Window.orderBy(c)) - 1 + (F.count("*").over(Window.partitionBy(c)) - 1) / 2) / (m_ - 1)
    k = g.select("config_id", place("total").alias("p1"), place("calm").alias("p2"), place("ups").alias("p3"))
    p1, p2, p3 = F.col("p1"), F.col("p2"), F.col("p3")
    return k.select("config_id", "p1", "p2", "p3", (0.5 * p1 + 0.25 * p2 + 0.25 * p3).alias("fitness"), (F.greatest(p1, p2, p3) - F.least(p1, p2, p3)).alias("dispersion"))


_TRADED = next(s for s in SETUPS if s.name == "long_rsi")
R_SQL = setup_sql(_TRADED) + """, nb AS (SELECT symbol, ts, close, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ix FROM bars), o AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY exit_ix, entry_ix) AS n FROM trades),
cu AS (SELECT *, sum(net_r) OVER (PARTITION BY symbol ORDER BY n ROWS UNBOUNDED PRECEDING) AS equity FROM o), dd AS (SELECT *, greatest(max(equity) OVER (PARTITION BY symbol ORDER BY n ROWS UNBOUNDED PRECEDING), 0) - equity AS fall FROM cu)"""


def traded(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    bars = m.daily_bars(spark, sf)
    numbered = bars.select("symbol", "ts", "close", (F.row_number().over(ft.order()) - 1).cast("bigint").alias("bar_ix"))
    return numbered, so.trades_of(bars, _TRADED)


@R.query(R_SQL + """, t AS (SELECT symbol, (max(epoch(ts)) - min(epoch(ts))) / 86400.0 / 30.4375 AS months FROM nb GROUP BY symbol), da AS (SELECT symbol, exit_ix, sum(net_r) AS r FROM trades GROUP BY ALL),
dy AS (SELECT n.symbol, n.ix, coalesce(d.r, 0) AS r, sum(coalesce(d.r, 0)) OVER (PARTITION BY n.symbol ORDER BY n.ix ROWS UNBOUNDED PRECEDING) AS equity FROM nb n LEFT JOIN da d ON d.symbol = n.symbol AND d.exit_ix = n.ix), ul AS (SELECT symbol, r, greatest(max(equity) OVER (PARTITION BY symbol ORDER BY ix ROWS UNBOUNDED PRECEDING), 0) - equity AS fall FROM dy),
us AS (SELECT symbol, sqrt(avg(fall * fall)) AS ulcer, avg(r) / NULLIF(stddev_samp(r), 0) * sqrt(30.4375) AS sharpe FROM ul GROUP BY symbol)
SELECT d.symbol, count(*) AS n_trades, sum(net_r) AS performance, max(fall) AS max_dd, (sum(fall) + arg_max(fall, n)) / (count(*) + 2) AS avg_dd, sum(net_r) / any_value(months) AS r_per_month, any_value(ulcer) AS ulcer_r, sum(net_r) / any_value(months) / NULLIF(any_value(ulcer), 0) AS martin, any_value(sharpe) AS sharpe_monthly, count(*) FILTER (net_r > 0) AS n_wins, avg(net_r) FILTER (net_r > 0) AS avg_win, avg(-net_r) FILTER (net_r <= 0) AS avg_loss FROM dd d JOIN t USING (symbol) JOIN us USING (symbol) GROUP BY d.symbol""")
def r_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics of a list of trades in units of risk."""
    bars, trades = traded(spark, sf)
    w = Window.partitionBy("symbol").orderBy("exit_ix", "entry_ix").rowsBetween(Window.unboundedPreceding, 0)
    c = trades.withColumn("equity", F.sum("net_r").over(w))
    d = c.withColumn("fall", F.greatest(F.max("equity").over(w), F.lit(0.0)) - F.col("equity"))
    g = d.groupBy("symbol").agg(F.count("*").alias("n_trades"), F.sum("net_r").alias("performance"), F.max("fall").alias("max_dd"), ((F.sum("fall") + F.max_by("fall", F.struct("exit_ix", "entry_ix"))) / (F.count("*") + 2)).alias("avg_dd"), F.count_if(F.col("net_r") > 0).alias("n_wins"), F.avg(F.when(F.col("net_r") > 0, F.col("net_r"))).alias("avg_win"), F.avg(F.when(F.col("net_r") <= 0, -F.col("net_r"))).alias("avg_loss"))
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    months = bars.groupBy("symbol").agg(((F.max(seconds) - F.min(seconds)) / 86400.0 / 30.4375).alias("months"))
    day = trades.groupBy("symbol", F.col("exit_ix").alias("bar_ix")).agg(F.sum("net_r").alias("r"))
    by = Window.partitionBy("symbol").orderBy("bar_ix").rowsBetween(Window.unboundedPreceding, 0)
    e = bars.join(day, ["symbol", "bar_ix"], "left").withColumn("r", F.coalesce("r", F.lit(0.0))).withColumn("equity", F.sum("r").over(by))
    u = e.withColumn("fall", F.greatest(F.max("equity").over(by), F.lit(0.0)) - F.col("equity")).groupBy("symbol").agg(F.sqrt(F.avg(F.col("fall") * F.col("fall"))).alias("ulcer_r"), (F.try_divide(F.avg("r"), F.nullif(F.stddev_samp("r"), F.lit(0.0))) * F.sqrt(F.lit(30.4375))).alias("sharpe_monthly"))
    per = F.col("performance") / F.col("months")
    return g.join(months, "symbol").join(u, "symbol").select("symbol", "n_trades", "performance", "max_dd", "avg_dd", per.alias("r_per_month"), "ulcer_r", F.try_divide(per, F.nullif(F.col("ulcer_r"), F.lit(0.0))).alias("martin"), "sharpe_monthly", "n_wins", "avg_win", "avg_loss")


@R.query(R_SQL + f""", op AS (SELECT n.symbol, n.ix, count(t.entry_ix) AS n_open, coalesce(sum((n.close - t.entry_price) / t.risk - {so.ENTRY_FEE} * t.entry_price / t.risk - {so.HOLDING_FEE} * (n.ix - t.entry_ix) * t.entry_price / t.risk), 0) AS unrealised FROM nb n LEFT JOIN trades t ON t.symbol = n.symbol AND n.ix >= t.entry_ix AND n.ix < t.exit_ix GROUP BY n.symbol, n.ix),
cl AS (SELECT symbol, exit_ix AS ix, sum(net_r) AS r FROM trades GROUP BY ALL) SELECT o.symbol, o.ix AS bar_ix, o.n_open, sum(coalesce(c.r, 0)) OVER (PARTITION BY o.symbol ORDER BY o.ix ROWS UNBOUNDED PRECEDING) + o.unrealised AS equity FROM op o LEFT JOIN cl c ON c.symbol = o.symbol AND c.ix = o.ix""")
def marked_equity(spark: SparkSession, sf: str) -> DataFrame:
    """Closed and open trades marked to each close; an open trade's bars join by a bucket of its holding time."""
    bars, trades = traded(spark, sf)
    hold = _TRADED.hold
    spread = trades.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("entry_ix") / hold), F.floor(F.col("exit_ix") / hold))))
    held = spread.join(bars.withColumn("bucket", F.floor(F.col("bar_ix") / hold)).select("symbol", "bucket", "bar_ix", "close"), ["symbol", "bucket"]).where("bar_ix >= entry_ix AND bar_ix < exit_ix")
    size = F.col("entry_price") / F.col("risk")
    open_ = held.groupBy("symbol", "bar_ix").agg(F.count("*").alias("n_open"), F.sum((F.col("close") - F.col("entry_price")) / F.col("risk") - so.ENTRY_FEE * size - so.HOLDING_FEE * (F.col("bar_ix") - F.col("entry_ix")) * size).alias("unrealised"))
    closed = trades.groupBy("symbol", F.col("exit_ix").alias("bar_ix")).agg(F.sum("net_r").alias("r"))
    j = bars.join(open_, ["symbol", "bar_ix"], "left").join(closed, ["symbol", "bar_ix"], "left")
    by = Window.partitionBy("symbol").orderBy("bar_ix").rowsBetween(Window.unboundedPreceding, 0)
    return j.select("symbol", "bar_ix", F.coalesce("n_open", F.lit(0)).alias("n_open"), (F.sum(F.coalesce("r", F.lit(0.0))).over(by) + F.coalesce("unrealised", F.lit(0.0))).alias("equity"))


@R.query(D + f""", k AS (SELECT symbol, ts, close, close * volume AS traded, row_number() {LAG} AS history FROM bars), v AS (SELECT *, CASE WHEN count(traded) OVER {W(60)} >= 30 THEN quantile_cont(traded, 0.5) OVER {W(60)} END AS usual FROM k),
ms AS (SELECT min(ts) AS ts FROM (SELECT DISTINCT ts FROM bars) GROUP BY year(ts), month(ts)), rk AS (SELECT v.symbol, v.ts, row_number() OVER (PARTITION BY v.ts ORDER BY usual DESC, symbol) <= 3 AS member FROM v JOIN ms USING (ts) WHERE history >= 60 AND usual IS NOT NULL),
al AS (SELECT v.symbol, v.ts, v.close, CASE WHEN ms.ts IS NOT NULL THEN coalesce(rk.member, false) END AS decided FROM v LEFT JOIN ms ON ms.ts = v.ts LEFT JOIN rk ON rk.symbol = v.symbol AND rk.ts = v.ts)
SELECT symbol, ts, coalesce(last_value(decided IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), false) AS member FROM al""")
def universe_members(spark: SparkSession, sf: str) -> DataFrame:
    """The month's top three by trailing median value traded, decided at its first day and held (three is the feature)."""
    return universe(spark, sf).select("symbol", "ts", "member")


def universe(spark: SparkSession, sf: str) -> DataFrame:
    b = m.daily_bars(spark, sf)
    traded_ = F.col("close") * F.col("volume")
    w = ft.last(60)
    v = b.select("symbol", "ts", "close", F.row_number().over(ft.order()).alias("history"), F.when(F.count(traded_).over(w) >= 30, F.percentile(traded_, F.lit(0.5)).over(w)).alias("usual"))
    starts = b.groupBy(F.date_trunc("month", "ts").alias("month")).agg(F.min("ts").alias("ts")).select("ts", F.lit(True).alias("starts"))
    v = v.join(F.broadcast(starts), "ts", "left")  # a row a month
    ok = F.col("starts") & (F.col("history") >= 60) & F.col("usual").isNotNull()
    place = F.row_number().over(Window.partitionBy("ts", ok).orderBy(F.desc("usual"), "symbol"))
    decided = F.when(F.col("starts"), F.coalesce(ok & (place <= 3), F.lit(False)))
    return v.withColumn("decided", decided).withColumn("member", F.coalesce(ft.fill_forward(F.col("decided")), F.lit(False)))


@R.query(D + f""", k AS (SELECT symbol, ts, close, close / NULLIF(lag(close) {LAG}, 0) - 1 AS ret FROM bars), v AS (SELECT *, CASE WHEN count(ret) OVER {W(60)} = 60 THEN stddev_samp(ret) OVER {W(60)} END AS vol, (sign(close - lag(close, 20) {LAG}) + sign(close - lag(close, 60) {LAG})) / 2 AS side FROM k),
q AS (SELECT symbol, ts, coalesce(side * (0.05 / NULLIF(vol, 0)) / count(*) OVER (PARTITION BY ts), 0) AS raw FROM v), g AS (SELECT *, sum(abs(raw)) OVER (PARTITION BY ts) AS gross FROM q)
SELECT symbol, ts, raw * least(coalesce(0.1 / NULLIF(gross, 0), 1.0), 1.0) AS weight FROM g""")
def target_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Sides over volatility, shared among a day's members, with the gross capped."""
    c = F.col("close")
    k = m.daily_bars(spark, sf).select("symbol", "ts", "close", ft.growth(c).alias("ret"))
    v = k.select("symbol", "ts", ft.sample_std(F.col("ret"), 60).alias("vol"), ft.momentum_sign(c, [20, 60]).alias("side"))
    day = Window.partitionBy("ts")
    q = v.withColumn("raw", F.coalesce(F.col("side") * F.try_divide(F.lit(0.05), F.nullif(F.col("vol"), F.lit(0.0))) / F.count("*").over(day), F.lit(0.0)))
    cap = F.least(F.coalesce(F.try_divide(F.lit(0.1), F.nullif(F.sum(F.abs("raw")).over(day), F.lit(0.0))), F.lit(1.0)), F.lit(1.0))
    return q.select("symbol", "ts", (F.col("raw") * cap).alias("weight"))


_TRIALS = 50
_Z = lambda b: f"CASE WHEN 1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe * sharpe > 0 AND n > 1 THEN (sharpe - ({b})) * sqrt(n - 1.0) / sqrt(1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe * sharpe) END"


@R.query(GROWTH + f""", s AS (SELECT symbol, count(*) AS n, avg(ret) AS mean FROM growth GROUP BY symbol), p AS (SELECT symbol, any_value(n) AS n, any_value(mean) AS mean, avg((ret - mean) ** 2) AS m2, avg((ret - mean) ** 3) AS m3, avg((ret - mean) ** 4) AS m4 FROM growth JOIN s USING (symbol) GROUP BY symbol),
q AS (SELECT symbol, n, mean / sqrt(m2) AS sharpe, m3 / m2 ** 1.5 * sqrt(n * (n - 1.0)) / (n - 2) AS skew, (n - 1.0) / ((n - 2.0) * (n - 3.0)) * ((n + 1.0) * (m4 / (m2 * m2) - 3) + 6) + 3 AS kurtosis FROM p),
v AS (SELECT *, (SELECT sqrt(var_pop(sharpe)) FROM q) * {st.expected_max_sharpe(_TRIALS)!r}::DOUBLE AS best FROM q), z AS (SELECT *, {_Z('0')} AS z0, {_Z('best')} AS z1 FROM v)
SELECT symbol, n, sharpe, best, {st.normal_cdf_sql('z0')} AS probabilistic, {st.normal_cdf_sql('z1')} AS deflated FROM z""")
def deflated_sharpe(spark: SparkSession, sf: str) -> DataFrame:
    """Each series' ratio against nothing, and against the best that so many trials would show by luck."""
    q = st.sharpe_moments(growth(spark, sf), ["symbol"])
    best = F.sqrt(F.var_pop("sharpe").over(Window.partitionBy())) * st.expected_max_sharpe(_TRIALS)  # a row a series
    v = q.withColumn("best", best)
    z = lambda b: st.sharpe_z(F.col("sharpe"), b, F.col("n"), F.col("skew"), F.col("kurtosis"))
    return v.select("symbol", "n", "sharpe", "best", st.normal_cdf(z(F.lit(0.0))).alias("probabilistic"), st.normal_cdf(z(F.col("best"))).alias("deflated"))


@R.query(f"WITH x AS (SELECT event_id, value / 50 - 1 AS z FROM events) SELECT event_id, {st.normal_cdf_sql('z')} AS p FROM x")
def normal_probabilities(spark: SparkSession, sf: str) -> DataFrame:
    return m.read(spark, sf, "events").select("event_id", st.normal_cdf(F.col("value") / 50 - 1).alias("p"))


_CUTS = ("1996-06-30", "1997-12-31", "1999-03-15")
_SHAKEN = lambda c: f"CASE WHEN b.ts > v.cut_ts THEN b.{c} * (1 + (date_diff('day', DATE '1970-01-01', b.ts::DATE) * 7919 % 13 + 1) / 16.0::DOUBLE) ELSE b.{c} END AS {c}"
_MADE = f"""{SMA('close', 10)} AS sma, close - lag(close, 5) OVER (PARTITION BY {{0}} ORDER BY ts) AS step, lead(close) OVER (PARTITION BY {{0}} ORDER BY ts) AS ahead, (lag(close) OVER (PARTITION BY {{0}} ORDER BY ts) + close + lead(close) OVER (PARTITION BY {{0}} ORDER BY ts)) / 3 AS centred, close / max(close) OVER (PARTITION BY {{0}}) AS scaled"""
_FIVE = "[" + ", ".join(f"{{'feature': '{x}', 'same': a.{x} IS NOT DISTINCT FROM f.{x} OR coalesce(abs(a.{x} - f.{x}) <= 1e-9, false)}}" for x in ("sma", "step", "ahead", "centred", "scaled")) + "]"


@R.query(D + f""", v AS (SELECT c.cut, k.mode, c.cut_ts FROM (VALUES {', '.join(f"({i}, TIMESTAMP '{c}')" for i, c in enumerate(_CUTS))}) c(cut, cut_ts), (VALUES ('truncated'), ('perturbed')) k(mode)),
vb AS (SELECT v.cut::INT AS cut, v.mode, v.cut_ts, b.symbol AS of, v.cut || v.mode || b.symbol AS symbol, b.ts, {_SHAKEN('close')} FROM bars b, v WHERE v.mode = 'perturbed' OR b.ts <= v.cut_ts),
a AS (SELECT cut, mode, cut_ts, of, ts, {_MADE.format('symbol')} FROM vb), f AS (SELECT symbol, ts, {_MADE.format('symbol')} FROM bars),
l AS (SELECT a.cut, a.mode, a.ts, unnest({_FIVE}, recursive := true) FROM a JOIN f ON f.symbol = a.of AND f.ts = a.ts WHERE a.ts <= a.cut_ts)
SELECT cut, mode, feature, count(*) AS n, count(*) FILTER (NOT same) AS n_changed, min(ts) FILTER (NOT same) AS first_ts, count(*) FILTER (NOT same) = 0 AS causal FROM l GROUP BY cut, mode, feature""")
def leak_check_cuts(spark: SparkSession, sf: str) -> DataFrame:
    """Two causal features and three leaky ones at three cuts, truncated and perturbed, in one plan."""
    c = F.col("close")

    def feature(d: DataFrame) -> DataFrame:
        ahead = F.lead("close").over(ft.order())
        return d.withColumns({"sma": ft.sma(c, 10), "step": c - ft.ago(c, 5), "ahead": ahead, "centred": (ft.ago(c, 1) + c + ahead) / 3, "scaled": c / F.max("close").over(Window.partitionBy("symbol"))})

    return lk.leak_check(m.daily_bars(spark, sf), feature, ("sma", "step", "ahead", "centred", "scaled"), _CUTS)
