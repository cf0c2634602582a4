"""Queries on condition masks, carries, curves, studies and their tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barline.functions import features as ft
from barline.operators import strategies as so
from barline.plans.analytics_queries import CONFIG_SQL, config_returns
from barline.plans.bar_queries import asof_backward
from barline.plans.feature_queries import SMA, STD, W
from barline.plans.research_queries import GROWTH, growth
from barline.plans.strategy_queries import SETUPS, setup_sql
from barline.registry import Registry
from barline.sources import market as m

R = Registry()
D, H = f"WITH {m.DAILY_SQL} ", f"WITH {m.HOURLY_SQL} "
LAG = "OVER (PARTITION BY symbol ORDER BY ts)"

_X = {  # name of a mask: condition on the featured bars, the same for both engines
    "none": "true",
    "below_sma20": "close < sma20",
    "below_sma50": "close < sma50",
    "below_sma100": "close < sma100",
    "week_down": "close < c7",
    "month_down": "close < c30",
    "low_vol": "dev20 < dev60",
    "wide": "dev20 > 1.5 * dev60",
    "stretched_up": "close > sma20 + 2 * dev20",
    "stretched_down": "close < sma20 - 2 * dev20",
    "volume_high": "volume >= 1.5 * usual_volume",
    "volume_very_high": "volume >= 2.0 * usual_volume",
    "volume_low": "volume < usual_volume",
    "closes_low": "close - low <= 0.25 * (high - low) AND high > low",
    "closes_high": "close - low >= 0.5 * (high - low) AND high > low",
    "big_bar": "high - low >= 2 * dev20",
    "small_bar": "high - low < dev20",
    "near_high": "close >= 0.9 * high30",
    "far_below_high": "close <= 0.8 * high30",
    "upper_half": "2 * close >= high30 + low30 AND high30 > low30",
    "lower_half": "2 * close < high30 + low30 AND high30 > low30",
    "market_down": "market < 0",
    "broad": "breadth >= 0.5",
    "very_broad": "breadth >= 0.65",
}
MASKED = D + f""", mk AS (SELECT ts, sum(sign(step)) AS market, avg((below)::INT) AS breadth FROM (SELECT symbol, ts, close - lag(close) {LAG} AS step, close < {SMA('close', 20)} AS below FROM bars) GROUP BY ts),
fe AS (SELECT b.*, {', '.join(f'{SMA("close", n)} AS sma{n}' for n in (20, 50, 100))}, {STD('close', 20)} AS dev20, {STD('close', 60)} AS dev60, lag(close, 7) {LAG} AS c7, lag(close, 30) {LAG} AS c30, {SMA('volume', 20)} AS usual_volume, CASE WHEN count(high) OVER {W(30)} = 30 THEN max(high) OVER {W(30)} END AS high30, CASE WHEN count(low) OVER {W(30)} = 30 THEN min(low) OVER {W(30)} END AS low30 FROM bars b),
masked AS (SELECT f.symbol, f.ts, f.close, mk.market, {', '.join(f'coalesce({x}, false) AS {k}_' for k, x in _X.items())} FROM fe f JOIN mk USING (ts))"""


def masked(spark: SparkSession, sf: str) -> DataFrame:
    """Daily bars with one boolean column a condition (NULL features never hold)."""
    c = F.col("close")
    b = m.daily_bars(spark, sf)
    s = b.select("ts", (c - ft.ago(c, 1)).alias("step"), (c < ft.sma(c, 20)).alias("below"))
    mk = s.groupBy("ts").agg(F.sum(F.signum("step")).alias("market"), F.avg(F.col("below").cast("int")).alias("breadth"))
    f = b.withColumns({f"sma{n}": ft.sma(c, n) for n in (20, 50, 100)} | {"dev20": ft.std(c, 20), "dev60": ft.std(c, 60), "c7": ft.ago(c, 7), "c30": ft.ago(c, 30), "usual_volume": ft.sma(F.col("volume"), 20), "high30": ft.rolling_max(F.col("high"), 30), "low30": ft.rolling_min(F.col("low"), 30)})
    return f.join(mk, "ts").select("symbol", "ts", "close", "market", *[F.coalesce(F.expr(x), F.lit(False)).alias(f"{k}_") for k, x in _X.items()])


_UNPIVOT = ", ".join(f"{{'condition': '{k}', 'hit': {k}_}}" for k in _X)


@R.query(MASKED + f", l AS (SELECT symbol, unnest([{_UNPIVOT}], recursive := true) FROM masked) SELECT symbol, condition, count(*) FILTER (hit) AS n_hits, count(*) AS n, count(*) FILTER (hit) / count(*) AS rate, count(*) FILTER (hit) / count(*) < 0.01 OR count(*) FILTER (hit) / count(*) > 0.99 AS degenerate FROM l GROUP BY symbol, condition")
def condition_masks(spark: SparkSession, sf: str) -> DataFrame:
    """How often each condition holds, and whether it is as good as never or always."""
    long = masked(spark, sf).unpivot(["symbol"], [f"{k}_" for k in _X], "name", "hit")
    rate = F.count_if("hit") / F.count("*")
    return long.groupBy("symbol", F.expr("rtrim('_', name)").alias("condition")).agg(F.count_if("hit").alias("n_hits"), F.count("*").alias("n"), rate.alias("rate")).withColumn("degenerate", (F.col("rate") < 0.01) | (F.col("rate") > 0.99))


@R.query(MASKED + f""", nx AS (SELECT *, lead(close, 5) {LAG} - close AS forward FROM masked), l AS (SELECT symbol, year(ts)::BIGINT AS year, forward, unnest([{_UNPIVOT}], recursive := true) FROM nx WHERE forward IS NOT NULL),
s AS (SELECT symbol, condition, year, avg(forward) AS mean FROM l WHERE hit GROUP BY ALL), d AS (SELECT s.condition, s.symbol, s.year, s.mean - b.mean AS delta FROM s JOIN s b ON b.condition = 'none' AND b.symbol = s.symbol AND b.year = s.year WHERE s.condition <> 'none')
SELECT condition, count(*) AS n_sets, quantile_cont(delta, 0.5) AS median_delta, count(*) FILTER (delta > 0) / count(*) AS share_better, count(DISTINCT year) FILTER (delta > 0) AS years_better FROM d GROUP BY condition""")
def condition_table(spark: SparkSession, sf: str) -> DataFrame:
    """Each condition against none: median difference, share of sets better, years in which some set is."""
    nx = masked(spark, sf).withColumn("forward", F.lead("close", 5).over(ft.order()) - F.col("close")).where("forward IS NOT NULL").withColumn("year", F.year("ts").cast("bigint"))
    long = nx.unpivot(["symbol", "year", "forward"], [f"{k}_" for k in _X], "name", "hit").where("hit").withColumn("condition", F.expr("rtrim('_', name)"))
    s = long.groupBy("symbol", "condition", "year").agg(F.avg("forward").alias("mean"))
    base = s.where("condition = 'none'").select("symbol", "year", F.col("mean").alias("base"))
    d = s.where("condition <> 'none'").join(base, ["symbol", "year"]).withColumn("delta", F.col("mean") - F.col("base"))
    return d.groupBy("condition").agg(F.count("*").alias("n_sets"), F.percentile("delta", F.lit(0.5)).alias("median_delta"), (F.count_if(F.col("delta") > 0) / F.count("*")).alias("share_better"), F.count_distinct(F.when(F.col("delta") > 0, F.col("year"))).alias("years_better"))


_COMBINED = (("below_sma20", "low_vol"), ("week_down", "volume_high"), ("upper_half", "broad"), ("lower_half", "small_bar"))


@R.query(MASKED + f", nx AS (SELECT *, lead(close) {LAG} - close AS forward FROM masked), l AS (SELECT date_trunc('month', ts)::TIMESTAMP AS month, forward, unnest([{', '.join(f'''{{'pair': '{a}&{b}', 'hit': {a}_ AND {b}_}}''' for a, b in _COMBINED)}], recursive := true) FROM nx WHERE forward IS NOT NULL), g AS (SELECT pair, month, sum(forward) AS r FROM l WHERE hit GROUP BY ALL) SELECT pair, month, r, sum(r) OVER (PARTITION BY pair ORDER BY month ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS trained FROM g")
def condition_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Conditions taken together, by month, with what was known of each from the twelve months before."""
    nx = masked(spark, sf).withColumn("forward", F.lead("close").over(ft.order()) - F.col("close")).where("forward IS NOT NULL")
    pairs = F.explode(F.array(*[F.struct(F.lit(f"{a}&{b}").alias("pair"), (F.col(f"{a}_") & F.col(f"{b}_")).alias("hit")) for a, b in _COMBINED])).alias("p")
    g = nx.select(F.date_trunc("month", "ts").cast("timestamp_ntz").alias("month"), "forward", pairs).where("p.hit").groupBy(F.col("p.pair").alias("pair"), "month").agg(F.sum("forward").alias("r"))
    return g.withColumn("trained", F.sum("r").over(Window.partitionBy("pair").orderBy("month").rowsBetween(-12, -1)))


@R.query(MASKED + ", f AS (SELECT symbol, ts, close, {0} AS dev FROM bars), t AS (SELECT symbol, quantile_cont(dev, 0.5) AS cut FROM f WHERE ts < TIMESTAMP '1998-01-01' GROUP BY symbol) SELECT f.symbol, f.ts, f.dev > t.cut AS wide, f.dev > t.cut AND k.broad_ AS kept FROM f JOIN t USING (symbol) JOIN masked k USING (symbol, ts) WHERE f.dev IS NOT NULL AND f.ts >= TIMESTAMP '1998-01-01'".replace("{0}", STD("close", 20)))
def frozen_median_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Bars whose feature lies above the median of the training years, which stays frozen, and that pass another condition."""
    f = m.daily_bars(spark, sf).select("symbol", "ts", ft.std(F.col("close"), 20).alias("dev")).where("dev IS NOT NULL")
    cut = F.expr("TIMESTAMP_NTZ '1998-01-01'")
    t = f.where(F.col("ts") < cut).groupBy("symbol").agg(F.percentile("dev", F.lit(0.5)).alias("cut"))
    wide = F.col("dev") > F.col("cut")
    return f.where(F.col("ts") >= cut).join(t, "symbol").join(masked(spark, sf).select("symbol", "ts", "broad_"), ["symbol", "ts"]).select("symbol", "ts", wide.alias("wide"), (wide & F.col("broad_")).alias("kept"))


@R.query(D + f", z AS (SELECT symbol, (close - {SMA('close', 20)}) / NULLIF({STD('close', 20)}, 0) AS z FROM bars) SELECT symbol, k.level::DOUBLE AS level, count(*) FILTER (z > k.level) AS n_above, count(*) FILTER (z > k.level) / count(*) AS rate, quantile_cont(z, 0.05) AS q05, quantile_cont(z, 0.95) AS q95, count(*) FILTER (abs(z) > 2) / count(*) AS saturated FROM z, (VALUES (-2.0), (-1.0), (0.0), (1.0), (2.0)) k(level) WHERE z IS NOT NULL GROUP BY symbol, k.level")
def level_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Fire rates of a clause over a fixed grid of levels, with quantiles and the share out of range."""
    z = m.daily_bars(spark, sf).select("symbol", ft.zscore(F.col("close"), 20).alias("z")).where("z IS NOT NULL")
    l = z.withColumn("level", F.explode(F.array(*[F.lit(x) for x in (-2.0, -1.0, 0.0, 1.0, 2.0)])))
    return l.groupBy("symbol", "level").agg(F.count_if(F.col("z") > F.col("level")).alias("n_above"), (F.count_if(F.col("z") > F.col("level")) / F.count("*")).alias("rate"), F.percentile("z", F.lit(0.05)).alias("q05"), F.percentile("z", F.lit(0.95)).alias("q95"), (F.count_if(F.abs("z") > 2) / F.count("*")).alias("saturated"))


@R.query(H + f""", f AS (SELECT symbol, time_bucket(INTERVAL 4 HOURS, ts, TIMESTAMP '1970-01-01') AS slot, last(close ORDER BY ts) AS close FROM hours GROUP BY symbol, time_bucket(INTERVAL 4 HOURS, ts, TIMESTAMP '1970-01-01')), fr AS (SELECT symbol, slot AS ts, close FROM f),
s AS (SELECT symbol, ts + INTERVAL 4 HOURS AS known, close > {SMA('close', 10)} + {STD('close', 10)} AS up, close < {SMA('close', 10)} - {STD('close', 10)} AS down FROM fr)
SELECT h.symbol, h.ts, CASE WHEN s.up THEN 1 WHEN s.down THEN -1 ELSE 0 END::BIGINT AS side FROM hours h JOIN s ON s.symbol = h.symbol AND s.known = h.ts WHERE hour(h.ts) BETWEEN 4 AND 20""")
def activated_signals(spark: SparkSession, sf: str) -> DataFrame:
    """Signals of coarser bars at the finer bar that begins when they close, within a session."""
    c = F.col("close")
    four = m.resample(m.hourly_bars(spark, sf), F.window("ts", "4 hours").start.cast("timestamp_ntz"))
    side = F.when(c > ft.sma(c, 10) + ft.std(c, 10), 1).when(c < ft.sma(c, 10) - ft.std(c, 10), -1).otherwise(0)
    s = four.select("symbol", "ts", side.cast("bigint").alias("side")).select("symbol", (F.col("ts") + F.expr("INTERVAL 4 HOURS")).alias("ts"), "side")
    return m.hourly_bars(spark, sf).select("symbol", "ts").join(s, ["symbol", "ts"]).where(F.hour("ts").between(4, 20))


@R.query(H + """, c AS (SELECT symbol, min(ts) AS ts FROM hours h WHERE hour(ts) >= 21 AND dayofweek(ts) BETWEEN 1 AND 5 GROUP BY symbol, date_trunc('day', h.ts)),
r AS (SELECT event_type AS symbol, (date_trunc('day', ts) + INTERVAL 1 DAY)::TIMESTAMP AS known, floor(avg(value)) / 100000 AS rate FROM events WHERE dayofweek(ts) = 0 GROUP BY ALL)
SELECT c.symbol, c.ts, CASE WHEN dayofweek(c.ts) = 3 THEN 3 ELSE 1 END::BIGINT AS nights, r.rate * CASE WHEN dayofweek(c.ts) = 3 THEN 3 ELSE 1 END AS carry FROM c ASOF LEFT JOIN r ON r.symbol = c.symbol AND c.ts >= r.known""")
def swap_carry(spark: SparkSession, sf: str) -> DataFrame:
    """A night's carry at each weekday's first bar from 21:00, threefold on Wednesdays, at the rate known last."""
    h = m.hourly_bars(spark, sf).where((F.hour("ts") >= 21) & F.dayofweek("ts").between(2, 6))
    c = h.groupBy("symbol", F.date_trunc("day", "ts").alias("day")).agg(F.min("ts").alias("ts")).select("symbol", "ts")
    e = m.read(spark, sf, "events").where(F.dayofweek("ts") == 1)
    r = e.groupBy(F.col("event_type").alias("symbol"), (F.date_trunc("day", "ts") + F.expr("INTERVAL 1 DAY")).cast("timestamp_ntz").alias("known")).agg((F.floor(F.avg("value")).cast("double") / 100000).alias("rate"))
    nights = F.when(F.dayofweek("ts") == 4, 3).otherwise(1).cast("bigint")
    return asof_backward(c, r, "known", ["rate"]).select("symbol", "ts", nights.alias("nights"), (F.col("rate") * nights).alias("carry"))


@R.query(GROWTH + f""", d AS (SELECT symbol, ts, close, CASE WHEN count(ret) OVER {W(60)} = 60 THEN stddev_samp(ret) OVER {W(60)} END AS sigma FROM growth), k AS (SELECT *, lag(sigma) {LAG} AS known, date_trunc('month', ts)::TIMESTAMP AS month FROM d), a AS (SELECT *, first(close) OVER (PARTITION BY symbol, month ORDER BY ts) AS anchor, first(known) OVER (PARTITION BY symbol, month ORDER BY ts) AS month_sigma FROM k)
SELECT symbol, ts, known AS sigma, (close / NULLIF(anchor, 0) - 1) / NULLIF(month_sigma * sqrt(21.0), 0) AS deviation FROM a""")
def anchor_deviation(spark: SparkSession, sf: str) -> DataFrame:
    """How far a close lies from its month's first one, in deviations known before the month."""
    d = growth(spark, sf).withColumn("sigma", ft.sample_std(F.col("ret"), 60))
    k = d.select("symbol", "ts", "close", ft.ago(F.col("sigma"), 1).alias("known"), F.date_trunc("month", "ts").alias("month"))
    w = Window.partitionBy("symbol", "month").orderBy("ts")
    a = k.withColumn("anchor", F.first("close").over(w)).withColumn("month_sigma", F.first("known").over(w))
    return a.select("symbol", "ts", F.col("known").alias("sigma"), F.try_divide(F.try_divide("close", F.nullif(F.col("anchor"), F.lit(0.0))) - 1, F.nullif(F.col("month_sigma") * F.sqrt(F.lit(21.0)), F.lit(0.0))).alias("deviation"))


CURVES = CONFIG_SQL + """, cv AS (SELECT config_id::BIGINT AS config_id, year(obs_ix)::BIGINT AS win, obs_ix, ret / 10000000.0 AS ret FROM returns), e AS (SELECT *, product(1 + ret) OVER (PARTITION BY config_id, win ORDER BY obs_ix ROWS UNBOUNDED PRECEDING) AS equity FROM cv), fx AS (SELECT *, equity / greatest(max(equity) OVER (PARTITION BY config_id, win ORDER BY obs_ix ROWS UNBOUNDED PRECEDING), 1.0) - 1 AS fall FROM e),
st AS (SELECT config_id, win, arg_max(equity, obs_ix) - 1 AS total, (arg_max(equity, obs_ix) - 1) * 365.0 / count(*) AS yearly, min(fall) AS max_dd, count(*) AS n, count(*) FILTER (ret <> 0) AS n_active FROM fx GROUP BY config_id, win),
sc AS (SELECT *, CASE WHEN n_active >= 20 THEN yearly / greatest(-max_dd, 0.01) END AS score FROM st)"""


def window_statistics_of(spark: SparkSession, sf: str) -> DataFrame:
    cv = config_returns(spark, sf).select("config_id", F.year("obs_ix").cast("bigint").alias("win"), "obs_ix", (F.col("ret") / 10000000.0).alias("ret"))
    w = Window.partitionBy("config_id", "win").orderBy("obs_ix").rowsBetween(Window.unboundedPreceding, 0)
    f = cv.withColumn("equity", F.product(1 + F.col("ret")).over(w)).withColumn("fall", F.col("equity") / F.greatest(F.max("equity").over(w), F.lit(1.0)) - 1)
    end = F.max_by("equity", "obs_ix")
    st = f.groupBy("config_id", "win").agg((end - 1).alias("total"), ((end - 1) * 365.0 / F.count("*")).alias("yearly"), F.min("fall").alias("max_dd"), F.count("*").alias("n"), F.count_if(F.col("ret") != 0).alias("n_active"))
    return st.withColumn("score", F.when(F.col("n_active") >= 20, F.col("yearly") / F.greatest(-F.col("max_dd"), F.lit(0.01))))


@R.query(CURVES + " SELECT config_id, win, total, yearly, max_dd, n, n_active, score FROM sc")
def window_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Return, fall and score of each configuration in each window."""
    return window_statistics_of(spark, sf)


@R.query(CURVES + """, pk AS (SELECT win + 1 AS win, config_id, row_number() OVER (PARTITION BY win ORDER BY score DESC, config_id) AS place FROM sc WHERE score IS NOT NULL), dl AS (SELECT c.obs_ix AS ts, avg(c.ret) AS ret FROM cv c JOIN pk p ON p.win = c.win AND p.config_id = c.config_id AND p.place <= 3 GROUP BY c.obs_ix), eq AS (SELECT ts, ret, product(1 + ret) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS equity FROM dl)
SELECT ts, ret, equity, equity / max(equity) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1 AS fall FROM eq""")
def stitched_curve(spark: SparkSession, sf: str) -> DataFrame:
    """The three best of each window held through the next one, stitched to one curve (a row a day, so one task)."""
    sc = window_statistics_of(spark, sf).where("score IS NOT NULL")
    pk = sc.select((F.col("win") + 1).alias("win"), "config_id", F.row_number().over(Window.partitionBy("win").orderBy(F.desc("score"), "config_id")).alias("place")).where("place <= 3")
    cv = config_returns(spark, sf).select("config_id", F.year("obs_ix").cast("bigint").alias("win"), F.col("obs_ix").alias("ts"), (F.col("ret") / 10000000.0).alias("ret"))
    w = Window.orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    eq = cv.join(F.broadcast(pk), ["win", "config_id"]).groupBy("ts").agg(F.avg("ret").alias("ret")).withColumn("equity", F.product(1 + F.col("ret")).over(w))
    return eq.withColumn("fall", F.col("equity") / F.max("equity").over(w) - 1)


@R.query(GROWTH + """, p AS (SELECT symbol, CASE WHEN ts < TIMESTAMP '1998-06-01' THEN 'early' ELSE 'late' END AS era, avg(ret) AS mean FROM growth GROUP BY ALL), w AS (SELECT symbol, max(mean) FILTER (era = 'early') AS early, max(mean) FILTER (era = 'late') AS late FROM p GROUP BY symbol),
k AS (SELECT *, ntile(3) OVER (ORDER BY early DESC, symbol) AS tier, rank() OVER (ORDER BY early) AS re, rank() OVER (ORDER BY late) AS rl FROM w WHERE early IS NOT NULL AND late IS NOT NULL)
SELECT symbol, CASE tier WHEN 1 THEN 'good' WHEN 2 THEN 'neutral' ELSE 'bad' END AS grp, early, late, (SELECT corr(re, rl) FROM k) AS persistence FROM k""")
def series_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Series grouped by their early mean, and how that order persists. A row a series."""
    era = F.when(F.col("ts") < F.expr("TIMESTAMP_NTZ '1998-06-01'"), "early").otherwise("late")
    w = growth(spark, sf).withColumn("era", era).groupBy("symbol").pivot("era", ["early", "late"]).agg(F.avg("ret"))
    k = w.where("early IS NOT NULL AND late IS NOT NULL").withColumns({"tier": F.ntile(3).over(Window.orderBy(F.desc("early"), "symbol")), "re": F.rank().over(Window.orderBy("early")), "rl": F.rank().over(Window.orderBy("late"))})
    grp = F.when(F.col("tier") == 1, "good").when(F.col("tier") == 2, "neutral").otherwise("bad")
    return k.crossJoin(F.broadcast(k.agg(F.corr("re", "rl").alias("persistence")))).select("symbol", grp.alias("grp"), "early", "late", "persistence")


@R.query(CONFIG_SQL + """, y AS (SELECT config_id::BIGINT AS config_id, year(obs_ix)::BIGINT AS year, sum(ret) AS ret FROM returns GROUP BY ALL), t AS (SELECT a.config_id, a.year, k.len::BIGINT AS len, (SELECT sum(b.ret) FROM y b WHERE b.config_id = a.config_id AND b.year < a.year AND b.year >= a.year - k.len) AS trained, a.ret FROM y a, (VALUES (1), (2), (3)) k(len) WHERE a.year - k.len >= (SELECT min(year) FROM y)),
b AS (SELECT year, len, arg_max(ret, (trained, -config_id)) AS ret FROM t GROUP BY year, len), p AS (SELECT year, max(ret) FILTER (len = 1) AS one, max(ret) FILTER (len = 2) AS two, max(ret) FILTER (len = 3) AS three FROM b GROUP BY year)
SELECT year, one, two, three, two - one AS two_less_one, three - one AS three_less_one FROM p""")
def train_length_study(spark: SparkSession, sf: str) -> DataFrame:
    """The best configuration by training on one, two or three years, side by side with paired differences."""
    y = config_returns(spark, sf).groupBy("config_id", F.year("obs_ix").cast("bigint").alias("year")).agg(F.sum("ret").alias("ret"))
    w = Window.partitionBy("config_id").orderBy("year")
    trained = [F.when(F.count("ret").over(w.rangeBetween(-n, -1)) == n, F.sum("ret").over(w.rangeBetween(-n, -1))) for n in (1, 2, 3)]
    wide = y.withColumns({f"t{n}": x for n, x in zip((1, 2, 3), trained)})
    best = wide.groupBy("year").agg(*[F.max_by("ret", F.when(F.col(f"t{n}").isNotNull(), F.struct(F.col(f"t{n}"), -F.col("config_id")))).alias(name) for n, name in ((1, "one"), (2, "two"), (3, "three"))])
    return best.where("one IS NOT NULL").withColumn("two_less_one", F.col("two") - F.col("one")).withColumn("three_less_one", F.col("three") - F.col("one"))


_EXITS = [s for s in SETUPS if s.name in ("exit_donchian", "exit_pctb", "exit_trailing")]


@R.query(" UNION ALL ".join(f"SELECT '{s.name}' AS exit_rule, * FROM ({setup_sql(s)}, nb AS (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS entry_ix FROM bars), y AS (SELECT year(ts)::BIGINT AS year, sum(net_r) AS r, count(*) AS n FROM trades JOIN nb USING (symbol, entry_ix) GROUP BY year(ts)) SELECT count(*) AS n_years, sum(r) AS total_r, count(*) FILTER (r > 0) AS years_up, sum(n)::BIGINT AS n_trades, sum(r) > 0 AND 2 * count(*) FILTER (r > 0) > count(*) AS kept FROM y)" for s in _EXITS))
def exit_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Exits on the same entries: totals, years up, and a verdict."""
    out = None
    for s in _EXITS:
        nb = m.daily_bars(spark, sf).select("symbol", F.year("ts").cast("bigint").alias("year"), (F.row_number().over(ft.order()) - 1).cast("bigint").alias("entry_ix"))
        y = so.trades_of(m.daily_bars(spark, sf), s).join(nb, ["symbol", "entry_ix"]).groupBy("year").agg(F.sum("net_r").alias("r"), F.count("*").alias("n"))
        v = y.agg(F.count("*").alias("n_years"), F.sum("r").alias("total_r"), F.count_if(F.col("r") > 0).alias("years_up"), F.sum("n").alias("n_trades")).select(F.lit(s.name).alias("exit_rule"), "*", ((F.col("total_r") > 0) & (2 * F.col("years_up") > F.col("n_years"))).alias("kept"))
        out = v if out is None else out.unionByName(v)
    return out


@R.query(D + f""", f AS (SELECT symbol, ts, close, lag(close) {LAG} AS before, lead(close, 5) {LAG} AS later, {SMA('close', 20)} + 2 * {STD('close', 20)} AS up, {SMA('close', 20)} - 2 * {STD('close', 20)} AS down FROM bars), k AS (SELECT *, (later - close) / NULLIF(up - down, 0) AS move FROM f WHERE later IS NOT NULL AND up > down), dr AS (SELECT symbol, avg(move) AS drift FROM k GROUP BY symbol)
SELECT symbol, count(*) FILTER (before > down AND close < down) AS n_down, avg(move) FILTER (before > down AND close < down) AS down_move, avg(move) FILTER (before > down AND close < down) - any_value(drift) AS down_adjusted, count(*) FILTER (before < up AND close > up) AS n_up, avg(move) FILTER (before < up AND close > up) AS up_move, count(*) FILTER (before > down AND close < down AND later > down) / NULLIF(count(*) FILTER (before > down AND close < down), 0) AS fake_share FROM k JOIN dr USING (symbol) GROUP BY symbol""")
def band_break_study(spark: SparkSession, sf: str) -> DataFrame:
    """Moves after a close leaves its bands, in band widths and less the series' own drift (labels, so they look ahead)."""
    c = F.col("close")
    f = m.daily_bars(spark, sf).select("symbol", "close", ft.ago(c, 1).alias("before"), F.lead("close", 5).over(ft.order()).alias("later"), (ft.sma(c, 20) + 2 * ft.std(c, 20)).alias("up"), (ft.sma(c, 20) - 2 * ft.std(c, 20)).alias("down"))
    k = f.where("later IS NOT NULL AND up > down").withColumn("move", F.try_divide(F.col("later") - c, F.col("up") - F.col("down")))
    down, up = (F.col("before") > F.col("down")) & (c < F.col("down")), (F.col("before") < F.col("up")) & (c > F.col("up"))
    mean = lambda cond: F.avg(F.when(cond, F.col("move")))
    return k.groupBy("symbol").agg(F.count_if(down).alias("n_down"), mean(down).alias("down_move"), (mean(down) - F.avg("move")).alias("down_adjusted"), F.count_if(up).alias("n_up"), mean(up).alias("up_move"), F.try_divide(F.count_if(down & (F.col("later") > F.col("down"))), F.nullif(F.count_if(down), F.lit(0))).alias("fake_share"))


@R.query(GROWTH + f""", v AS (SELECT symbol, ts, ret, CASE WHEN count(ret) OVER {W(60)} = 60 THEN stddev_samp(ret) OVER {W(60)} END AS vol, sign(close - lag(close, 60) {LAG}) AS side FROM growth), d AS (SELECT *, CASE WHEN dayofweek(ts) = 1 AND side IS NOT NULL AND vol > 0 THEN side * least(0.02 / vol, 2.0) END AS decided FROM v),
k AS (SELECT *, last_value(decided IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS target FROM d), h AS (SELECT *, coalesce(lag(target) {LAG}, 0) AS held FROM k), t AS (SELECT *, abs(held - coalesce(lag(held) {LAG}, 0)) AS turned FROM h)
SELECT symbol, ts, held, turned, held * ret - 0.0005 * turned AS net FROM t""")
def targeted_momentum(spark: SparkSession, sf: str) -> DataFrame:
    """Momentum at a target volatility, decided on Mondays, held from the next bar, with costs on turnover."""
    c = F.col("close")
    v = growth(spark, sf).withColumns({"vol": ft.sample_std(F.col("ret"), 60), "side": F.signum(c - ft.ago(c, 60))})
    decided = F.when((F.dayofweek("ts") == 2) & F.col("side").isNotNull() & (F.col("vol") > 0), F.col("side") * F.least(0.02 / F.col("vol"), F.lit(2.0)))
    k = v.withColumn("decided", decided).withColumn("target", ft.fill_forward(F.col("decided")))
    h = k.withColumn("held", F.coalesce(ft.ago(F.col("target"), 1), F.lit(0.0)))
    t = h.withColumn("turned", F.abs(F.col("held") - F.coalesce(ft.ago(F.col("held"), 1), F.lit(0.0))))
    return t.select("symbol", "ts", "held", "turned", (F.col("held") * F.col("ret") - 0.0005 * F.col("turned")).alias("net"))
