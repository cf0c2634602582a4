"""Queries on regressions, sampling, sets and walk-forward studies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barline.functions import features as ft
from barline.plans.analytics_queries import CONFIG_SQL, MOVES, config_returns, moves
from barline.registry import Registry
from barline.sources import market as m

R = Registry()
D = f"WITH {m.DAILY_SQL} "


@R.query(MOVES + """, k AS (SELECT ts, sum(ret) AS market FROM moves WHERE ret IS NOT NULL GROUP BY ts), s AS (SELECT symbol, count(*) AS n, sum(ret) AS sy, sum(market) AS sx, sum(ret * market) AS sxy, sum(market * market) AS sxx FROM moves JOIN k USING (ts) WHERE ret IS NOT NULL GROUP BY symbol)
SELECT symbol, n, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS beta FROM s""")
def market_beta(spark: SparkSession, sf: str) -> DataFrame:
    """Slope of each series on the sum of all."""
    d = moves(spark, sf).where("ret IS NOT NULL")
    k = d.groupBy("ts").agg(F.sum("ret").alias("market"))
    s = d.join(k, "ts").groupBy("symbol").agg(F.count("*").alias("n"), F.sum("ret").alias("sy"), F.sum("market").alias("sx"), F.sum(F.col("ret") * F.col("market")).alias("sxy"), F.sum(F.col("market") * F.col("market")).alias("sxx"))
    return s.select("symbol", "n", ((F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / (F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"))).alias("beta"))


@R.query(MOVES + """, r AS (SELECT symbol, ts, ret, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS ix FROM moves WHERE ret IS NOT NULL),
l AS (SELECT a.symbol, k.k AS lag, sum(a.ret * b.ret) AS product FROM r a JOIN r b USING (symbol) JOIN range(0, 6) k(k) ON b.ix = a.ix - k.k GROUP BY ALL)
SELECT symbol, max(product) FILTER (lag = 0) AS v0, sum(product * 2 * (6 - lag)) FILTER (lag > 0) AS weighted FROM l GROUP BY symbol""")
def bartlett_sums(spark: SparkSession, sf: str) -> DataFrame:
    """Lagged self-products with falling weights: the long-run variance of moves in sixths, by windows alone."""
    d = moves(spark, sf).where("ret IS NOT NULL")
    lagged = d.select("symbol", "ret", *[F.lag("ret", k).over(ft.order()).alias(f"l{k}") for k in range(1, 6)])
    return lagged.groupBy("symbol").agg(F.sum(F.col("ret") * F.col("ret")).alias("v0"), sum((F.coalesce(F.sum(F.col("ret") * F.col(f"l{k}")), F.lit(0.0)) * 2 * (6 - k) for k in range(2, 6)), F.coalesce(F.sum(F.col("ret") * F.col("l1")), F.lit(0.0)) * 10).alias("weighted"))


@R.query(MOVES + """, x AS (SELECT symbol, ts, ret, sum(ret) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS five, count(ret) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS n FROM moves WHERE ret IS NOT NULL)
SELECT symbol, count(*) AS n, sum(five * five) FILTER (n = 5) / (5 * sum(ret * ret)) AS ratio FROM x GROUP BY symbol""")
def variance_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """Five-day moves against one-day moves."""
    x = moves(spark, sf).where("ret IS NOT NULL").withColumn("five", ft.full(F.col("ret"), 5, F.sum("ret").over(ft.last(5))))
    return x.groupBy("symbol").agg(F.count("*").alias("n"), (F.sum(F.col("five") * F.col("five")) / (5 * F.sum(F.col("ret") * F.col("ret")))).alias("ratio"))


@R.query(MOVES + ", w AS (SELECT symbol, (epoch(ts)::BIGINT // 604800) AS week, sum(ret) AS ret FROM moves WHERE ret IS NOT NULL GROUP BY ALL) SELECT symbol, count(*) AS n_weeks, sum(ret) AS total, sum(ret * ret) AS squares, count(*) FILTER (ret > 0) AS n_up FROM w GROUP BY symbol")
def weekly_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """Two-level aggregation: weeks by integer division of the epoch, then each series."""
    week = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 604800)
    w = moves(spark, sf).where("ret IS NOT NULL").groupBy("symbol", week.alias("week")).agg(F.sum("ret").alias("ret"))
    return w.groupBy("symbol").agg(F.count("*").alias("n_weeks"), F.sum("ret").alias("total"), F.sum(F.col("ret") * F.col("ret")).alias("squares"), F.count_if(F.col("ret") > 0).alias("n_up"))


@R.query("WITH o AS (SELECT o_orderpriority AS grp, o_orderkey AS id, o_totalprice AS score, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS place, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) SELECT grp, id, place FROM o WHERE place <= greatest(1, floor(n * 0.01))")
def top_fraction(spark: SparkSession, sf: str) -> DataFrame:
    """The best hundredth of each group, one at least (a top-k report)."""
    w = Window.partitionBy("o_orderpriority")
    o = m.read(spark, sf, "orders").select(F.col("o_orderpriority").alias("grp"), F.col("o_orderkey").alias("id"), F.row_number().over(w.orderBy(F.desc("o_totalprice"), "o_orderkey")).cast("bigint").alias("place"), F.count("*").over(w).alias("n"))
    return o.where(F.col("place") <= F.greatest(F.lit(1), F.floor(F.col("n") * 0.01))).drop("n")


@R.query("""WITH s AS (SELECT c_custkey AS trial, c_nationkey AS family, list_distinct(list_sort(list(o_orderkey % 15))) AS parts FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
p AS (SELECT a.trial, len(list_intersect(a.parts, b.parts)) AS shared, len(a.parts) + len(b.parts) - len(list_intersect(a.parts, b.parts)) AS whole FROM s a JOIN s b ON a.family = b.family AND b.trial < a.trial)
SELECT trial, max(shared / whole) AS likeness, count(*) AS n_earlier FROM p GROUP BY trial""")
def novelty(spark: SparkSession, sf: str) -> DataFrame:
    """Each trial's greatest set likeness to an earlier one of its family.

    Sets are bits over a fixed number of parts, so a trial is compared with the distinct sets of its family that came
    first before it, not with each earlier trial.
    """
    c, o = m.read(spark, sf, "customer"), m.read(spark, sf, "orders")
    bit = F.expr("shiftleft(1L, cast(o_orderkey % 15 as int))")
    s = c.join(o, c["c_custkey"] == o["o_custkey"]).groupBy(F.col("c_custkey").alias("trial"), F.col("c_nationkey").alias("family")).agg(F.bit_or(bit).alias("bits"))
    s = s.withColumn("n_earlier", F.row_number().over(Window.partitionBy("family").orderBy("trial")).cast("bigint") - 1)
    known = s.groupBy("family", F.col("bits").alias("other")).agg(F.min("trial").alias("first"))
    p = s.join(known, "family").where("first < trial")
    like = F.bit_count(F.col("bits").bitwiseAND(F.col("other"))) / F.bit_count(F.col("bits").bitwiseOR(F.col("other")))
    return p.groupBy("trial").agg(F.max(like).alias("likeness"), F.max("n_earlier").alias("n_earlier"))


@R.query(CONFIG_SQL + ", g AS (SELECT config_id, ntile(6) OVER (PARTITION BY config_id ORDER BY obs_ix) AS fold, ret FROM returns), fo AS (SELECT config_id, fold, sum(ret) AS total, count(*) AS n FROM g GROUP BY ALL) SELECT a.fold AS test_fold, b.config_id::BIGINT AS config_id, sum(b.total) AS train_total, max(c.total) AS test_total FROM (SELECT DISTINCT fold FROM fo) a JOIN fo b ON b.fold <> a.fold JOIN fo c ON c.fold = a.fold AND c.config_id = b.config_id GROUP BY ALL")
def fold_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Each configuration in and out of each fold: folds are aggregated once, six rows a configuration."""
    g = config_returns(spark, sf).withColumn("fold", F.ntile(6).over(Window.partitionBy("config_id").orderBy("obs_ix")).cast("bigint"))
    f = g.groupBy("config_id", "fold").agg(F.sum("ret").alias("total"))
    whole = F.sum("total").over(Window.partitionBy("config_id"))
    return f.select(F.col("fold").alias("test_fold"), "config_id", (whole - F.col("total")).alias("train_total"), F.col("total").alias("test_total"))


@R.query(D + ", y AS (SELECT symbol, ts, close, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS before FROM bars), e AS (SELECT year(ts) AS episode, symbol, min(close - before) AS worst FROM y WHERE before IS NOT NULL GROUP BY ALL) SELECT symbol, episode, worst, rank() OVER (PARTITION BY symbol ORDER BY worst) AS severity FROM e")
def episode_severity(spark: SparkSession, sf: str) -> DataFrame:
    """Worst day of each episode and its rank."""
    e = moves(spark, sf).where("ret IS NOT NULL").groupBy(F.year("ts").cast("bigint").alias("episode"), "symbol").agg(F.min("ret").alias("worst"))
    return e.withColumn("severity", F.rank().over(Window.partitionBy("symbol").orderBy("worst")).cast("bigint"))


@R.query("SELECT symbol, day, count(*) AS n, min(value) AS low, max(value) AS high, sum((hour BETWEEN 8 AND 15)::BIGINT)::BIGINT AS n_session FROM (SELECT event_type AS symbol, date_trunc('day', ts)::TIMESTAMP AS day, hour(ts) AS hour, value FROM events) GROUP BY ALL")
def session_flags(spark: SparkSession, sf: str) -> DataFrame:
    return m.read(spark, sf, "events").groupBy(F.col("event_type").alias("symbol"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.sum(F.hour("ts").between(8, 15).cast("bigint")).alias("n_session"))


@R.query("SELECT replace(replace(n_name, '/', '-'), ':', '-') || '_1d' AS file, sha256(n_name) AS digest, n_name LIKE 'A%' AS starts_a, regexp_matches(n_name, '^[A-Z ]+$') AS plain FROM nation")
def scalar_strings(spark: SparkSession, sf: str) -> DataFrame:
    """File names, digests and patterns of names."""
    n = F.col("n_name")
    return m.read(spark, sf, "nation").select(F.concat(m.safe_name(n), F.lit("_1d")).alias("file"), F.sha2(n, 256).alias("digest"), n.like("A%").alias("starts_a"), n.rlike("^[A-Z ]+$").alias("plain"))


@R.query(MOVES + """, d AS (SELECT symbol, ts, ret, CASE WHEN dayofweek(ts) = 1 THEN sign(sum(ret) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)) END AS decided FROM moves WHERE ret IS NOT NULL),
k AS (SELECT symbol, ts, ret, last_value(decided IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS side FROM d),
h AS (SELECT symbol, ts, ret, coalesce(lag(side) OVER (PARTITION BY symbol ORDER BY ts), 0) AS held FROM k), t AS (SELECT *, abs(held - coalesce(lag(held) OVER (PARTITION BY symbol ORDER BY ts), 0)) AS turned FROM h)
SELECT symbol, sum(held * ret - 50 * turned) AS net, sum(turned) AS turnover, count(*) FILTER (held <> 0) AS n_held FROM t GROUP BY symbol""")
def weekly_decided_momentum(spark: SparkSession, sf: str) -> DataFrame:
    """Sides decided on Mondays from sixty days, held from the next bar, with costs on turnover."""
    d = moves(spark, sf).where("ret IS NOT NULL").withColumn("decided", F.when(F.dayofweek("ts") == 2, F.signum(F.sum("ret").over(ft.last(60)))))
    k = d.withColumn("side", ft.fill_forward(F.col("decided")))
    h = k.withColumn("held", F.coalesce(F.lag("side").over(ft.order()), F.lit(0.0)))
    t = h.withColumn("turned", F.abs(F.col("held") - F.coalesce(F.lag("held").over(ft.order()), F.lit(0.0))))
    return t.groupBy("symbol").agg(F.sum(F.col("held") * F.col("ret") - 50 * F.col("turned")).alias("net"), F.sum("turned").alias("turnover"), F.count_if(F.col("held") != 0).alias("n_held"))


@R.query(D + ", p AS (SELECT symbol, ts, CASE WHEN close >= open THEN [open, low, high, close] ELSE [open, high, low, close] END AS path FROM bars) SELECT symbol, ts, generate_subscripts(path, 1) - 1 AS step, unnest(path) AS price FROM p")
def intrabar_path(spark: SparkSession, sf: str) -> DataFrame:
    """The order in which a bar is taken to visit its prices: the near extreme of its direction last."""
    up = F.array("open", "low", "high", "close")
    path = F.when(F.col("close") >= F.col("open"), up).otherwise(F.array("open", "high", "low", "close"))
    return m.daily_bars(spark, sf).select("symbol", "ts", F.posexplode(path).alias("step", "price")).withColumn("step", F.col("step").cast("bigint"))


@R.query(CONFIG_SQL + ", t AS (SELECT config_id, sum(ret) AS total FROM returns GROUP BY config_id) SELECT quantile_cont(total, 0.5) AS median_total, count(*) FILTER (total > 0) / count(*) AS plateau_share, count(*) AS n_configs FROM t")
def plateau_share(spark: SparkSession, sf: str) -> DataFrame:
    """Median of the configurations and the share of them that gain."""
    t = config_returns(spark, sf).groupBy("config_id").agg(F.sum("ret").alias("total"))
    return t.agg(F.percentile("total", 0.5).alias("median_total"), (F.count_if(F.col("total") > 0) / F.count("*")).alias("plateau_share"), F.count("*").alias("n_configs"))


@R.query(CONFIG_SQL + """, y AS (SELECT config_id, year(obs_ix) AS year, sum(ret) AS ret FROM returns GROUP BY ALL), p AS (SELECT a.year, a.ret - b.ret AS d FROM y a JOIN y b USING (year) WHERE a.config_id = 0 AND b.config_id = 7), s AS (SELECT count(*) AS n, sum(d) AS s, sum(d * d) AS q FROM p)
SELECT n, s / n AS mean_difference, n > 1 AND s > 0 AND s * s * (n - 1) > n * n * (q - s * s / n) AS decided FROM s""")
def paired_decision(spark: SparkSession, sf: str) -> DataFrame:
    """Two configurations matched by year: decided where the mean difference exceeds its sample deviation."""
    y = config_returns(spark, sf).where("config_id IN (0, 7)").groupBy(F.year("obs_ix").alias("year")).agg(F.sum(F.when(F.col("config_id") == 0, F.col("ret"))).alias("a"), F.sum(F.when(F.col("config_id") == 7, F.col("ret"))).alias("b"))
    d = F.col("a") - F.col("b")
    s = y.where("a IS NOT NULL AND b IS NOT NULL").agg(F.count("*").alias("n"), F.sum(d).alias("s"), F.sum(d * d).alias("q"))
    n, t, q = F.col("n"), F.col("s"), F.col("q")
    return s.select("n", (t / n).alias("mean_difference"), ((n > 1) & (t > 0) & (t * t * (n - 1) > n * n * (q - t * t / n))).alias("decided"))
