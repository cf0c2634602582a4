"""Queries on accounts, admission, portfolios, regimes and studies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barline.functions import features as ft
from barline.plans.analytics_queries import MOVES, moves
from barline.plans.feature_queries import SMA, STD, TRADES_SQL, rule_signals, rule_trades
from barline.registry import Registry
from barline.sources import market as m

R = Registry()
D = f"WITH {m.DAILY_SQL} "
LAG = "OVER (PARTITION BY symbol ORDER BY ts)"


@R.query(TRADES_SQL + ", e AS (SELECT symbol, bar_ix, entry_price, stop_distance, floor(1000.0 / stop_distance / 0.001 + 1e-9) * 0.001 AS quantity FROM trades) SELECT symbol, bar_ix, quantity, quantity * entry_price AS notional, quantity > 0 AS tradable FROM e")
def position_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """A fixed risk over the stop distance, floored to the lot."""
    distances = rule_signals(spark, sf)[1].select("symbol", "bar_ix", "stop_distance")
    q = rule_trades(spark, sf)[1].join(distances, ["symbol", "bar_ix"]).withColumn("quantity", F.floor(1000.0 / F.col("stop_distance") / 0.001 + 1e-9) * 0.001)
    return q.select("symbol", "bar_ix", "quantity", (F.col("quantity") * F.col("entry_price")).alias("notional"), (F.col("quantity") > 0).alias("tradable"))


@R.query("WITH o AS (SELECT o_orderdate AS ts, o_orderkey AS id, o_orderpriority AS instrument, floor(o_totalprice / 50000) AS open_risk, row_number() OVER (PARTITION BY o_orderdate ORDER BY o_orderpriority, o_orderkey) AS place FROM orders) SELECT ts, id, place <= greatest(0, floor((6 - (open_risk % 3)) / 2)) AS admitted FROM o")
def admission(spark: SparkSession, sf: str) -> DataFrame:
    """Requests of one time in canonical order, admitted while equal risks fit below the cap."""
    o = m.read(spark, sf, "orders")
    place = F.row_number().over(Window.partitionBy("o_orderdate").orderBy("o_orderpriority", "o_orderkey"))
    room = F.floor((6 - F.floor(F.col("o_totalprice") / 50000) % 3) / 2)
    return o.select(F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("id"), (place <= F.greatest(F.lit(0), room)).alias("admitted"))


@R.query("""WITH f AS (SELECT l_suppkey AS account, l_partkey % 5 AS instrument, l_shipdate AS ts, l_orderkey, l_linenumber, l_partkey, l_extendedprice, CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS signed, floor(l_extendedprice) AS paid FROM lineitem),
r AS (SELECT account, instrument, ts, signed, sum(signed) OVER w AS position, sum(CASE WHEN signed > 0 THEN -paid ELSE paid END) OVER w AS cash FROM f WINDOW w AS (PARTITION BY account, instrument ORDER BY ts, l_orderkey, l_linenumber, l_partkey, l_extendedprice ROWS UNBOUNDED PRECEDING))
SELECT account, instrument, count(*) AS n_fills, max(position) AS peak, min(position) AS trough, min(cash) AS least_cash, sum((position = 0)::BIGINT)::BIGINT AS n_flat FROM r GROUP BY ALL""")
def fills_to_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Positions and cash rebuilt from fills, by running sums."""
    f = m.read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("account"), (F.col("l_partkey") % 5).alias("instrument"), F.col("l_shipdate").alias("ts"), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("signed"), F.floor("l_extendedprice").cast("double").alias("paid"))
    w = Window.partitionBy("account", "instrument").orderBy("ts", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").rowsBetween(Window.unboundedPreceding, 0)
    r = f.withColumn("position", F.sum("signed").over(w)).withColumn("cash", F.sum(F.when(F.col("signed") > 0, -F.col("paid")).otherwise(F.col("paid"))).over(w))
    return r.groupBy("account", "instrument").agg(F.count("*").alias("n_fills"), F.max("position").alias("peak"), F.min("position").alias("trough"), F.min("cash").alias("least_cash"), F.sum((F.col("position") == 0).cast("bigint")).alias("n_flat"))


@R.query(MOVES + f""", x AS (SELECT symbol, ts, ret, abs(ret) AS size, lag(ret) {LAG} AS before FROM moves WHERE ret IS NOT NULL), d AS (SELECT *, ntile(10) OVER (PARTITION BY symbol ORDER BY before, ts) AS decile FROM x WHERE before IS NOT NULL)
SELECT symbol, decile, count(*) AS n, sum(ret) AS total, max(size) AS widest, sum((ret > 0)::BIGINT)::BIGINT AS n_up FROM d GROUP BY ALL""")
def regime_deciles(spark: SparkSession, sf: str) -> DataFrame:
    """Moves by decile of the move before."""
    x = moves(spark, sf).where("ret IS NOT NULL").withColumn("before", F.lag("ret").over(ft.order())).where("before IS NOT NULL")
    d = x.withColumn("decile", F.ntile(10).over(Window.partitionBy("symbol").orderBy("before", "ts")).cast("bigint"))
    return d.groupBy("symbol", "decile").agg(F.count("*").alias("n"), F.sum("ret").alias("total"), F.max(F.abs("ret")).alias("widest"), F.sum((F.col("ret") > 0).cast("bigint")).alias("n_up"))


@R.query(D + f""", f AS (SELECT symbol, ts, close, {SMA('close', 20)} AS mean, {STD('close', 20)} AS dev, lead(close, 5) {LAG} AS later FROM bars), b AS (SELECT symbol, later - close AS forward, close > mean + 2 * dev AS up, close < mean - 2 * dev AS down FROM f WHERE dev > 0 AND later IS NOT NULL)
SELECT symbol, CASE WHEN up THEN 'up' WHEN down THEN 'down' ELSE 'inside' END AS state, count(*) AS n, sum(forward) AS total, sum((forward > 0)::BIGINT)::BIGINT AS n_up FROM b GROUP BY ALL""")
def event_study(spark: SparkSession, sf: str) -> DataFrame:
    """Moves in the five bars after a break of the bands (a label, so it may look ahead)."""
    c = F.col("close")
    f = m.daily_bars(spark, sf).withColumns({"mean": ft.sma(c, 20), "dev": ft.std(c, 20), "later": F.lead("close", 5).over(ft.order())}).where("dev > 0 AND later IS NOT NULL")
    state = F.when(c > F.col("mean") + 2 * F.col("dev"), "up").when(c < F.col("mean") - 2 * F.col("dev"), "down").otherwise("inside")
    forward = F.col("later") - c
    return f.groupBy("symbol", state.alias("state")).agg(F.count("*").alias("n"), F.sum(forward).alias("total"), F.sum((forward > 0).cast("bigint")).alias("n_up"))


@R.query(MOVES + """, q AS (SELECT symbol, year(ts) * 10 + quarter(ts) AS quarter, count(*) AS n, max(abs(ret)) AS widest FROM moves WHERE ret IS NOT NULL GROUP BY ALL), r AS (SELECT *, widest <= quantile_cont(widest, 0.5) OVER (PARTITION BY quarter) AS calm FROM q)
SELECT quarter, count(*) FILTER (calm) AS n_calm, count(*) FILTER (NOT calm) AS n_wild, max(widest) FILTER (calm) AS calm_widest FROM r GROUP BY quarter""")
def volatility_split(spark: SparkSession, sf: str) -> DataFrame:
    """Series of each quarter at or below its median width."""
    q = moves(spark, sf).where("ret IS NOT NULL").groupBy("symbol", (F.year("ts") * 10 + F.quarter("ts")).cast("bigint").alias("quarter")).agg(F.max(F.abs("ret")).alias("widest"))
    r = q.withColumn("calm", F.col("widest") <= F.percentile("widest", 0.5).over(Window.partitionBy("quarter")))
    return r.groupBy("quarter").agg(F.count_if("calm").alias("n_calm"), F.count_if(~F.col("calm")).alias("n_wild"), F.max(F.when(F.col("calm"), F.col("widest"))).alias("calm_widest"))


@R.query(TRADES_SQL + ", y AS (SELECT symbol, bar_ix // 250 AS era, outcome FROM trades) SELECT symbol, era, count(*) AS n, count(*) FILTER (outcome = 'stop') AS stop, count(*) FILTER (outcome = 'target') AS target, count(*) FILTER (outcome = 'timeout') AS timeout FROM y GROUP BY ALL")
def outcome_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Outcomes by era, one column each."""
    y = rule_trades(spark, sf)[1].withColumn("era", F.floor(F.col("bar_ix") / 250).cast("bigint"))
    p = y.groupBy("symbol", "era").pivot("outcome", ["stop", "target", "timeout"]).count().na.fill(0, ["stop", "target", "timeout"])
    return p.withColumn("n", F.col("stop") + F.col("target") + F.col("timeout"))


@R.query("""SELECT l_orderkey AS trial, bit_or(1::BIGINT << (l_partkey % 12)) AS bits, count(DISTINCT l_partkey % 12) AS n FROM lineitem GROUP BY l_orderkey""")
def feature_bit_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct categories of each trial as a bit set."""
    bit = F.expr("shiftleft(1L, cast(l_partkey % 12 as int))")
    return m.read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("trial")).agg(F.bit_or(bit).alias("bits"), F.count_distinct(F.col("l_partkey") % 12).alias("n"))


@R.query("SELECT least(greatest(floor(o_totalprice / 40000), 0), 9)::BIGINT AS bin_value, least(greatest(floor(log10(o_totalprice)), 2), 5)::BIGINT AS bin_log, count(*) AS n, arg_min(o_orderkey, (-o_totalprice, o_orderkey)) AS best FROM orders GROUP BY ALL")
def archive_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of clamped linear and logarithmic bins with the best trial of each."""
    p = F.col("o_totalprice")
    clamp = lambda x, a, b: F.least(F.greatest(x, F.lit(a)), F.lit(b)).cast("bigint")
    return m.read(spark, sf, "orders").groupBy(clamp(F.floor(p / 40000), 0, 9).alias("bin_value"), clamp(F.floor(F.log10(p)), 2, 5).alias("bin_log")).agg(F.count("*").alias("n"), F.min_by("o_orderkey", F.struct(-p, "o_orderkey")).alias("best"))


@R.query(D + f""", f AS (SELECT symbol, ts, close, volume, lag(volume) {LAG} AS before, median(volume) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS usual FROM bars)
SELECT symbol, ts, volume / NULLIF(usual, 0) AS relative_volume, dayofweek(ts)::BIGINT AS weekday, coalesce(volume > before, false) AS rising FROM f""")
def relative_volume(spark: SparkSession, sf: str) -> DataFrame:
    w = ft.order().rowsBetween(-20, -1)
    weekday = F.dayofweek("ts").cast("bigint") - 1
    return m.daily_bars(spark, sf).select("symbol", "ts", F.try_divide("volume", F.nullif(F.percentile("volume", 0.5).over(w), F.lit(0.0))).alias("relative_volume"), weekday.alias("weekday"), F.coalesce(F.col("volume") > F.lag("volume").over(ft.order()), F.lit(False)).alias("rising"))


@R.query(D + """, a AS (SELECT symbol, ts, close, date_trunc('month', ts)::TIMESTAMP AS month FROM bars), k AS (SELECT symbol, month, last(close ORDER BY ts) AS close FROM a GROUP BY ALL), s AS (SELECT symbol, month, sign(close - lag(close, 3) OVER (PARTITION BY symbol ORDER BY month)) AS side, lead(close) OVER (PARTITION BY symbol ORDER BY month) - close AS forward FROM k)
SELECT month, sum(side * forward) AS gain, sum((side > 0)::BIGINT)::BIGINT AS n_long, count(*) AS n FROM s WHERE side IS NOT NULL AND forward IS NOT NULL GROUP BY month""")
def monthly_momentum(spark: SparkSession, sf: str) -> DataFrame:
    """Sign of the three-month move held for the next month, over all symbols."""
    k = m.daily_bars(spark, sf).groupBy("symbol", F.date_trunc("month", "ts").cast("timestamp_ntz").alias("month")).agg(F.max_by("close", "ts").alias("close"))
    w = Window.partitionBy("symbol").orderBy("month")
    s = k.select("month", F.signum(F.col("close") - F.lag("close", 3).over(w)).alias("side"), (F.lead("close").over(w) - F.col("close")).alias("forward")).where("side IS NOT NULL AND forward IS NOT NULL")
    return s.groupBy("month").agg(F.sum(F.col("side") * F.col("forward")).alias("gain"), F.sum((F.col("side") > 0).cast("bigint")).alias("n_long"), F.count("*").alias("n"))
