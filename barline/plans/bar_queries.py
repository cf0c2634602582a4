"""Queries on sources, bars, gaps and alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barline.functions import features as ft
from barline.registry import Registry
from barline.sources import market as m

R = Registry()
D, H = f"WITH {m.DAILY_SQL} ", f"WITH {m.HOURLY_SQL} "


@R.query(D + "SELECT symbol, ts, open, high, low, close, volume FROM bars")
def bars_daily(spark: SparkSession, sf: str) -> DataFrame:
    return m.daily_bars(spark, sf)


@R.query(H + "SELECT symbol, ts, open, high, low, close, volume FROM hours")
def bars_hourly(spark: SparkSession, sf: str) -> DataFrame:
    return m.hourly_bars(spark, sf)


@R.query(H + """SELECT symbol, time_bucket(INTERVAL 4 HOURS, ts, TIMESTAMP '1970-01-01') AS ts, first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low,
  last(close ORDER BY ts) AS close, sum(volume) AS volume FROM hours h GROUP BY symbol, time_bucket(INTERVAL 4 HOURS, h.ts, TIMESTAMP '1970-01-01')""")
def bars_resample_4h(spark: SparkSession, sf: str) -> DataFrame:
    return m.resample(m.hourly_bars(spark, sf), F.window("ts", "4 hours").start.cast("timestamp_ntz"))


@R.query(D + "SELECT symbol, date_trunc('week', ts)::TIMESTAMP AS ts, first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY ts) AS close, sum(volume) AS volume FROM bars b GROUP BY symbol, date_trunc('week', b.ts)::TIMESTAMP")
def bars_resample_weekly(spark: SparkSession, sf: str) -> DataFrame:
    return m.resample(m.daily_bars(spark, sf), F.date_trunc("week", "ts").cast("timestamp_ntz"))


@R.query(D + """, weeks AS (SELECT symbol, date_trunc('week', ts)::TIMESTAMP + INTERVAL 7 DAYS AS known_ts, last(close ORDER BY ts) AS week_close FROM bars b GROUP BY symbol, date_trunc('week', b.ts)::TIMESTAMP)
SELECT b.symbol, b.ts, b.close, w.week_close, w.known_ts FROM bars b ASOF LEFT JOIN weeks w ON b.symbol = w.symbol AND b.ts >= w.known_ts""")
def asof_higher_timeframe(spark: SparkSession, sf: str) -> DataFrame:
    """Last weekly close that was known at each daily bar."""
    d = m.daily_bars(spark, sf)
    w = m.resample(d, F.date_trunc("week", "ts").cast("timestamp_ntz")).select("symbol", (F.col("ts") + F.expr("INTERVAL 7 DAYS")).alias("known_ts"), F.col("close").alias("week_close"))
    return asof_backward(d.select("symbol", "ts", "close"), w, "known_ts", ["week_close"])


def asof_backward(left: DataFrame, right: DataFrame, right_ts: str, values: list[str]) -> DataFrame:
    """Each left row with the values and time of the last right row at or before it, by symbol.

    A union sorted once by time: no range join, and one shuffle by symbol.
    """
    own = left.columns
    a = left.select(*own, F.lit(1).alias("__side"), *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in [*values, right_ts]])
    b = right.select(*[F.col(right_ts).alias(c) if c == "ts" else (F.col(c) if c == "symbol" else F.lit(None).cast(left.schema[c].dataType).alias(c)) for c in own], F.lit(0).alias("__side"), *values, right_ts)
    w = Window.partitionBy("symbol").orderBy("ts", "__side").rowsBetween(Window.unboundedPreceding, 0)
    held = F.last(F.when(F.col("__side") == 0, F.struct(*values, right_ts)), ignorenulls=True).over(w)
    return a.unionByName(b).withColumn("__held", held).where("__side = 1").select(*own, *[F.col(f"__held.{c}").alias(c) for c in [*values, right_ts]])


@R.query(H + """, g AS (SELECT symbol, ts, lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS before FROM hours)
SELECT symbol, before AS gap_after, ts AS gap_before, (epoch(ts) - epoch(before))::BIGINT // 3600 - 1 AS missing FROM g WHERE ts - before > INTERVAL 1 HOUR""")
def grid_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Holes of the hourly grid."""
    g = m.hourly_bars(spark, sf).select("symbol", "ts", F.lag("ts").over(ft.order()).alias("before"))
    hours = ((F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.col("before").cast("timestamp"))) / 3600).cast("bigint")
    return g.where(hours > 1).select("symbol", F.col("before").alias("gap_after"), F.col("ts").alias("gap_before"), (hours - 1).alias("missing"))


@R.query(H + """, e AS (SELECT symbol, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_bars FROM hours GROUP BY symbol)
SELECT symbol, first_ts, last_ts, n_bars, (epoch(last_ts) - epoch(first_ts))::BIGINT // 3600 + 1 - n_bars AS n_missing,
  (SELECT max(first_ts) FROM e) AS common_start, (SELECT min(last_ts) FROM e) AS common_end FROM e""")
def coverage_report(spark: SparkSession, sf: str) -> DataFrame:
    e = m.hourly_bars(spark, sf).groupBy("symbol").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n_bars"))
    common = e.agg(F.max("first_ts").alias("common_start"), F.min("last_ts").alias("common_end"))
    hours = ((F.unix_timestamp(F.col("last_ts").cast("timestamp")) - F.unix_timestamp(F.col("first_ts").cast("timestamp"))) / 3600).cast("bigint")
    return e.crossJoin(F.broadcast(common)).select("symbol", "first_ts", "last_ts", "n_bars", (hours + 1 - F.col("n_bars")).alias("n_missing"), "common_start", "common_end")


@R.query(H + """, axis AS (SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM hours GROUP BY symbol)
SELECT a.symbol, a.ts, last_value(h.close IGNORE NULLS) OVER (PARTITION BY a.symbol ORDER BY a.ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS close, h.close IS NULL AS filled
FROM axis a LEFT JOIN hours h ON a.symbol = h.symbol AND a.ts = h.ts""")
def forward_fill(spark: SparkSession, sf: str) -> DataFrame:
    h = m.hourly_bars(spark, sf)
    axis = h.groupBy("symbol").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select("symbol", F.explode(F.expr("sequence(a, b, INTERVAL 1 HOUR)")).alias("ts"))
    return axis.join(h.select("symbol", "ts", "close"), ["symbol", "ts"], "left").select("symbol", "ts", ft.fill_forward(F.col("close")).alias("close"), F.col("close").isNull().alias("filled"))


@R.query(H + """, axis AS (SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM hours GROUP BY symbol),
miss AS (SELECT a.symbol, a.ts FROM axis a ANTI JOIN hours h ON a.symbol = h.symbol AND a.ts = h.ts),
runs AS (SELECT symbol, ts, (epoch(ts)::BIGINT // 3600) - row_number() OVER (PARTITION BY symbol ORDER BY ts) AS island FROM miss)
SELECT symbol, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n, count(*) <= 3 AS fillable FROM runs GROUP BY symbol, island""")
def missing_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of missing hours (gaps and islands), and whether they are short enough to fill."""
    h = m.hourly_bars(spark, sf)
    axis = h.groupBy("symbol").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select("symbol", F.explode(F.expr("sequence(a, b, INTERVAL 1 HOUR)")).alias("ts"))
    miss = axis.join(h.select("symbol", "ts"), ["symbol", "ts"], "left_anti")
    island = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600) - F.row_number().over(ft.order())
    return miss.withColumn("island", island).groupBy("symbol", "island").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("n")).select("symbol", "start_ts", "end_ts", "n", (F.col("n") <= 3).alias("fillable"))


@R.query(D + "SELECT symbol, ts, lead(ts::DATE) OVER (PARTITION BY symbol ORDER BY ts) IS DISTINCT FROM ts::DATE AS day_end, year(ts) * 100 + month(ts) AS month_key, year(ts) * 10 + quarter(ts) - 1 AS quarter_key, isoyear(ts) * 100 + weekofyear(ts) AS week_key FROM bars")
def period_keys(spark: SparkSession, sf: str) -> DataFrame:
    day = F.to_date("ts")
    return m.daily_bars(spark, sf).select(
        "symbol",
        "ts",
        (~F.lead(day).over(ft.order()).eqNullSafe(day)).alias("day_end"),
        (F.year("ts") * 100 + F.month("ts")).cast("bigint").alias("month_key"),
        (F.year("ts") * 10 + F.quarter("ts") - 1).cast("bigint").alias("quarter_key"),
        (F.expr("extract(YEAROFWEEK FROM ts)") * 100 + F.weekofyear("ts")).cast("bigint").alias("week_key"),
    )


@R.query(H + """, r AS (SELECT symbol, ts, close / NULLIF(lag(close) OVER (PARTITION BY symbol ORDER BY ts), 0) AS growth FROM hours)
SELECT symbol, (date_trunc('day', ts - INTERVAL 1 MICROSECOND) + INTERVAL 1 DAY)::TIMESTAMP AS day, count(growth) AS n, min(growth) AS worst, max(growth) AS best FROM r WHERE growth IS NOT NULL GROUP BY ALL""")
def daily_return_clock(spark: SparkSession, sf: str) -> DataFrame:
    """Growth factors on the UTC-day clock, days labelled by their end."""
    r = m.hourly_bars(spark, sf).select("symbol", "ts", F.try_divide(F.col("close"), F.nullif(F.lag("close").over(ft.order()), F.lit(0.0))).alias("growth")).where(F.col("growth").isNotNull())
    day = (F.date_trunc("day", F.col("ts") - F.expr("INTERVAL 1 MICROSECOND")) + F.expr("INTERVAL 1 DAY")).cast("timestamp_ntz")
    return r.groupBy("symbol", day.alias("day")).agg(F.count("growth").alias("n"), F.min("growth").alias("worst"), F.max("growth").alias("best"))


@R.query(D + ", cut AS (SELECT symbol, max(ts) - INTERVAL 365 DAYS AS cut FROM bars GROUP BY symbol) SELECT b.symbol, CASE WHEN b.ts < c.cut THEN 'in_sample' ELSE 'holdout' END AS part, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM bars b JOIN cut c USING (symbol) GROUP BY ALL")
def holdout_carve(spark: SparkSession, sf: str) -> DataFrame:
    b = m.daily_bars(spark, sf)
    cut = F.max("ts").over(Window.partitionBy("symbol")) - F.expr("INTERVAL 365 DAYS")
    return b.withColumn("cut", cut).groupBy("symbol", F.when(F.col("ts") < F.col("cut"), "in_sample").otherwise("holdout").alias("part")).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@R.query(D + """, cut AS (SELECT symbol, max(ts) - INTERVAL 90 DAYS AS cut FROM bars GROUP BY symbol),
n AS (SELECT b.*, c.cut, row_number() OVER (PARTITION BY b.symbol, b.ts < c.cut ORDER BY b.ts DESC) AS back FROM bars b JOIN cut c USING (symbol))
SELECT symbol, ts, close, ts >= cut AS evaluated, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS bar_ix FROM n WHERE ts >= cut OR back <= 50""")
def evaluation_bars(spark: SparkSession, sf: str) -> DataFrame:
    """The holdout with the last 50 bars before it as warm-up, bars numbered anew."""
    b = m.daily_bars(spark, sf).withColumn("cut", F.max("ts").over(Window.partitionBy("symbol")) - F.expr("INTERVAL 90 DAYS"))
    back = F.row_number().over(Window.partitionBy("symbol", F.col("ts") < F.col("cut")).orderBy(F.desc("ts")))
    kept = b.withColumn("back", back).where((F.col("ts") >= F.col("cut")) | (F.col("back") <= 50))
    return kept.select("symbol", "ts", "close", (F.col("ts") >= F.col("cut")).alias("evaluated"), (F.row_number().over(ft.order()) - 1).cast("bigint").alias("bar_ix"))


@R.query("""WITH t AS (SELECT l_returnflag || l_linestatus AS symbol, l_shipdate::DATE AS day, l_orderkey % 2 AS vendor, max(floor(l_extendedprice * 100 / l_quantity)) AS high FROM lineitem GROUP BY ALL)
SELECT a.symbol, count(*) AS n_common, sum((a.high = b.high)::BIGINT)::BIGINT AS n_equal, max(abs(a.high - b.high)) AS worst FROM t a JOIN t b ON a.symbol = b.symbol AND a.day = b.day AND a.vendor = 0 AND b.vendor = 1 GROUP BY a.symbol""")
def second_source_check(spark: SparkSession, sf: str) -> DataFrame:
    """Two vendors on their common days."""
    t = m.read(spark, sf, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("symbol"), F.to_date("l_shipdate").alias("day"), (F.col("l_orderkey") % 2).alias("vendor")).agg(F.max(F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity")).cast("double")).alias("high"))
    both = t.groupBy("symbol", "day").agg(F.max(F.when(F.col("vendor") == 0, F.col("high"))).alias("a"), F.max(F.when(F.col("vendor") == 1, F.col("high"))).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    return both.groupBy("symbol").agg(F.count("*").alias("n_common"), F.sum((F.col("a") == F.col("b")).cast("bigint")).alias("n_equal"), F.max(F.abs(F.col("a") - F.col("b"))).alias("worst"))


@R.query(D + ", y AS (SELECT symbol, ts, close * volume AS traded FROM bars), q AS (SELECT symbol, quantile_cont(traded, 0.5) AS median_traded FROM y GROUP BY symbol) SELECT symbol, median_traded, row_number() OVER (ORDER BY median_traded DESC, symbol) AS place FROM q QUALIFY place <= 4")
def universe_top(spark: SparkSession, sf: str) -> DataFrame:
    q = m.daily_bars(spark, sf).groupBy("symbol").agg(F.percentile(F.col("close") * F.col("volume"), 0.5).alias("median_traded"))
    return q.withColumn("place", F.row_number().over(Window.orderBy(F.desc("median_traded"), "symbol")).cast("bigint")).where("place <= 4")


@R.query(H + """, t AS (SELECT symbol, date_trunc('day', ts)::TIMESTAMP AS bar, (epoch(ts)::BIGINT // 3600) % 24 AS minute, low, high FROM hours),
x AS (SELECT *, min(low) OVER w AS low_before, max(high) OVER w AS high_before FROM t WINDOW w AS (PARTITION BY symbol, bar ORDER BY minute ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT symbol, bar, 0 AS side, minute, low AS price FROM x WHERE low_before IS NULL OR low < low_before
UNION ALL SELECT symbol, bar, 1 AS side, minute, high AS price FROM x WHERE high_before IS NULL OR high > high_before""")
def path_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Within each day, the hours that set a new low or a new high: enough to tell the first touch of any level."""
    t = m.hourly_bars(spark, sf).select("symbol", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("bar"), F.hour("ts").cast("bigint").alias("minute"), "low", "high")
    before = Window.partitionBy("symbol", "bar").orderBy("minute").rowsBetween(Window.unboundedPreceding, -1)
    x = t.withColumn("low_before", F.min("low").over(before)).withColumn("high_before", F.max("high").over(before))
    lows = x.where("low_before IS NULL OR low < low_before").select("symbol", "bar", F.lit(0).alias("side"), "minute", F.col("low").alias("price"))
    highs = x.where("high_before IS NULL OR high > high_before").select("symbol", "bar", F.lit(1).alias("side"), "minute", F.col("high").alias("price"))
    return lows.unionByName(highs)


@R.query(H + """, t AS (SELECT symbol, date_trunc('day', ts)::TIMESTAMP AS bar, (epoch(ts)::BIGINT // 3600) % 24 AS minute, low, high, first(open) OVER (PARTITION BY symbol, date_trunc('day', ts) ORDER BY ts) AS day_open FROM hours)
SELECT symbol, bar, min(minute) FILTER (low <= day_open * 0.5) AS stop_minute, min(minute) FILTER (high >= day_open * 1.5) AS target_minute,
 coalesce(min(minute) FILTER (low <= day_open * 0.5) <= min(minute) FILTER (high >= day_open * 1.5), min(minute) FILTER (low <= day_open * 0.5) IS NOT NULL) AS stop_first FROM t GROUP BY symbol, bar""")
def first_touch(spark: SparkSession, sf: str) -> DataFrame:
    """First hour of a day that touches a stop or a target around its open; the stop wins a tie."""
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    t = m.hourly_bars(spark, sf).withColumn("bar", day).withColumn("day_open", F.first("open").over(Window.partitionBy("symbol", "bar").orderBy("ts"))).withColumn("minute", F.hour("ts").cast("bigint"))
    g = t.groupBy("symbol", "bar").agg(F.min(F.when(F.col("low") <= F.col("day_open") * 0.5, F.col("minute"))).alias("stop_minute"), F.min(F.when(F.col("high") >= F.col("day_open") * 1.5, F.col("minute"))).alias("target_minute"))
    return g.withColumn("stop_first", F.coalesce(F.col("stop_minute") <= F.col("target_minute"), F.col("stop_minute").isNotNull()))


@R.query("""WITH c AS (SELECT c_custkey, c_acctbal, CASE WHEN abs(c_acctbal) <= 1000 THEN 1 WHEN abs(c_acctbal) <= 5000 THEN 2 ELSE 3 END AS tier FROM customer)
SELECT c_custkey, tier::BIGINT AS tier, CASE tier WHEN 1 THEN 50 WHEN 2 THEN 20 ELSE 10 END::BIGINT AS max_leverage FROM c""")
def margin_tier_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The first tier whose cap holds a notional; a fixed table of three rows is broadcast."""
    tiers = spark.createDataFrame([(1, 1000.0, 50), (2, 5000.0, 20), (3, 1e18, 10)], "tier bigint, cap double, max_leverage bigint")
    c = m.read(spark, sf, "customer").select("c_custkey", F.abs("c_acctbal").alias("notional"))
    j = c.join(F.broadcast(tiers), F.col("notional") <= F.col("cap"))
    return j.groupBy("c_custkey").agg(F.min_by(F.struct("tier", "max_leverage"), "cap").alias("t")).select("c_custkey", "t.tier", "t.max_leverage")


@R.query("""SELECT e.event_id, (epoch_us(e.ts) // 14400000000)::BIGINT AS bar_ix, ((epoch_us(e.ts) + 30000000) // 60000000)::BIGINT AS settle_minute FROM events e""")
def settlement_to_bar(spark: SparkSession, sf: str) -> DataFrame:
    """Events onto four-hour bars and nearest minutes by a bucket key: an equi-join key instead of a range join."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return m.read(spark, sf, "events").select("event_id", F.floor(micros / 14_400_000_000).cast("bigint").alias("bar_ix"), F.floor((micros + 30_000_000) / 60_000_000).cast("bigint").alias("settle_minute"))


@R.query("SELECT sha256(string_agg(symbol || '|' || day || '|' || n, ';' ORDER BY symbol, day)) AS content_id, count(*) AS n_rows FROM (SELECT l_returnflag || l_linestatus AS symbol, strftime(l_shipdate, '%Y-%m') AS day, count(*) AS n FROM lineitem GROUP BY ALL)")
def content_identity(spark: SparkSession, sf: str) -> DataFrame:
    """A content address: hash of the sorted canonical rows of a monthly summary."""
    g = m.read(spark, sf, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("symbol"), F.date_format("l_shipdate", "yyyy-MM").alias("day")).agg(F.count("*").alias("n"))
    rows = F.array_sort(F.collect_list(F.struct("symbol", "day", "n")))
    text = F.array_join(F.transform(rows, lambda r: F.concat_ws("|", r["symbol"], r["day"], r["n"].cast("string"))), ";")
    return g.agg(F.sha2(text, 256).alias("content_id"), F.count("*").alias("n_rows"))
