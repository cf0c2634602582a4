"""Queries on cuts, fills, settlements, panels and bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barline.functions import features as ft
from barline.operators import alignment as al
from barline.operators import chunks as ck
from barline.operators.asof import asof_join
from barline.registry import Registry
from barline.sources import market as m

R = Registry()
D, H = f"WITH {m.DAILY_SQL} ", f"WITH {m.HOURLY_SQL} "
LAG = "OVER (PARTITION BY symbol ORDER BY ts)"
_BARS = "first(price ORDER BY stamp, event_id) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY stamp, event_id) AS close, count(*)::DOUBLE AS volume"
#: Two series of hourly bars: trades are events of even, marks those of odd numbers.
TWO = f"""WITH parts AS (SELECT event_type AS symbol, date_trunc('hour', ts)::TIMESTAMP AS slot, ts AS stamp, event_id, event_id % 2 AS kind, floor(value * 100) AS price, value FROM events),
trades AS (SELECT symbol, slot AS ts, {_BARS} FROM parts WHERE kind = 0 GROUP BY symbol, slot), marks AS (SELECT symbol, slot AS ts, {_BARS} FROM parts WHERE kind = 1 GROUP BY symbol, slot)"""


def two_series(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    ticks = m.event_ticks(spark, sf)
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    return tuple(m.bars(ticks.where(F.col("seq.event_id") % 2 == k), hour) for k in (0, 1))


@R.query("""WITH t AS (SELECT event_type AS symbol, time_bucket(INTERVAL 4 HOURS, ts, TIMESTAMP '1970-01-01') AS slot, ts AS stamp, event_id, floor(value * 100) AS bid, floor(value * 100) + 1 + event_id % 3 AS ask FROM events)
SELECT symbol, slot AS ts, first(bid ORDER BY stamp, event_id) AS bid_open, max(bid) AS bid_high, min(bid) AS bid_low, last(bid ORDER BY stamp, event_id) AS bid_close, first(ask ORDER BY stamp, event_id) AS ask_open, max(ask) AS ask_high, min(ask) AS ask_low, last(ask ORDER BY stamp, event_id) AS ask_close, count(*) AS n_ticks FROM t GROUP BY symbol, slot""")
def quote_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Bid and ask bars with the number of ticks."""
    t = m.event_ticks(spark, sf).withColumns({"bid": F.col("price"), "ask": F.col("price") + 1 + F.col("seq.event_id") % 3})
    return al.quotes(t, F.window("ts", "4 hours").start.cast("timestamp_ntz"))


@R.query(D + f", n AS (SELECT symbol, ts, close, ts + INTERVAL 1 DAY AS close_ts FROM bars) SELECT symbol, ts, close, CASE WHEN close_ts <= TIMESTAMP '1996-01-01' THEN 'in_sample' ELSE 'holdout' END AS part, row_number() OVER (PARTITION BY symbol, close_ts <= TIMESTAMP '1996-01-01' ORDER BY ts) - 1 AS bar_ix FROM n WHERE close_ts > TIMESTAMP '1993-01-01' AND close_ts <= TIMESTAMP '1998-01-01'")
def carved_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Bars that close within a window, carved at a date by their close; each part numbers its bars anew."""
    close_ts = F.col("ts") + F.expr("INTERVAL 1 DAY")
    inside = al.between(m.daily_bars(spark, sf), F.expr("TIMESTAMP_NTZ '1993-01-01'"), F.expr("TIMESTAMP_NTZ '1998-01-01'"), close_ts)
    early, late = al.carve(inside, F.expr("TIMESTAMP_NTZ '1996-01-01'"), close_ts)
    part = lambda d, name: d.select("symbol", "ts", "close", F.lit(name).alias("part"), (F.row_number().over(ft.order()) - 1).cast("bigint").alias("bar_ix"))
    return part(early, "in_sample").unionByName(part(late, "holdout"))


@R.query("""WITH c AS (SELECT c_custkey, min(o_orderdate)::DATE AS first_day, max(o_orderdate)::DATE AS last_day FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)
SELECT c_custkey, (first_day + INTERVAL 6 MONTHS)::DATE::VARCHAR AS holdout_start, (first_day + INTERVAL 9 MONTHS)::DATE::VARCHAR AS holdout_end, date_diff('day', (first_day + INTERVAL 6 MONTHS)::DATE, (first_day + INTERVAL 9 MONTHS)::DATE) >= 28 AS long_enough, last_day < (first_day + INTERVAL 6 MONTHS)::DATE AS clean FROM c""")
def holdout_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Holdouts by months, whether they hold 28 days, and whether nothing that was looked at reaches into them."""
    o = m.read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min(F.to_date("o_orderdate")).alias("first_day"), F.max(F.to_date("o_orderdate")).alias("last_day"))
    a, b = F.add_months("first_day", 6), F.add_months("first_day", 9)
    return o.select("c_custkey", a.cast("string").alias("holdout_start"), b.cast("string").alias("holdout_end"), (F.datediff(b, a) >= 28).alias("long_enough"), (F.col("last_day") < a).alias("clean"))


@R.query(TWO + " SELECT symbol, ts, 'left' AS only_in FROM trades ANTI JOIN marks USING (symbol, ts) UNION ALL SELECT symbol, ts, 'right' FROM marks ANTI JOIN trades USING (symbol, ts)")
def misaligned_bars(spark: SparkSession, sf: str) -> DataFrame:
    """What keeps two series from lying on one axis."""
    return al.misaligned(*two_series(spark, sf), ["symbol", "ts"])


@R.query(TWO + " SELECT ts FROM trades UNION SELECT ts FROM marks")
def union_axis(spark: SparkSession, sf: str) -> DataFrame:
    return al.axis(*two_series(spark, sf))


@R.query(TWO + """, axis AS (SELECT s.symbol, t.ts FROM (SELECT DISTINCT symbol FROM marks) s, (SELECT DISTINCT ts FROM trades) t), last AS (SELECT symbol, slot AS ts, arg_max(price, (stamp, event_id)) AS sample FROM parts WHERE kind = 1 GROUP BY symbol, slot)
SELECT a.symbol, a.ts, coalesce(last_value(l.sample IGNORE NULLS) OVER (PARTITION BY a.symbol ORDER BY a.ts ROWS UNBOUNDED PRECEDING), -1.0) AS price FROM axis a LEFT JOIN last l ON l.symbol = a.symbol AND l.ts = a.ts""")
def samples_on_axis(spark: SparkSession, sf: str) -> DataFrame:
    """Sparse samples laid on another series' axis: the last of a time wins, then it is held; a seed comes before."""
    trades, marks = two_series(spark, sf)
    axis = marks.select("symbol").distinct().crossJoin(F.broadcast(trades.select("ts").distinct()))
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    samples = m.event_ticks(spark, sf).where(F.col("seq.event_id") % 2 == 1).select("symbol", hour.alias("ts"), "price", "seq")
    return al.on_axis(axis, samples, "seq", "price", -1.0)


@R.query(TWO + """, axis AS (SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM marks GROUP BY symbol), miss AS (SELECT symbol, ts FROM axis ANTI JOIN marks USING (symbol, ts)),
runs AS (SELECT symbol, ts, (epoch(ts)::BIGINT // 3600) - row_number() OVER (PARTITION BY symbol ORDER BY ts) AS island FROM miss), short AS (SELECT symbol, ts FROM runs QUALIFY count(*) OVER (PARTITION BY symbol, island) <= 2)
SELECT symbol, ts, open, high, low, close, volume, false AS filled FROM marks UNION ALL SELECT symbol, ts, open, high, low, close, 0.0, true FROM short JOIN trades USING (symbol, ts)""")
def filled_marks(spark: SparkSession, sf: str) -> DataFrame:
    """Short runs of missing marks filled from trade bars."""
    trades, marks = two_series(spark, sf)
    return al.fill_marks(marks, trades, "1 HOUR", 3600, 2)


FUNDING = TWO + f""", fourth AS (SELECT symbol, time_bucket(INTERVAL 4 HOURS, slot, TIMESTAMP '1970-01-01') AS ts, last(price ORDER BY stamp, event_id) AS close FROM parts GROUP BY symbol, time_bucket(INTERVAL 4 HOURS, slot, TIMESTAMP '1970-01-01')),
nb AS (SELECT symbol, ts, close, row_number() {LAG} - 1 AS bar_ix FROM fourth),
funding AS (SELECT p.symbol, n.bar_ix, p.stamp, p.value / 1000000 AS rate, k.close AS mark FROM parts p JOIN nb n ON n.symbol = p.symbol AND n.ts <= p.stamp AND p.stamp < n.ts + INTERVAL 4 HOURS LEFT JOIN marks k ON k.symbol = p.symbol AND k.ts = p.slot - INTERVAL 1 HOUR)"""


def settlements(spark: SparkSession, sf: str) -> DataFrame:
    """Each event as a settlement: symbol, stamp, rate."""
    return m.read(spark, sf, "events").select(F.col("event_type").alias("symbol"), F.col("ts").alias("stamp"), (F.col("value") / 1000000).alias("rate"))


def funding_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Four-hour bars of the events; each settlement falls in one of them."""
    return m.bars(m.event_ticks(spark, sf), F.window("ts", "4 hours").start.cast("timestamp_ntz"))


def funding(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Four-hour bars, and each event as a settlement at them."""
    bars = funding_bars(spark, sf)
    return bars, al.funding_rows(settlements(spark, sf), bars, two_series(spark, sf)[1], 14_400, 3600)


@R.query(FUNDING + " SELECT symbol, bar_ix, stamp, rate, mark FROM funding")
def funding_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Settlements with the bar in which they fall and the mark completed before."""
    return funding(spark, sf)[1]


@R.query(FUNDING + ", o AS (SELECT *, row_number() OVER (PARTITION BY symbol, bar_ix ORDER BY stamp) - 1 AS place FROM funding) SELECT symbol, bar_ix, place, stamp, rate, mark FROM o")
def settlements_in_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Settlements of each bar in order of time, packed as an array and read back with their places."""
    packed = al.packed_settlements(funding(spark, sf)[1])
    return packed.select("symbol", "bar_ix", F.posexplode("settlements").alias("place", "s")).select("symbol", "bar_ix", F.col("place").cast("bigint").alias("place"), "s.stamp", "s.rate", "s.mark")


@R.query("SELECT event_id, CASE WHEN epoch_us(ts) % 60000000 = 30000000 AND (epoch_us(ts) // 60000000) % 2 = 0 THEN epoch_us(ts) // 60000000 ELSE (epoch_us(ts) + 30000000) // 60000000 END AS minute, CASE WHEN o % 2 = 0 THEN o // 2 WHEN ((o - 1) // 2) % 2 = 0 THEN (o - 1) // 2 ELSE (o + 1) // 2 END AS half_even FROM (SELECT *, event_id AS o FROM events)")
def nearest_minutes(spark: SparkSession, sf: str) -> DataFrame:
    """Times to the nearest minute, and halves to the even number."""
    return m.read(spark, sf, "events").select("event_id", al.nearest_minute(F.col("ts")).alias("minute"), F.bround(F.col("event_id") / F.lit(2.0), 0).cast("bigint").alias("half_even"))


@R.query(FUNDING + ", part AS (SELECT symbol, bar_ix - 20 AS bar_ix, ts, close FROM nb WHERE bar_ix >= 20 AND bar_ix < 100), a AS (SELECT * FROM part WHERE bar_ix < 40), b AS (SELECT symbol, bar_ix - 40 AS bar_ix, ts, close FROM part WHERE bar_ix >= 40), k AS (SELECT symbol, max(bar_ix) + 1 AS n FROM a GROUP BY symbol) SELECT symbol, bar_ix, ts, close FROM a UNION ALL SELECT b.symbol, b.bar_ix + coalesce(k.n, 0), ts, close FROM b LEFT JOIN k USING (symbol)")
def sliced_and_joined(spark: SparkSession, sf: str) -> DataFrame:
    """A slice of numbered bars numbered anew, cut in two, and put together again with the numbers going on."""
    bars = funding(spark, sf)[0].select("symbol", "ts", "close", (F.row_number().over(ft.order()) - 1).cast("bigint").alias("bar_ix"))
    part = al.rebased(bars, 20, 100)
    return al.followed_by(al.rebased(part, 0, 40), al.rebased(part, 40, 1 << 40))


@R.query(H + """, d AS (SELECT symbol, date_trunc('day', ts)::TIMESTAMP AS day, last(close ORDER BY ts) AS close, sum(close * volume) AS traded FROM hours h GROUP BY symbol, date_trunc('day', h.ts)::TIMESTAMP), e AS (SELECT min(day) AS a, max(day) AS b FROM d),
every AS (SELECT s.symbol, unnest(generate_series(e.a, e.b, INTERVAL 1 DAY)) AS day FROM (SELECT DISTINCT symbol FROM hours) s, e), n AS (SELECT symbol, ts - INTERVAL 1 DAY AS day, close AS next_hour FROM hours WHERE hour(ts) = 0),
h2 AS (SELECT v.symbol, v.day, last_value(d.close IGNORE NULLS) OVER (PARTITION BY v.symbol ORDER BY v.day ROWS UNBOUNDED PRECEDING) AS close, n.next_hour, d.traded FROM every v LEFT JOIN d ON d.symbol = v.symbol AND d.day = v.day LEFT JOIN n ON n.symbol = v.symbol AND n.day = v.day)
SELECT symbol, day, close, coalesce(next_hour, close) AS fill, traded IS NOT NULL AS alive, coalesce(traded, 0.0) AS traded FROM h2""")
def daily_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Days by symbols: close, the price of the first hour after it, alive, traded value."""
    return al.panel(m.hourly_bars(spark, sf))


@R.query(H + f""", r AS (SELECT symbol, ts, close / NULLIF(lag(close) {LAG}, 0) - 1 AS ret FROM hours), g AS (SELECT symbol, (date_trunc('day', ts - INTERVAL 1 MICROSECOND) + INTERVAL 1 DAY)::TIMESTAMP AS day, count(*) AS n, max(ret) AS one, product(1 + ret) AS growth FROM r WHERE ret IS NOT NULL GROUP BY ALL)
SELECT symbol, day, CASE WHEN n = 1 THEN one ELSE growth - 1 END AS ret FROM g""")
def compounded_days(spark: SparkSession, sf: str) -> DataFrame:
    """Returns compounded on the UTC-day clock."""
    before = F.nullif(F.lag("close").over(ft.order()), F.lit(0.0))
    return al.daily_returns(m.hourly_bars(spark, sf).select("symbol", "ts", (F.try_divide("close", before) - 1).alias("ret")).where("ret IS NOT NULL"))


@R.query(D + ", w AS (SELECT * FROM bars WHERE dayofweek(ts) BETWEEN 1 AND 5), axis AS (SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS ts FROM w GROUP BY symbol) SELECT a.symbol, a.ts, last_value(w.close IGNORE NULLS) OVER (PARTITION BY a.symbol ORDER BY a.ts ROWS UNBOUNDED PRECEDING) AS close, w.close IS NULL AS held FROM axis a LEFT JOIN w ON w.symbol = a.symbol AND w.ts = a.ts")
def calendar_days(spark: SparkSession, sf: str) -> DataFrame:
    """Weekday bars on the full calendar; weekends hold the last close."""
    w = m.daily_bars(spark, sf).where(F.dayofweek("ts").between(2, 6))
    return al.grid(w, "1 DAY").join(w.select("symbol", "ts", "close"), ["symbol", "ts"], "left").select("symbol", "ts", ft.fill_forward(F.col("close")).alias("close"), F.col("close").isNull().alias("held"))


@R.query(D + """, span AS (SELECT min(ts)::DATE AS a, max(ts)::DATE AS b FROM bars), q AS (SELECT unnest(generate_series(date_trunc('quarter', a + INTERVAL 12 MONTHS - INTERVAL 1 DAY) + INTERVAL 3 MONTHS, b, INTERVAL 3 MONTHS))::TIMESTAMP AS test_start, b FROM span),
f AS (SELECT row_number() OVER (ORDER BY test_start) - 1 AS fold, test_start - INTERVAL 12 MONTHS AS train_start, test_start, test_start + INTERVAL 3 MONTHS AS test_end FROM q WHERE test_start + INTERVAL 3 MONTHS <= b)
SELECT f.fold, b.symbol, count(*) FILTER (b.ts < f.test_start) AS n_train, count(*) FILTER (b.ts >= f.test_start) AS n_test FROM f JOIN bars b ON b.ts >= f.train_start AND b.ts < f.test_end GROUP BY f.fold, b.symbol""")
def fold_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Walk-forward folds on calendar quarters and the bars of each; a bar joins its folds by quarter."""
    d = m.daily_bars(spark, sf)
    a, b = d.agg(F.min(F.to_date("ts")), F.max(F.to_date("ts"))).first()
    folds = al.fold_schedule(a, b, 12)
    rows = [(i, s.year * 4 + (s.month - 1) // 3 + k, k >= 0) for i, (_, s, _) in enumerate(folds) for k in range(-4, 1)]
    table = spark.createDataFrame(rows, "fold bigint, quarter int, test boolean")
    return d.withColumn("quarter", F.year("ts") * 4 + F.quarter("ts") - 1).join(F.broadcast(table), "quarter").groupBy("fold", "symbol").agg(F.count_if(~F.col("test")).alias("n_train"), F.count_if("test").alias("n_test"))


@R.query(H + """, four AS (SELECT symbol, time_bucket(INTERVAL 4 HOURS, ts, TIMESTAMP '1970-01-01') AS slot, last(close ORDER BY ts) AS rebuilt FROM hours GROUP BY symbol, time_bucket(INTERVAL 4 HOURS, ts, TIMESTAMP '1970-01-01')),
stored AS (SELECT symbol, time_bucket(INTERVAL 4 HOURS, ts, TIMESTAMP '1970-01-01') AS slot, last(price ORDER BY ts, event_id) AS close FROM event_ticks GROUP BY symbol, time_bucket(INTERVAL 4 HOURS, ts, TIMESTAMP '1970-01-01'))
SELECT v.label, count(*) AS n, sum((f.rebuilt = s.close)::BIGINT)::BIGINT AS n_equal, max(abs(f.rebuilt - s.close)) AS worst FROM (VALUES ('open', 0), ('close', 4)) v(label, shift) JOIN four f ON true JOIN stored s ON s.symbol = f.symbol AND s.slot = f.slot + to_hours(v.shift) GROUP BY v.label""")
def rebuilt_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Bars rebuilt from finer ones against stored ones, under both conventions of labels."""
    slot = F.window("ts", "4 hours").start.cast("timestamp_ntz")
    four = m.resample(m.hourly_bars(spark, sf), slot).select("symbol", F.col("ts").alias("slot"), F.col("close").alias("rebuilt"))
    stored = m.bars(m.event_ticks(spark, sf), slot).select("symbol", F.col("ts").alias("slot"), "close")
    labels = F.explode(F.array(F.struct(F.lit("open").alias("label"), F.col("slot").alias("slot")), F.struct(F.lit("close").alias("label"), (F.col("slot") + F.expr("INTERVAL 4 HOURS")).alias("slot")))).alias("x")
    j = four.select("symbol", "rebuilt", labels).select("symbol", "rebuilt", "x.label", "x.slot").join(stored, ["symbol", "slot"])
    return j.groupBy("label").agg(F.count("*").alias("n"), F.sum((F.col("rebuilt") == F.col("close")).cast("bigint")).alias("n_equal"), F.max(F.abs(F.col("rebuilt") - F.col("close"))).alias("worst"))


@R.query(D + ", bad AS (SELECT symbol, year(min(ts)) * 12 + 14 AS first_month, year(min(ts)) * 12 + 20 AS end_month FROM bars GROUP BY symbol) SELECT b.symbol, b.ts, b.close FROM bars b WHERE NOT EXISTS (SELECT 1 FROM bad x WHERE x.symbol = b.symbol AND year(b.ts) * 12 + month(b.ts) - 1 >= x.first_month AND year(b.ts) * 12 + month(b.ts) - 1 < x.end_month)")
def outside_holdouts(spark: SparkSession, sf: str) -> DataFrame:
    """A second source's bars without the ranges that are held out."""
    d = m.daily_bars(spark, sf)
    ranges = d.groupBy("symbol").agg((F.year(F.min("ts")) * 12 + 14).alias("first_month"), (F.year(F.min("ts")) * 12 + 20).alias("end_month"))
    return al.outside(d, ranges, F.year("ts") * 12 + F.month("ts") - 1).select("symbol", "ts", "close")


@R.query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_totalprice DESC, o_orderkey) = 1) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def configurations_kept(spark: SparkSession, sf: str) -> DataFrame:
    """Repeats go, the first in order of priority stays, and at most three of a group (the cap is the feature)."""
    order = [F.desc("o_totalprice"), "o_orderkey"]
    o = m.read(spark, sf, "orders").withColumn("n", F.row_number().over(Window.partitionBy("o_custkey", F.year("o_orderdate")).orderBy(*order))).where("n = 1")
    return o.select("o_custkey", "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(*order)).cast("bigint").alias("place")).where("place <= 3")


@R.query("SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY md5('7:' || o_orderkey), o_orderkey) <= 2")
def seeded_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Two rows of each group without replacement, by a seeded digest: the same on every run and layout."""
    w = Window.partitionBy("o_custkey").orderBy(F.md5(F.concat(F.lit("7:"), F.col("o_orderkey").cast("string"))), "o_orderkey")
    return m.read(spark, sf, "orders").withColumn("n", F.row_number().over(w)).where("n <= 2").select("o_custkey", "o_orderkey", "o_orderdate")


@R.query(D + ", k AS (SELECT symbol, ts, close, ntile(10) OVER (PARTITION BY symbol ORDER BY ts) AS block FROM bars), s AS (SELECT symbol, block, row_number() OVER (PARTITION BY symbol ORDER BY md5('3:' || symbol || block)) AS place FROM (SELECT DISTINCT symbol, block FROM k)) SELECT symbol, ts, close, row_number() OVER (PARTITION BY symbol ORDER BY place, ts) - 1 AS shuffled_ix FROM k JOIN s USING (symbol, block)")
def shuffled_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of a series in a seeded order, each with its own order kept: a null that keeps short dependence."""
    k = m.daily_bars(spark, sf).select("symbol", "ts", "close", F.ntile(10).over(ft.order()).alias("block"))
    digest = F.md5(F.concat(F.lit("3:"), F.col("symbol"), F.col("block").cast("string")))
    return k.select("symbol", "ts", "close", (F.row_number().over(Window.partitionBy("symbol").orderBy(digest, "ts")) - 1).cast("bigint").alias("shuffled_ix"))


_SIDES = "p AS (SELECT ts AS known, value AS last_value FROM events WHERE event_type = 'purchase')"


@R.query(f"WITH {_SIDES} SELECT e.event_id, e.ts, p.known, p.last_value FROM events e ASOF LEFT JOIN p ON e.ts >= p.known")
def asof_events(spark: SparkSession, sf: str) -> DataFrame:
    """Each event with the last purchase at or before it: raw times, no key, no grid, no range join."""
    e = m.read(spark, sf, "events")
    bought = e.where("event_type = 'purchase'").select(F.col("ts").alias("known"), F.col("value").alias("last_value"))
    return asof_join(e.select("event_id", "ts"), bought, (), "ts", "known", ["last_value"], days=1)


@R.query("WITH b AS (SELECT user_id % 50 AS k, ts AS closes, row_number() OVER (PARTITION BY user_id % 50 ORDER BY ts) AS bar_ix FROM events WHERE event_type = 'purchase') SELECT e.event_id, b.closes, b.bar_ix::BIGINT AS bar_ix FROM (SELECT event_id, ts, user_id % 50 AS k FROM events) e ASOF LEFT JOIN b ON e.k = b.k AND e.ts <= b.closes")
def point_to_interval(spark: SparkSession, sf: str) -> DataFrame:
    """Each event's bar, where a bar ends with a purchase of its group: intervals of no common length."""
    e = m.read(spark, sf, "events").select("event_id", "event_type", "ts", (F.col("user_id") % 50).alias("k"))
    ends = ck.numbered(e.where("event_type = 'purchase'").select("k", "ts"), ("k",), days=1).select("k", F.col("ts").alias("closes"), (F.col("row_ix") + 1).alias("bar_ix"))
    return asof_join(e.select("event_id", "ts", "k"), ends, ("k",), "ts", "closes", ["bar_ix"], "forward", days=1).select("event_id", "closes", "bar_ix")


#: Quotes of even events are the main source; bids of odd ones, five hours behind, the second.
_OHLC = "first({0} ORDER BY stamp, event_id) AS {1}open, max({0}) AS {1}high, min({0}) AS {1}low, last({0} ORDER BY stamp, event_id) AS {1}close"


@R.query(f"""WITH q AS (SELECT event_type AS symbol, date_trunc('hour', ts)::TIMESTAMP AS slot, ts AS stamp, event_id, floor(value * 100) AS bid, floor(value * 100) + 1 + event_id % 3 AS ask FROM events),
bars AS MATERIALIZED (SELECT symbol, slot AS ts, {_OHLC.format('bid', 'bid_')}, {_OHLC.format('ask', 'ask_')}, count(*) AS n_ticks FROM q WHERE event_id % 2 = 0 GROUP BY symbol, slot),
second AS MATERIALIZED (SELECT symbol, slot - INTERVAL 5 HOURS AS ts, {_OHLC.format('bid', '')}, count(*) AS n_ticks FROM q GROUP BY symbol, slot),
o AS (SELECT symbol, arg_min(off, (apart, off)) AS off FROM (SELECT b.symbol, k.off, quantile_cont(abs(b.bid_close - s.close), 0.5) AS apart FROM second s, (VALUES (4), (5), (6)) k(off) JOIN bars b ON b.symbol = s.symbol AND b.ts = s.ts + INTERVAL 1 HOUR * k.off GROUP BY b.symbol, k.off) GROUP BY symbol),
sp AS (SELECT symbol, hour(ts) AS h, quantile_cont(ask_close - bid_close, 0.5) AS spread FROM bars GROUP BY symbol, hour(ts)),
n AS (SELECT symbol, ts::DATE AS day, count(*) AS n FROM bars GROUP BY symbol, ts::DATE), ax AS (SELECT symbol, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM n GROUP BY symbol),
miss AS (SELECT symbol, day FROM ax LEFT JOIN n USING (symbol, day) WHERE isodow(day) < 6 AND NOT (month(day) = 12 AND day(day) = 25) AND NOT (month(day) = 1 AND day(day) = 1) AND coalesce(n, 0) < 20),
c AS (SELECT s.symbol, s.ts + INTERVAL 1 HOUR * o.off AS ts, s.open, s.high, s.low, s.close, s.n_ticks FROM second s JOIN o USING (symbol)),
w AS (SELECT c.* FROM c SEMI JOIN miss m ON m.symbol = c.symbol AND m.day = c.ts::DATE), a AS (SELECT w.* FROM w ANTI JOIN bars b ON b.symbol = w.symbol AND b.ts = w.ts)
SELECT symbol, ts, bid_open, bid_high, bid_low, bid_close, ask_open, ask_high, ask_low, ask_close, n_ticks, 'main' AS source FROM bars
UNION ALL SELECT a.symbol, a.ts, open, high, low, close, open + spread, high + spread, low + spread, close + spread, n_ticks, 'second' FROM a JOIN sp ON sp.symbol = a.symbol AND sp.h = hour(a.ts)""")
def gap_filled_quotes(spark: SparkSession, sf: str) -> DataFrame:
    """Quote bars with thin weekdays filled from a second source: its clock found by the closes, its asks by the hour's median spread."""
    t = m.event_ticks(spark, sf).withColumns({"bid": F.col("price"), "ask": F.col("price") + 1 + F.col("seq.event_id") % 3})
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    main = al.quotes(t.where(F.col("seq.event_id") % 2 == 0), hour)
    second = al.quotes(t, hour).select("symbol", (F.col("ts") - F.expr("INTERVAL 5 HOURS")).alias("ts"), *[F.col(f"bid_{n}").alias(n) for n in ("open", "high", "low", "close")], "n_ticks")
    return al.filled_quotes(main, second, 20, (4, 5, 6))


@R.query("""WITH c AS (SELECT user_id, event_type, count(*) FILTER (ts < TIMESTAMP '2024-01-16') AS early, count(*) FILTER (ts >= TIMESTAMP '2024-01-16') AS late FROM events GROUP BY user_id, event_type)
SELECT user_id, count(*) AS n_types, sum(abs(late - early))::BIGINT AS moved, string_agg(event_type, ',' ORDER BY event_type) FILTER (late > early) AS rising, max(late) FILTER (event_type = 'purchase') AS late_purchases FROM c GROUP BY user_id""")
def map_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Counts by type as maps, early and late; joined key by key, filtered and looked up."""
    c = m.read(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count_if(F.col("ts") < F.expr("TIMESTAMP_NTZ '2024-01-16'")).alias("early"), F.count_if(F.col("ts") >= F.expr("TIMESTAMP_NTZ '2024-01-16'")).alias("late"))
    maps = c.groupBy("user_id").agg(*[F.map_from_entries(F.collect_list(F.struct("event_type", k))).alias(k) for k in ("early", "late")])
    change = F.map_zip_with("early", "late", lambda _, a, b: F.coalesce(b, F.lit(0)) - F.coalesce(a, F.lit(0)))
    d = maps.withColumn("change", change)
    rising = F.array_sort(F.map_keys(F.map_filter("change", lambda _, v: v > 0)))
    return d.select("user_id", F.size("change").cast("bigint").alias("n_types"), F.aggregate(F.map_values("change"), F.lit(0).cast("bigint"), lambda s, v: s + F.abs(v)).alias("moved"), F.when(F.size(rising) > 0, F.array_join(rising, ",")).alias("rising"), F.try_element_at("late", F.lit("purchase")).alias("late_purchases"))
