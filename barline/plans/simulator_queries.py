"""Queries on margin, shared accounts, ladders and baskets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barline.functions import features as ft
from barline.operators import ladders as la
from barline.operators import perpetual as pe
from barline.plans.alignment_queries import funding, two_series
from barline.plans.analytics_queries import REPLAY_RULES, REPLAY_SQL, replayable
from barline.plans.feature_queries import SMA, STD
from barline.registry import Registry
from barline.sources import market as m

R = Registry()
D = f"WITH {m.DAILY_SQL} "
LAG = "OVER (PARTITION BY symbol ORDER BY ts)"
_CASES = " ".join(f"WHEN value <= {t.cap} THEN {i}" for i, t in enumerate(pe.TIERS))
_PICK = lambda f: "CASE tier " + " ".join(f"WHEN {i} THEN {f(t)}::DOUBLE" for i, t in enumerate(pe.TIERS)) + " END"


@R.query(f"""WITH q AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, floor(l_extendedprice * 100 / l_quantity) AS entry, l_quantity AS quantity, CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END AS side, floor(l_extendedprice * 100 / l_quantity) * l_quantity / 100 AS value FROM lineitem), t AS (SELECT *, CASE {_CASES} END AS tier FROM q),
k AS (SELECT *, {_PICK(lambda t: t.mmr)} AS mmr, {_PICK(lambda t: t.amount)} AS amount, {_PICK(lambda t: t.leverage)} AS most, entry / 100 AS price FROM t), w AS (SELECT *, value / 5 AS margin FROM k)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, price, quantity, side::BIGINT AS side, tier::BIGINT AS tier, most, value * mmr - amount AS maintenance, CASE WHEN side > 0 THEN (price * quantity - margin - amount) / (quantity * (1 - mmr)) ELSE (price * quantity + margin + amount) / (quantity * (1 + mmr)) END AS liquidation FROM w""")
def liquidation_prices(spark: SparkSession, sf: str) -> DataFrame:
    """Tier, maintenance and liquidation price of positions at fivefold leverage: closed forms."""
    q = m.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity")).cast("double") / 100).alias("price"), F.col("l_quantity").alias("quantity"), F.when(F.col("l_linestatus") == "O", 1).otherwise(-1).cast("bigint").alias("side"), (F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity")).cast("double") * F.col("l_quantity") / 100).alias("value"))
    tier = F.lit(None).cast("bigint")
    for i, t in reversed(list(enumerate(pe.TIERS))):
        tier = F.when(F.col("value") <= t.cap, F.lit(i).cast("bigint")).otherwise(tier)
    pick = lambda f: F.get(F.array(*[F.lit(float(f(t))) for t in pe.TIERS]), F.col("tier").cast("int"))
    k = q.withColumn("tier", tier).withColumns({"mmr": pick(lambda t: t.mmr), "amount": pick(lambda t: t.amount), "most": pick(lambda t: t.leverage)})
    return k.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "price", "quantity", "side", "tier", "most", pe.maintenance_column(F.col("value"), F.col("mmr"), F.col("amount")).alias("maintenance"), pe.liquidation_column(F.col("side"), F.col("quantity"), F.col("price"), F.col("value") / 5, F.col("mmr"), F.col("amount")).alias("liquidation"))


def perpetual_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Four-hour bars with their hours as paths of trades and marks, their settlements, and mean-crossing signals."""
    bars, settled = funding(spark, sf)
    trades, marks = two_series(spark, sf)
    slot = F.window("ts", "4 hours").start.cast("timestamp_ntz")
    points = trades.join(marks.select("symbol", "ts", F.col("low").alias("mark_low"), F.col("high").alias("mark_high"), F.col("close").alias("mark")), ["symbol", "ts"])
    point = F.struct((F.hour("ts") % 4 * 60).cast("int").alias("minute"), "low", "high", "mark_low", "mark_high")
    paths = points.groupBy("symbol", slot.alias("slot")).agg(F.array_sort(F.collect_list(point)).alias("path"), F.max_by("mark", "ts").alias("mark_close")).withColumnRenamed("slot", "ts")
    due = settled.groupBy("symbol", "bar_ix").agg(F.array_sort(F.collect_list(F.struct((F.hour("stamp") % 4 * 60).cast("int").alias("minute"), "rate", "mark"))).alias("settlements"))
    c = F.col("close")
    n = bars.withColumn("bar_ix", (F.row_number().over(ft.order()) - 1).cast("bigint")).withColumns({"stop_distance": ft.std(c, 10) / 4, "fired": F.array_compact(F.array(*[F.when(ft.cross_up(ft.sma(c, a), ft.sma(c, b)), F.lit(i)) for i, (a, b) in enumerate([(2, 5), (3, 10)])]))})
    j = n.join(paths, ["symbol", "ts"], "left").join(due, ["symbol", "bar_ix"], "left")
    empty = "array<struct<minute:int,low:double,high:double,mark_low:double,mark_high:double>>"
    return j.select("symbol", "ts", "open", "close", F.coalesce("mark_close", "close").alias("mark_close"), "stop_distance", "fired", F.coalesce("path", F.array().cast(empty)).alias("path"), "settlements")


@R.query(None)
def perpetual_replay(spark: SparkSession, sf: str) -> DataFrame:
    """Isolated-margin accounts over bars, minute paths and settlements. SQL has no counterpart; tests hold it against a minute by minute loop."""
    return pe.replay_perpetual(perpetual_bars(spark, sf), 2)


_SHARED = pe.SharedCash(cash=REPLAY_RULES.cash, risk=REPLAY_RULES.risk, cap=1.0, fee=REPLAY_RULES.fee, lot=REPLAY_RULES.lot, hold=REPLAY_RULES.hold)


@R.query(REPLAY_SQL + """, b2 AS (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ix FROM bars), a AS (SELECT symbol, row_number() OVER (ORDER BY symbol) AS account FROM (SELECT DISTINCT symbol FROM bars))
SELECT a.account, b2.ts, g.equity, (g.qty > 0)::BIGINT AS n_open FROM go g JOIN b2 ON b2.symbol = g.symbol AND b2.ix = g.ix JOIN a ON a.symbol = g.symbol WHERE g.config_id = 0""")
def separate_accounts(spark: SparkSession, sf: str) -> DataFrame:
    """One account a symbol: the shared account's rules come down to those of a single replay."""
    b = replayable(spark, sf)
    names = b.select("symbol").distinct().withColumn("account", F.row_number().over(Window.orderBy("symbol")).cast("bigint"))
    slots = b.join(F.broadcast(names), "symbol").select("account", F.col("symbol").alias("slot"), "ts", "open", "high", "low", "close", F.when(F.array_contains("fired", 0), F.col("stop_distance")).alias("stop_distance"))
    return pe.shared_curves(slots, _SHARED)


@R.query(None)
def shared_accounts(spark: SparkSession, sf: str) -> DataFrame:
    """All symbols on one cash account, in two scenarios of fired rules; a test holds it against a second implementation."""
    b = replayable(spark, sf)
    slots = b.withColumn("account", F.explode(F.array(F.lit(0).cast("bigint"), F.lit(2).cast("bigint")))).select("account", F.col("symbol").alias("slot"), "ts", "open", "high", "low", "close", F.when(F.array_contains("fired", F.col("account").cast("int")), F.col("stop_distance")).alias("stop_distance"))
    return pe.shared_curves(slots, pe.SharedCash(hold=20, lot=0.001, cap=0.03))


@R.query(None)
def ladder_replay(spark: SparkSession, sf: str) -> DataFrame:
    """A neutral grid and an averaging-down cycle on each symbol."""
    c = F.col("close")
    d = m.daily_bars(spark, sf).withColumn("ret", ft.growth(c))
    return la.replay_ladders(d.withColumn("deviation", ft.ago(ft.sample_std(F.col("ret"), 20), 1) / 10))


_STEP, _ORDERS, _GOAL, _STOP, _LONG = 3000.0, 4, 1500.0, 15000.0, 15


@R.query(D + f""", b AS (SELECT *, row_number() {LAG} - 1 AS ix FROM bars), p AS (SELECT a.symbol, a.ix AS start_ix, s.side, a.close AS entry, n.ix, n.close, CASE WHEN s.side > 0 THEN a.close - n.low ELSE n.high - a.close END AS against, CASE WHEN s.side > 0 THEN n.high - a.close ELSE a.close - n.low END AS favour FROM b a JOIN b n ON n.symbol = a.symbol AND n.ix > a.ix AND n.ix <= a.ix + {_LONG}, (VALUES (1), (-1)) s(side)),
r AS (SELECT *, max(against) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS worst_before, max(against) OVER (w ROWS UNBOUNDED PRECEDING) AS worst FROM p WINDOW w AS (PARTITION BY symbol, start_ix, side ORDER BY ix)),
k AS (SELECT *, least(greatest(floor(coalesce(worst_before, 0) / {_STEP}), 0), {_ORDERS}) AS filled FROM r),
x AS (SELECT *, CASE WHEN worst >= {_STOP} THEN 'stop' WHEN favour + filled * {_STEP} / 2 >= {_GOAL} THEN 'goal' WHEN ix = start_ix + {_LONG} THEN 'timeout' END AS outcome FROM k), f AS (SELECT * FROM x WHERE outcome IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol, start_ix, side ORDER BY ix) = 1)
SELECT symbol, side::BIGINT AS side, outcome, count(*) AS n, avg(filled) AS orders, sum(CASE outcome WHEN 'goal' THEN {_GOAL} * (filled + 1) WHEN 'stop' THEN -({_STOP} - filled * {_STEP} / 2) * (filled + 1) ELSE (side * (close - entry) + filled * {_STEP} / 2) * (filled + 1) END) AS gain FROM f GROUP BY ALL""")
def basket_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """An isolated basket from every bar and in both directions: orders at even steps against it, a goal over their
    average, a stop and a time. What was filled by the bar before decides a bar; a stop comes before a goal."""
    n = m.daily_bars(spark, sf).withColumn("ix", (F.row_number().over(ft.order()) - 1).cast("bigint"))
    bucket = lambda x: F.floor(x / _LONG)
    starts = n.select("symbol", F.col("ix").alias("start_ix"), F.col("close").alias("entry"), F.explode(F.sequence(bucket(F.col("ix") + 1), bucket(F.col("ix") + _LONG))).alias("bucket"))
    p = starts.join(n.select("symbol", "ix", "high", "low", "close", bucket(F.col("ix")).alias("bucket")), ["symbol", "bucket"]).where((F.col("ix") > F.col("start_ix")) & (F.col("ix") <= F.col("start_ix") + _LONG)).withColumn("side", F.explode(F.array(F.lit(1).cast("bigint"), F.lit(-1).cast("bigint"))))
    up = F.col("side") > 0
    p = p.withColumns({"against": F.when(up, F.col("entry") - F.col("low")).otherwise(F.col("high") - F.col("entry")), "favour": F.when(up, F.col("high") - F.col("entry")).otherwise(F.col("entry") - F.col("low"))})
    w = Window.partitionBy("symbol", "start_ix", "side").orderBy("ix")
    before = F.coalesce(F.max("against").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    r = p.withColumns({"worst": F.max("against").over(w.rowsBetween(Window.unboundedPreceding, 0)), "filled": F.least(F.greatest(F.floor(before / _STEP), F.lit(0)), F.lit(_ORDERS)).cast("double")})
    outcome = F.when(F.col("worst") >= _STOP, "stop").when(F.col("favour") + F.col("filled") * _STEP / 2 >= _GOAL, "goal").when(F.col("ix") == F.col("start_ix") + _LONG, "timeout")
    f = r.withColumn("outcome", outcome).where("outcome IS NOT NULL").groupBy("symbol", "start_ix", "side", "entry").agg(F.min_by(F.struct("outcome", "filled", "close"), "ix").alias("x")).select("symbol", "side", "entry", "x.*")
    units = F.col("filled") + 1
    gain = F.when(F.col("outcome") == "goal", _GOAL * units).when(F.col("outcome") == "stop", -(_STOP - F.col("filled") * _STEP / 2) * units).otherwise((F.col("side") * (F.col("close") - F.col("entry")) + F.col("filled") * _STEP / 2) * units)
    return f.groupBy("symbol", "side", "outcome").agg(F.count("*").alias("n"), F.avg("filled").alias("orders"), F.sum(gain).alias("gain"))


@R.query(D + f""", b0 AS (SELECT *, row_number() {LAG} - 1 AS ix, {SMA('close', 5)} AS mean5, {STD('close', 20)} AS dev20 FROM bars), b AS (SELECT *, lag(mean5) {LAG} AS anchor_now, lag(dev20) {LAG} AS sigma_now FROM b0), v AS (SELECT *, sigma_now AS sigma FROM b), e AS (SELECT symbol, ix AS entry_ix, close AS entry, anchor_now AS anchor, sigma, CASE WHEN close < anchor_now THEN 1 ELSE -1 END AS side FROM v WHERE sigma > 0 AND abs(close - anchor_now) > sigma),
p AS (SELECT e.*, n.ix, n.close, n.open, CASE WHEN side > 0 THEN n.low <= entry - 2 * sigma ELSE n.high >= entry + 2 * sigma END AS stopped, CASE WHEN side > 0 THEN n.high >= anchor ELSE n.low <= anchor END AS reached FROM e JOIN b n ON n.symbol = e.symbol AND n.ix > e.entry_ix AND n.ix <= e.entry_ix + 10),
x AS (SELECT *, CASE WHEN stopped THEN 'stop' WHEN reached THEN 'anchor' WHEN ix = entry_ix + 10 THEN 'time' END AS outcome FROM p), f AS (SELECT * FROM x WHERE outcome IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol, entry_ix ORDER BY ix) = 1)
SELECT symbol, entry_ix, side::BIGINT AS side, ix AS exit_ix, outcome, side * (CASE outcome WHEN 'stop' THEN entry - side * 2 * sigma WHEN 'anchor' THEN anchor ELSE close END - entry) AS gain FROM f""")
def anchored_trades(spark: SparkSession, sf: str) -> DataFrame:
    """Trades back to an anchor: a close far from the mean known before it, out at the anchor, at a stop or after a time."""
    c = F.col("close")
    n = m.daily_bars(spark, sf).withColumns({"mean5": ft.sma(c, 5), "dev20": ft.std(c, 20), "ix": (F.row_number().over(ft.order()) - 1).cast("bigint")})
    n = n.withColumns({"anchor": ft.ago(F.col("mean5"), 1), "sigma": ft.ago(F.col("dev20"), 1)})
    bucket = lambda x: F.floor(x / 10)
    e = n.where((F.col("sigma") > 0) & (F.abs(c - F.col("anchor")) > F.col("sigma"))).select("symbol", F.col("ix").alias("entry_ix"), c.alias("entry"), "anchor", "sigma", F.when(c < F.col("anchor"), 1).otherwise(-1).cast("bigint").alias("side"), F.explode(F.sequence(bucket(F.col("ix") + 1), bucket(F.col("ix") + 10))).alias("bucket"))
    p = e.join(n.select("symbol", "ix", "high", "low", "close", bucket(F.col("ix")).alias("bucket")), ["symbol", "bucket"]).where((F.col("ix") > F.col("entry_ix")) & (F.col("ix") <= F.col("entry_ix") + 10))
    up = F.col("side") > 0
    stopped = F.when(up, F.col("low") <= F.col("entry") - 2 * F.col("sigma")).otherwise(F.col("high") >= F.col("entry") + 2 * F.col("sigma"))
    reached = F.when(up, F.col("high") >= F.col("anchor")).otherwise(F.col("low") <= F.col("anchor"))
    x = p.withColumn("outcome", F.when(stopped, "stop").when(reached, "anchor").when(F.col("ix") == F.col("entry_ix") + 10, "time")).where("outcome IS NOT NULL")
    f = x.groupBy("symbol", "entry_ix", "side", "entry", "anchor", "sigma").agg(F.min_by(F.struct("ix", "outcome", "close"), "ix").alias("x"))
    price = F.when(F.col("x.outcome") == "stop", F.col("entry") - F.col("side") * 2 * F.col("sigma")).when(F.col("x.outcome") == "anchor", F.col("anchor")).otherwise(F.col("x.close"))
    return f.select("symbol", "entry_ix", "side", F.col("x.ix").alias("exit_ix"), F.col("x.outcome").alias("outcome"), (F.col("side") * (price - F.col("entry"))).alias("gain"))
