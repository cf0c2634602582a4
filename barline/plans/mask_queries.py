"""Queries on all conditions of the condition laboratory, alone and in pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barline.functions import features as ft
from barline.operators import chunks as ck
from barline.operators import masks as mk
from barline.registry import Registry
from barline.sources import market as m

R = Registry()
#: Half-hourly bars of three symbols: line items spread over their day by the order's number. Days of 48 bars.
MINUTES, BENCHMARK, VOL, LEAST = 30, "N", (48, 10), 3


def half_hours(spark: SparkSession, sf: str) -> DataFrame:
    ticks = m.trade_ticks(spark, sf).withColumn("symbol", F.left("symbol", F.lit(1)))
    slot = F.col("ts") + F.expr("make_dt_interval(0, 0, CAST(30 * (seq.l_orderkey % 48) AS INT), 0)")
    return m.bars(ticks, slot.cast("timestamp_ntz"))


def funding(spark: SparkSession, sf: str) -> DataFrame:
    """symbol, ts, rate: a rate a day, from taxes against their middle."""
    d = m.read(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("symbol"), F.col("l_shipdate").alias("ts"))
    return d.agg(((F.sum(F.round(F.col("l_tax") * 100).cast("bigint")) - 4 * F.count("*")) / (10_000 * F.count("*"))).alias("rate"))


def masked(spark: SparkSession, sf: str) -> DataFrame:
    return mk.conditions(half_hours(spark, sf), MINUTES, BENCHMARK, funding(spark, sf), VOL, LEAST)


_A_DAY = 1440 // MINUTES
_O = "PARTITION BY symbol ORDER BY ts"
_W = lambda n: f"({_O} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
_FULL = lambda f, x, n: f"CASE WHEN count({x}) OVER {_W(n)} = {n} THEN {f} OVER {_W(n)} END"
_BACK = lambda x, d: f"{x} / NULLIF(lag({x}, {d * _A_DAY}) OVER ({_O}), 0) - 1"
_STEP = lambda x, n: f"go.{x}{n} + (n.{x} - go.{x}{n}) / {n}"


def _index_sql(bars: str, tag: str, periods: tuple[int, ...]) -> str:
    """Indices of a relation of closes over its whole history, row by row."""
    pairs = [(s, n) for n in periods for s in ("u", "d")]
    return f"""n{tag} AS MATERIALIZED (SELECT symbol, ts, close, coalesce(greatest(close - lag(close) OVER ({_O}), 0.0), 0.0) AS u, coalesce(greatest(lag(close) OVER ({_O}) - close, 0.0), 0.0) AS d, row_number() OVER ({_O}) - 1 AS ix FROM {bars}),
go{tag} AS (SELECT symbol, ts, ix, {', '.join(f'0.0::DOUBLE AS {s}{n}' for s, n in pairs)} FROM n{tag} WHERE ix = 0 UNION ALL SELECT n.symbol, n.ts, n.ix, {', '.join(_STEP(s, n) for s, n in pairs)} FROM go{tag} go JOIN n{tag} n ON n.symbol = go.symbol AND n.ix = go.ix + 1),
rsi{tag} AS MATERIALIZED (SELECT symbol, ts, {', '.join(f'CASE WHEN ix >= {n - 1} AND ix > 0 THEN CASE WHEN d{n} = 0 THEN 100.0 ELSE 100 - 100 / (1 + u{n} / d{n}) END END AS rsi{n}' for n in periods)} FROM go{tag})"""


def _higher_sql(name: str, minutes: int) -> str:
    closes = f"c{name} AS (SELECT symbol, time_bucket(INTERVAL {minutes} MINUTES, ts, TIMESTAMP '1970-01-01') AS ts, last(close ORDER BY ts) AS close FROM bars GROUP BY symbol, time_bucket(INTERVAL {minutes} MINUTES, ts, TIMESTAMP '1970-01-01'))"
    index = ", " + _index_sql(f"c{name}", name, (14,)) if name == "htf4h" else ""
    rsi, join = ("r.rsi14", f" JOIN rsi{name} r USING (symbol, ts)") if index else ("NULL::DOUBLE", "")
    return f"{closes}{index}, {name} AS (SELECT c.symbol, c.ts + INTERVAL {minutes} MINUTES AS known, c.close < c.mean AS below, {rsi} AS rsi FROM (SELECT *, {_FULL('avg(close)', 'close', 20)} AS mean FROM c{name}) c{join})"


_MASKS = {
    "none": "true",
    **{f"btc_sma{d}d": f"lead < lead{d}" for d in mk.BENCHMARK_MEANS},
    **{f"btc_ret{d}d_neg": f"lback{d} < 0" for d in mk.BENCHMARK_RETURNS},
    "btc_vol_low": f"CASE WHEN nvol >= {VOL[1] * _A_DAY // 3} THEN lvol / NULLIF(mvol, 0) END < 1.0",
    **{f"rel{d}d_weak": f"cback{d} - lback{d} < 0" for d in mk.RELATIVE_RETURNS},
    **{f"coin_sma{d}d": f"close < close{d}" for d in mk.OWN_MEANS},
    "breadth_ge50": "breadth >= 0.5", "breadth_ge65": "breadth >= 0.65",
    "fund_pos": "rate > 0", "fund_above_neutral": "rate > 0.0001", "fund_gt_med30": "rate > med30", "fund7_pos": "mean7 > 0",
    **{f"rsi{n}_lt{x}": f"rsi{n} < {x}" for n, xs in mk.BELOW.items() for x in xs}, **{f"rsi{n}_gt{x}": f"rsi{n} > {x}" for n, xs in mk.ABOVE.items() for x in xs},
    "brk_vol_ge1.5": "volume / NULLIF(usual, 0) >= 1.5", "brk_vol_ge2": "volume / NULLIF(usual, 0) >= 2.0", "brk_vol_lt1": "volume / NULLIF(usual, 0) < 1.0",
    "clv_le0.25": "high > low AND (close - low) / NULLIF(high - low, 0) <= 0.25", "clv_ge0.5": "high > low AND (close - low) / NULLIF(high - low, 0) >= 0.5",
    "bar_big_2sig": "abs(r) >= 2 * sigma", "bar_small_1sig": "abs(r) < sigma",
    "htf1h_below_sma20": "below1", "htf4h_below_sma20": "below4", "htf1d_below_sma20": "belowd", "htf4h_rsi14_lt50": "rsi4 < 50",
    "sess_asia": "hour(closes_at) < 8", "sess_eu": "hour(closes_at) BETWEEN 8 AND 15", "sess_us": "hour(closes_at) >= 16", "weekday": "isodow(closes_at) < 6", "weekend": "isodow(closes_at) >= 6",
    "near_30d_high": "close >= 0.9 * top", "far_below_30d_high": "close <= 0.8 * top",
    "upper_half_30d": "top > bottom AND (close - bottom) / NULLIF(top - bottom, 0) >= 0.5", "lower_half_30d": "top > bottom AND (close - bottom) / NULLIF(top - bottom, 0) < 0.5",
}

MASKED = f"""WITH RECURSIVE ticks AS (SELECT l_returnflag AS symbol, l_shipdate + INTERVAL 30 MINUTE * (l_orderkey % 48) AS ts, floor(l_extendedprice * 100 / l_quantity) AS price, l_quantity AS volume, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem),
bars AS MATERIALIZED (SELECT symbol, ts, first(price ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS close, sum(volume) AS volume FROM ticks GROUP BY symbol, ts),
fu AS (SELECT l_returnflag AS symbol, l_shipdate AS known, (sum(round(l_tax * 100)::BIGINT) - 4 * count(*))::DOUBLE / (10000 * count(*)) AS rate FROM lineitem GROUP BY ALL),
fr AS (SELECT symbol, known, rate, quantile_cont(rate, 0.5) OVER (PARTITION BY symbol ORDER BY known RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW) AS med30, avg(rate) OVER (PARTITION BY symbol ORDER BY known RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW) AS mean7 FROM fu),
da AS (SELECT symbol, date_trunc('day', ts)::TIMESTAMP AS ts, last(close ORDER BY ts) AS close FROM bars GROUP BY symbol, date_trunc('day', ts)::TIMESTAMP),
br AS (SELECT ts + INTERVAL 1 DAY AS known, CASE WHEN count(below) >= {LEAST} THEN avg(below::INT) END AS breadth FROM (SELECT symbol, ts, close < {_FULL('avg(close)', 'close', 50)} AS below FROM da) GROUP BY ts),
{_index_sql('bars', 'own', (14, 5))}, {_higher_sql('htf1h', 60)}, {_higher_sql('htf4h', 240)}, {_higher_sql('htf1d', 1440)},
j0 AS (SELECT b.*, b.ts + INTERVAL {MINUTES} MINUTES AS closes_at, last(l.close IGNORE NULLS) OVER (PARTITION BY b.symbol ORDER BY b.ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lead, r.rsi14, r.rsi5 FROM bars b LEFT JOIN bars l ON l.ts = b.ts AND l.symbol = '{BENCHMARK}' JOIN rsiown r ON r.symbol = b.symbol AND r.ts = b.ts),
j1 AS (SELECT j.*, x.breadth FROM j0 j ASOF LEFT JOIN br x ON j.closes_at >= x.known), j2 AS (SELECT j.*, x.rate, x.med30, x.mean7 FROM j1 j ASOF LEFT JOIN fr x ON j.symbol = x.symbol AND j.closes_at >= x.known),
j3 AS (SELECT j.*, x.below AS below1 FROM j2 j ASOF LEFT JOIN htf1h x ON j.symbol = x.symbol AND j.closes_at >= x.known), j4 AS (SELECT j.*, x.below AS below4, x.rsi AS rsi4 FROM j3 j ASOF LEFT JOIN htf4h x ON j.symbol = x.symbol AND j.closes_at >= x.known),
j5 AS (SELECT j.*, x.below AS belowd FROM j4 j ASOF LEFT JOIN htf1d x ON j.symbol = x.symbol AND j.closes_at >= x.known),
f0 AS (SELECT *, {_BACK('close', 1).replace(f'{_A_DAY}', '1')} AS r, CASE WHEN lead > 0 AND lag(lead) OVER ({_O}) > 0 THEN ln(lead / lag(lead) OVER ({_O})) END AS lmove, {_FULL('quantile_cont(volume, 0.5)', 'volume', _A_DAY)} AS usual_now, {_FULL('max(high)', 'high', 30 * _A_DAY)} AS top, {_FULL('min(low)', 'low', 30 * _A_DAY)} AS bottom,
 {', '.join(f"{_FULL('sum(lead)', 'lead', d * _A_DAY)} / {d * _A_DAY} AS lead{d}" for d in mk.BENCHMARK_MEANS)}, {', '.join(f"{_FULL('sum(close)', 'close', d * _A_DAY)} / {d * _A_DAY} AS close{d}" for d in mk.OWN_MEANS)},
 {', '.join(f"{_BACK('lead', d)} AS lback{d}" for d in (1, 7, 30))}, {', '.join(f"{_BACK('close', d)} AS cback{d}" for d in (7, 30))} FROM j5),
f1 AS (SELECT *, lag(usual_now) OVER ({_O}) AS usual, {_FULL('stddev_samp(r)', 'r', _A_DAY)} AS sigma_now, round({_FULL('stddev_samp(lmove)', 'lmove', VOL[0])}, {mk.VOL_DIGITS}) AS lvol FROM f0),
f2 AS (SELECT *, lag(sigma_now) OVER ({_O}) AS sigma, quantile_cont(lvol, 0.5) OVER {_W(VOL[1] * _A_DAY)} AS mvol, count(lvol) OVER {_W(VOL[1] * _A_DAY)} AS nvol FROM f1),
masked AS MATERIALIZED (SELECT symbol, ts, close, lead(close, 12) OVER ({_O}) - close AS forward, {', '.join(f'coalesce({_MASKS[n]}, false) AS "{n}"' for n in mk.NAMES)} FROM f2)"""
_LONG = "[" + ", ".join(f"{{'condition': '{n}', 'hit': \"{n}\"}}" for n in mk.NAMES) + "]"


@R.query(MASKED + f", l AS (SELECT symbol, unnest({_LONG}, recursive := true) FROM masked) SELECT symbol, condition, count(*) FILTER (hit) AS n_hits, count(*) AS n, count(*) FILTER (hit) / count(*) AS rate, count(*) FILTER (hit) / count(*) < 0.01 OR count(*) FILTER (hit) / count(*) > 0.99 AS degenerate FROM l GROUP BY symbol, condition")
def mask_rates(spark: SparkSession, sf: str) -> DataFrame:
    """How often each of the 49 conditions holds, from the packed masks."""
    words = mk.packed(masked(spark, sf), mk.NAMES)
    d = words.select("symbol", "n", F.posexplode("words").alias("i", "word")).groupBy("symbol", "i").agg(F.sum(F.bit_count("word")).cast("bigint").alias("n_hits"), F.sum("n").alias("n"))
    rate = F.col("n_hits") / F.col("n")
    return d.select("symbol", F.get(F.array(*[F.lit(x) for x in mk.NAMES]), F.col("i")).alias("condition"), "n_hits", "n", rate.alias("rate"), ((rate < 0.01) | (rate > 0.99)).alias("degenerate"))


def with_wins(spark: SparkSession, sf: str) -> DataFrame:
    """Masks with one more: whether the close rises over the next twelve bars (never, where there are none)."""
    d = masked(spark, sf)
    cut = ck.blocks(ck.numbered(d), 0, ahead=12)
    with ft.partitioned("symbol", "block"):
        ahead = F.lead("close", 12).over(ft.order())
        return cut.withColumn("win", F.coalesce(ahead > F.col("close"), F.lit(False))).where("own").drop("own", "block", "row_ix")


@R.query(MASKED + f", w AS (SELECT symbol, ts, coalesce(forward > 0, false) AS win, unnest({_LONG}, recursive := true) FROM masked), h AS (SELECT symbol, ts, win, condition, CASE condition {' '.join(f'''WHEN '{n}' THEN {i}''' for i, n in enumerate(mk.NAMES))} END AS k FROM w WHERE hit), s AS (SELECT symbol, condition, count(*) AS n FROM h GROUP BY ALL), names AS (SELECT unnest([{', '.join(f'''{{'condition': '{n}', 'k': {i}}}''' for i, n in enumerate(mk.NAMES))}], recursive := true)), y AS (SELECT DISTINCT symbol FROM bars), p AS (SELECT a.symbol, a.condition AS a, b.condition AS b, count(*) AS n_both, count(*) FILTER (a.win) AS n_wins FROM h a JOIN h b ON a.symbol = b.symbol AND a.ts = b.ts AND a.k < b.k GROUP BY ALL) SELECT y.symbol, x.condition AS a, z.condition AS b, coalesce(n_both, 0) AS n_both, coalesce(sa.n, 0) + coalesce(sb.n, 0) - coalesce(n_both, 0) AS n_either, coalesce(n_wins, 0) AS n_wins FROM y, names x JOIN names z ON x.k < z.k LEFT JOIN p ON p.symbol = y.symbol AND p.a = x.condition AND p.b = z.condition LEFT JOIN s sa ON sa.symbol = y.symbol AND sa.condition = x.condition LEFT JOIN s sb ON sb.symbol = y.symbol AND sb.condition = z.condition")
def mask_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """All 1,176 pairs of conditions: bars on which both hold, either does, and both do before a rise."""
    return mk.pair_hits(mk.packed(with_wins(spark, sf), [*mk.NAMES, "win"]), mk.NAMES, "win")


_TRAINED = "(PARTITION BY a, b ORDER BY month ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)"


@R.query(MASKED + f", w AS (SELECT symbol, ts, date_trunc('month', ts)::TIMESTAMP AS month, coalesce(forward > 0, false) AS win, unnest({_LONG}, recursive := true) FROM masked), h AS (SELECT symbol, ts, month, win, condition, CASE condition {' '.join(f'''WHEN '{n}' THEN {i}''' for i, n in enumerate(mk.NAMES))} END AS k FROM w WHERE hit AND condition <> 'none'), g AS (SELECT a.condition AS a, b.condition AS b, a.month, count(*) AS n_both, count(*) FILTER (a.win) AS n_wins FROM h a JOIN h b ON a.symbol = b.symbol AND a.ts = b.ts AND a.k < b.k GROUP BY ALL), t AS (SELECT *, sum(n_both) OVER {_TRAINED} AS seen, sum(n_wins) OVER {_TRAINED} AS won FROM g) SELECT a, b, month, n_both, n_wins, won / seen AS trained FROM t WHERE seen >= 100")
def mask_pair_months(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs month by month, with the share of rises that their last twelve months with hits had (of a hundred hits or more)."""
    d = with_wins(spark, sf).withColumn("month", F.date_trunc("month", "ts").cast("timestamp_ntz"))
    names = [n for n in mk.NAMES if n != "none"]
    g = mk.pair_hits(mk.packed(d, [*names, "win"], ("symbol", "month")), names, "win", ("month",)).where("n_both > 0")
    over = Window.partitionBy("a", "b").orderBy("month").rowsBetween(-12, -1)
    t = g.withColumns({"seen": F.sum("n_both").over(over), "won": F.sum("n_wins").over(over)}).where("seen >= 100")
    return t.select("a", "b", "month", "n_both", "n_wins", (F.col("won") / F.col("seen")).alias("trained"))
