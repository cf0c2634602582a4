"""Market conditions as masks over bars, and masks packed into words of 64 bars.

A condition is known at a bar's close. What lives on another axis (breadth, funding,
closes of higher timeframes) is taken as of that close. Bars are cut into blocks
with a halo; means over many days are differences of running sums and extremes over
many bars come from running extremes of segments, so a row costs the same for any number of days.

Packed, a mask is one bit a bar in a long a block of 64 bars; masks taken together are
``bitwiseAND`` and their hits ``bit_count``, so all pairs of masks cost a number of words, not of bars.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.functions import features as ft
from barline.operators import chunks as ck
from barline.operators.asof import asof_joins
from barline.operators.lineage import cut
from barline.sources.market import resample

# Names of the conditions and what each asks for.
#: Days of means and returns.
BENCHMARK_MEANS, BENCHMARK_RETURNS, RELATIVE_RETURNS, OWN_MEANS = (20, 50, 100, 200), (1, 7, 30), (7, 30), (50, 200)
RANGE_DAYS = 30
#: Levels of the index by its period.
BELOW, ABOVE = {14: (30, 40, 50), 5: (20, 30)}, {14: (25, 30, 35), 5: (10, 20)}
FUNDING = ("fund_pos", "fund_above_neutral", "fund_gt_med30", "fund7_pos")
NEUTRAL = 0.0001
#: Digits of a deviation: windows of the same moves have the same one, whatever the order they are summed in.
VOL_DIGITS = 9
HIGHER = {"htf1h": 60, "htf4h": 240, "htf1d": 1440}
NAMES = (
    "none", *[f"btc_sma{d}d" for d in BENCHMARK_MEANS], *[f"btc_ret{d}d_neg" for d in BENCHMARK_RETURNS], "btc_vol_low", *[f"rel{d}d_weak" for d in RELATIVE_RETURNS], *[f"coin_sma{d}d" for d in OWN_MEANS],
    "breadth_ge50", "breadth_ge65", *FUNDING, "rsi14_lt30", "rsi14_lt40", "rsi14_lt50", "rsi5_lt20", "rsi5_lt30", "rsi14_gt25", "rsi14_gt30", "rsi14_gt35", "rsi5_gt10", "rsi5_gt20",
    "brk_vol_ge1.5", "brk_vol_ge2", "brk_vol_lt1", "clv_le0.25", "clv_ge0.5", "bar_big_2sig", "bar_small_1sig", "htf1h_below_sma20", "htf4h_below_sma20", "htf4h_rsi14_lt50", "htf1d_below_sma20",
    "sess_asia", "sess_eu", "sess_us", "weekday", "weekend", "near_30d_high", "far_below_30d_high", "upper_half_30d", "lower_half_30d",
)


def zero_seeded(x: Column, n: int) -> tuple[Column, Column]:
    """Steps of a mean that starts at zero and moves by 1 / n."""
    return F.lit(1 - 1 / n), F.coalesce(x, F.lit(0.0)) / n


def with_index(bars: DataFrame, periods: Sequence[int], fill: Sequence[str] = ()) -> DataFrame:
    """Bars with rsi_n over the whole history (NULL for the first n - 1 bars) and ``fill`` columns carried forward."""
    with ft.partitioned("symbol", "block"):
        move = F.col("close") - ft.ago(F.col("close"), 1)
        moved = ck.blocks(ck.numbered(bars), 1).withColumns({"up": F.greatest(move, F.lit(0.0)), "down": F.greatest(-move, F.lit(0.0))}).where("own").drop("own")
    moved = cut(moved)
    if fill:
        moved = ck.filled(moved, list(fill))
    done = ck.scanned(moved, {f"{side}_{n}": zero_seeded(F.col(side), n) for n in periods for side in ("up", "down")})
    index = lambda n: F.when(F.col("row_ix") >= n - 1, F.when(F.col(f"down_{n}") == 0, F.lit(100.0)).otherwise(100 - 100 / (1 + F.col(f"up_{n}") / F.col(f"down_{n}"))))
    # The first bar has no move.
    return done.withColumns({f"rsi_{n}": F.when(F.col("row_ix") > 0, index(n)) for n in periods}).drop("block", "up", "down", "row_ix", *[f"{s}_{n}" for n in periods for s in ("up", "down")])


def breadth(bars: DataFrame, days: int = 50, least: int = 10) -> DataFrame:
    """known, breadth: share of symbols whose daily close lies below its mean, once the day has closed; NULL for fewer symbols than ``least``."""
    daily = resample(bars, F.date_trunc("day", "ts").cast("timestamp_ntz"))
    below = ck.in_blocks(daily, days - 1, lambda d: d.select("ts", (F.col("close") < ft.sma(F.col("close"), days)).alias("below"), "__own"))
    share = F.when(F.count("below") >= least, F.avg(F.col("below").cast("int")))
    return below.groupBy("ts").agg(share.alias("breadth")).select((F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("known"), "breadth")


def funding_features(funding: DataFrame) -> DataFrame:
    """symbol, known, and the last rate, its median over 30 days and its mean over 7 days of ``funding`` (symbol, ts, rate)."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    over = lambda days: Window.partitionBy("symbol").orderBy("__at").rangeBetween(1 - days * 86_400_000_000, 0)
    d = funding.withColumn("__at", at)
    return d.select("symbol", F.col("ts").alias("known"), F.col("rate").alias("last_rate"), F.percentile("rate", F.lit(0.5)).over(over(30)).alias("median_rate"), F.avg("rate").over(over(7)).alias("mean_rate"))


def higher(bars: DataFrame, minutes: int, index: bool) -> DataFrame:
    """symbol, known, below, rsi of completed bars of ``minutes``: whether the close lies below its mean of 20, and the ``index`` of 14 if it is asked for."""
    closes = resample(bars, F.window("ts", f"{minutes} minutes").start.cast("timestamp_ntz"))
    indexed = cut(with_index(closes, (14,))) if index else closes.withColumn("rsi_14", F.lit(None).cast("double"))
    d = ck.in_blocks(indexed, 19, lambda d: d.select("symbol", "ts", (F.col("close") < ft.sma(F.col("close"), 20)).alias("below"), "rsi_14", "__own"))
    return d.select("symbol", (F.col("ts") + F.expr(f"INTERVAL {minutes} MINUTES")).alias("known"), "below", F.col("rsi_14").alias("rsi"))


def _sums(x: str) -> dict[str, Column]:
    run = ft.order().rowsBetween(Window.unboundedPreceding, 0)
    return {f"{x}_sum": F.sum(F.coalesce(x, F.lit(0.0))).over(run), f"{x}_n": F.count(x).over(run)}


def _mean(x: str, n: int) -> Column:
    """Mean of the last ``n`` rows from running sums; NULL unless all are there."""
    over = lambda c: F.col(c) - F.coalesce(ft.ago(F.col(c), n), F.lit(0))
    return F.when(over(f"{x}_n") == n, over(f"{x}_sum") / n)


def with_extreme(d: DataFrame, x: str, n: int, largest: bool, out: str) -> DataFrame:
    """The extreme of the last ``n`` rows in constant time a row: running extremes of segments of n rows, from both ends."""
    of, both = (F.max, F.greatest) if largest else (F.min, F.least)
    segment = Window.partitionBy("symbol", "block", "__segment")
    run = lambda order: segment.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("__segment", F.floor(F.col("row_ix") / n)).withColumns({"__head": of(x).over(run(F.col("ts"))), "__tail": of(x).over(run(F.col("ts").desc()))})
    return d.withColumn(out, F.when(F.col("row_ix") >= n - 1, both(F.col("__head"), ft.ago(F.col("__tail"), n - 1)))).drop("__segment", "__head", "__tail")


def conditions(bars: DataFrame, minutes: int, benchmark: str, funding: DataFrame | None, vol_filter: tuple[int, int] = (288, 90), least_breadth: int = 10) -> DataFrame:
    """symbol, ts, close and a boolean column for each of NAMES, on bars (stamped at their open) of ``minutes``.

    Higher timeframes no longer than the bars', and funding where there is none, never hold. NULLs (warm-up) never hold.
    """
    a_day = round(1440 / minutes)
    bars = cut(bars.select("symbol", "ts", "open", "high", "low", "close", "volume"))
    lead = bars.where(F.col("symbol") == benchmark).select("ts", F.col("close").alias("lead"))
    rows = cut(with_index(bars.join(lead, "ts", "left"), (14, 5), ("lead",)).withColumn("closes_at", F.col("ts") + F.expr(f"INTERVAL {minutes} MINUTES")))
    # The breadth is one series for all symbols: a row a day and symbol.
    shares = breadth(bars, least=least_breadth).withColumnRenamed("known", "breadth_at").crossJoin(bars.select("symbol").distinct())
    known = [(shares, "breadth_at", ["breadth"])]
    if funding is not None:
        known.append((funding_features(funding).withColumnRenamed("known", "funding_at"), "funding_at", ["last_rate", "median_rate", "mean_rate"]))
    for name, span in HIGHER.items():
        if span > minutes:
            known.append((higher(bars, span, name == "htf4h").withColumnsRenamed({"known": f"{name}_at", "below": f"{name}_below", "rsi": f"{name}_rsi"}), f"{name}_at", [f"{name}_below", f"{name}_rsi"]))
    rows = cut(asof_joins(rows, known, ("symbol",), "closes_at"))

    c, lead_ = F.col("close"), F.col("lead")
    back = lambda x, days: F.try_divide(x, F.nullif(ft.ago(x, days * a_day), F.lit(0.0))) - 1

    def look_back(d: DataFrame) -> DataFrame:
        d = d.withColumns(_sums("close") | _sums("lead"))
        d = with_extreme(with_extreme(d, "high", RANGE_DAYS * a_day, True, "top"), "low", RANGE_DAYS * a_day, False, "bottom")
        first = {"r": ft.growth(c), "lead_move": ft.log_growth(lead_), "usual_now": ft.full(F.col("volume"), a_day, F.percentile("volume", F.lit(0.5)).over(ft.last(a_day)))}
        first |= {f"lead_mean{n}": _mean("lead", n * a_day) for n in BENCHMARK_MEANS} | {f"close_mean{n}": _mean("close", n * a_day) for n in OWN_MEANS}
        first |= {f"lead_back{n}": back(lead_, n) for n in sorted({*BENCHMARK_RETURNS, *RELATIVE_RETURNS})} | {f"close_back{n}": back(c, n) for n in RELATIVE_RETURNS}
        then = {"usual": ft.ago(F.col("usual_now"), 1), "sigma_now": ft.sample_std(F.col("r"), a_day), "lead_vol": F.round(ft.sample_std(F.col("lead_move"), vol_filter[0]), VOL_DIGITS)}
        return d.withColumns(first).withColumns(then).withColumns({"sigma": ft.ago(F.col("sigma_now"), 1), "lead_ratio": ft.over_median(F.col("lead_vol"), max(vol_filter[1] * a_day, 2))})

    longest = max(max(BENCHMARK_MEANS), max(OWN_MEANS), RANGE_DAYS, vol_filter[1] + 1) * a_day + vol_filter[0]
    d = ck.in_blocks(rows, longest, look_back, max(1024, 2 * longest))
    close, high, low, volume = F.col("close"), F.col("high"), F.col("low"), F.col("volume")
    ratio, span = F.try_divide(volume, F.nullif(F.col("usual"), F.lit(0.0))), F.when(high > low, high - low)
    place, clv = F.try_divide(close - F.col("bottom"), F.when(F.col("top") > F.col("bottom"), F.col("top") - F.col("bottom"))), F.try_divide(close - low, span)
    hour, weekend = F.hour("closes_at"), F.weekday("closes_at") >= 5
    no = F.lit(False)
    out = {"none": F.lit(True)} | {f"btc_sma{n}d": lead_ < F.col(f"lead_mean{n}") for n in BENCHMARK_MEANS} | {f"btc_ret{n}d_neg": F.col(f"lead_back{n}") < 0 for n in BENCHMARK_RETURNS}
    out |= {"btc_vol_low": F.col("lead_ratio") < 1.0} | {f"rel{n}d_weak": F.col(f"close_back{n}") - F.col(f"lead_back{n}") < 0 for n in RELATIVE_RETURNS} | {f"coin_sma{n}d": close < F.col(f"close_mean{n}") for n in OWN_MEANS}
    out |= {"breadth_ge50": F.col("breadth") >= 0.5, "breadth_ge65": F.col("breadth") >= 0.65}
    rate = F.col("last_rate")
    out |= dict(zip(FUNDING, (rate > 0, rate > NEUTRAL, rate > F.col("median_rate"), F.col("mean_rate") > 0))) if funding is not None else dict.fromkeys(FUNDING, no)
    out |= {f"rsi{n}_lt{x}": F.col(f"rsi_{n}") < x for n, xs in BELOW.items() for x in xs} | {f"rsi{n}_gt{x}": F.col(f"rsi_{n}") > x for n, xs in ABOVE.items() for x in xs}
    out |= {"brk_vol_ge1.5": ratio >= 1.5, "brk_vol_ge2": ratio >= 2.0, "brk_vol_lt1": ratio < 1.0, "clv_le0.25": clv <= 0.25, "clv_ge0.5": clv >= 0.5}
    out |= {"bar_big_2sig": F.abs("r") >= 2 * F.col("sigma"), "bar_small_1sig": F.abs("r") < F.col("sigma")}
    for name, minutes_of in HIGHER.items():
        out[f"{name}_below_sma20"] = F.col(f"{name}_below") if minutes_of > minutes else no
    out["htf4h_rsi14_lt50"] = F.col("htf4h_rsi") < 50 if minutes < HIGHER["htf4h"] else no
    out |= {"sess_asia": hour < 8, "sess_eu": (hour >= 8) & (hour < 16), "sess_us": hour >= 16, "weekday": ~weekend, "weekend": weekend}
    out |= {"near_30d_high": close >= 0.9 * F.col("top"), "far_below_30d_high": close <= 0.8 * F.col("top"), "upper_half_30d": place >= 0.5, "lower_half_30d": place < 0.5}
    return cut(d.select("symbol", "ts", "close", *[F.coalesce(out[n], no).alias(n) for n in NAMES]))


def packed(masked: DataFrame, names: Sequence[str], by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """``by``, block, words, n: the masks of 64 rows each as an array of longs in the order of ``names``, and the number of rows."""
    numbered = ck.numbered(masked)
    bit = (F.col("row_ix") % 64).cast("int")
    word = lambda n: F.bit_or(F.when(F.col(f"`{n}`"), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)).otherwise(0))
    rows = numbered.groupBy(*by, F.floor(F.col("row_ix") / 64).alias("block")).agg(F.count("*").alias("n"), *[word(n).alias(f"w{i}") for i, n in enumerate(names)])
    return rows.select(*by, "block", F.array(*[f"w{i}" for i in range(len(names))]).alias("words"), "n")


def pair_hits(words: DataFrame, names: Sequence[str], win: str | None = None, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Hits of each pair of ``names`` together (n_both) and of either (n_either), by ``by``; ``win``: and how many of both hit that mask too.

    ``words``: of :func:`packed` by the same names, ``win`` last if given. One small relation of pairs meets a word a block and pair.
    """
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(i).alias("i"), F.lit(j).alias("j")) for (i, a), (j, b) in combinations(list(enumerate(names)), 2)])
    d = words.select(*by, "words", F.explode(pairs).alias("p"))
    x, y = F.get("words", F.col("p.i")), F.get("words", F.col("p.j"))
    sums = {"n_both": x.bitwiseAND(y), "n_either": x.bitwiseOR(y)} | ({"n_wins": x.bitwiseAND(y).bitwiseAND(F.get("words", F.lit(len(names))))} if win else {})
    return d.groupBy(*by, F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(*[F.sum(F.bit_count(e)).cast("bigint").alias(k) for k, e in sums.items()])
