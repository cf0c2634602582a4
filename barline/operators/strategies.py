"""Band strategies as data: one engine for every entry mode, filter and exit.

A setup's entry is a boolean column over shared features, its trades are a join of
fired signals to the bars of their holding time, its exit is the first bar on which
a rule holds. Results are in units of the risk taken (R), after fees. Only which of
the candidate trades are taken while others are open is decided row by row, over
candidates alone.

Rules: entry at the signal's close; from the next bar on, in this order: timeout (at
the close), stop, take profit, the data's last bar, an exit of an indicator (at the
close); a trailing stop moves after a bar and counts from the next one. NULL features
(warm-up) never fire. Recursive features restart in each bar's last LOOKBACK bars.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barline.functions import features as ft

#: Entry fee by risk ratio, fee a fee period held, largest entry fee in R that is still taken.
ENTRY_FEE, HOLDING_FEE, MOST_FEE = 0.001, 0.0001, 0.2
#: Bars in which recursive features restart.
LOOKBACK = 64


@dataclass(frozen=True)
class Setup:
    """One parametrisation; ``None`` switches a filter off.

    mode: "breakout" (the close passes its band outward), "leaving" (it falls back through
    the opposite band) or "returning" (it comes back over the opposite band).
    ``take_profit``: multiple of the risk, 0 for none, -1 for the middle band at entry.
    ``exit_rule``: "rsi", "donchian", "chandelier" or "pctb" with ``exit_level``.
    ``most_open``: positions at once; None for any number.
    """

    name: str
    side: int = 1
    mode: str = "breakout"
    window: int = 20
    deviations: float = 2.0
    rsi_window: int | None = None
    rsi_level: float = 50.0
    trend_window: int | None = None
    volume_window: int | None = None
    volume_multiple: float = 1.0
    ratio_of: str | None = None  # "atr" or "band": fast over slow on the bar before
    ratio_fast: int = 5
    ratio_slow: int = 20
    ratio_most: float = 99.0
    width_most: float | None = None  # band width over its trailing median
    vol_most: float | None = None  # deviation of moves over its trailing median
    median_window: int = 60
    stop_multiple: float = 1.0
    take_profit: float = 2.0
    hold: int = 20
    trail: float = 0.0
    exit_rule: str | None = None
    exit_level: float = 0.0
    most_open: int | None = None
    fee_bars: int = 1


def with_arrays(bars: DataFrame, setups: list[Setup]) -> DataFrame:
    """Bars with the window arrays and true ranges that the setups' recursive features need."""
    out = bars
    if any(s.rsi_window for s in setups):
        out = out.withColumn("closes", ft.window_array(F.col("close"), LOOKBACK))
    if any(s.ratio_of == "atr" or s.exit_rule == "chandelier" for s in setups):
        out = out.withColumn("range", ft.true_range()).withColumn("ranges", ft.window_array(F.col("range"), LOOKBACK))
    if any(s.vol_most is not None for s in setups):
        out = out.withColumn("move", F.col("close") - ft.ago(F.col("close"), 1))
    return out


def median_ratio(x: Column, n: int) -> Column:
    """``x`` over the median of its last ``n`` values, a third of which must be there."""
    w = ft.last(n)
    return F.when(F.count(x).over(w) >= n // 3, F.try_divide(x, F.nullif(F.percentile(x, F.lit(0.5)).over(w), F.lit(0.0))))


def with_features(bars: DataFrame, s: Setup) -> DataFrame:
    """Numbered bars with the columns that a setup's entry and exit look at."""
    c = F.col("close")
    d = with_arrays(bars, [s]).withColumns({"bar_ix": (F.row_number().over(ft.order()) - 1).cast("bigint"), "upper": ft.bollinger(c, s.window, s.deviations, True), "lower": ft.bollinger(c, s.window, s.deviations, False), "before": ft.ago(c, 1)})
    d = d.withColumn("last_ix", F.max("bar_ix").over(Window.partitionBy("symbol")))
    if s.rsi_window:
        d = d.withColumn("rsi", ft.zero_seeded_rsi(F.col("closes"), s.rsi_window))
    if s.trend_window:
        d = d.withColumn("trend", ft.sma(c, s.trend_window))
    if s.volume_window:
        d = d.withColumn("volume_mean", ft.sma(F.col("volume"), s.volume_window)).withColumn("usual_volume", ft.ago(F.col("volume_mean"), 1))
    if s.ratio_of:
        fast, slow = (ft.atr_of(F.col("ranges"), n) if s.ratio_of == "atr" else ft.bandwidth(c, n) for n in (s.ratio_fast, s.ratio_slow))
        d = d.withColumn("ratio_now", F.when(slow > 0, fast / slow)).withColumn("ratio", ft.ago(F.col("ratio_now"), 1))
    if s.width_most is not None:
        d = d.withColumn("width", F.col("upper") - F.col("lower")).withColumn("width_ratio", median_ratio(F.col("width"), s.median_window))
    if s.vol_most is not None:
        d = d.withColumn("vol", ft.std(F.col("move"), s.window)).withColumn("vol_ratio", median_ratio(F.col("vol"), s.median_window))
    if s.exit_rule == "donchian":
        d = d.withColumn("channel", ft.donchian_low(int(s.exit_level)))
    if s.exit_rule == "chandelier":
        d = d.withColumn("atr", ft.atr_of(F.col("ranges"), 20))
    return d


def entry(s: Setup) -> Column:
    c, before, up, low = F.col("close"), F.col("before"), F.col("upper"), F.col("lower")
    if s.mode == "breakout":
        hit = (before < up) & (c > up) if s.side > 0 else (before > low) & (c < low)
    else:
        band = low if s.side > 0 else up
        falls, rises = (before > band) & (c < band), (before < band) & (c > band)
        hit = (falls if s.side > 0 else rises) if s.mode == "leaving" else (rises if s.side > 0 else falls)
    if s.rsi_window:
        hit = hit & ((F.col("rsi") > s.rsi_level) if (s.side > 0) == (s.mode == "breakout") else (F.col("rsi") < s.rsi_level))
    if s.trend_window:
        hit = hit & (s.side * (c - F.col("trend")) > 0)
    if s.volume_window:
        hit = hit & (F.col("volume") > s.volume_multiple * F.col("usual_volume"))
    if s.ratio_of:
        hit = hit & (F.col("ratio") < s.ratio_most)
    if s.width_most is not None:
        hit = hit & (F.col("width_ratio") <= s.width_most)
    if s.vol_most is not None:
        hit = hit & (F.col("vol_ratio") < s.vol_most)
    return F.coalesce(hit, F.lit(False))


def candidates(featured: DataFrame, s: Setup, every: bool = False) -> DataFrame:
    """symbol, entry_ix, entry_price, risk, stop, target of each signal that may be traded; ``every``: of each bar that could be one."""
    c, up, low = F.col("close"), F.col("upper"), F.col("lower")
    base = (c - low if s.side > 0 else up - c) if s.mode == "breakout" else up - low
    d = featured.where(F.lit(True) if every else entry(s)).where("bar_ix < last_ix").select("symbol", F.col("bar_ix").alias("entry_ix"), c.alias("entry_price"), (base * s.stop_multiple).alias("risk"), ((up + low) / 2).alias("middle"), "last_ix")
    d = d.where((F.col("entry_price") > 0) & (F.col("risk") > 0)).where(ENTRY_FEE * F.col("entry_price") <= MOST_FEE * F.col("risk"))
    price, risk = F.col("entry_price"), F.col("risk")
    target = F.col("middle") if s.take_profit < 0 else (price + s.side * s.take_profit * risk if s.take_profit > 0 else F.lit(None).cast("double"))
    d = d.withColumns({"stop": price - s.side * risk, "target": target})
    return d.where(s.side * (F.col("target") - price) > 0) if s.take_profit < 0 else d


def exits(featured: DataFrame, signals: DataFrame, s: Setup) -> DataFrame:
    """Each signal with its exit: exit_ix, outcome, gross_r, net_r. Any number may be open at once.

    The bars of a holding time join by symbol and a bucket of bar numbers; running extremes are windows over them.
    """
    keep = ["symbol", F.col("bar_ix").alias("at"), "high", "low", "close", "upper", "lower", *[c for c in ("rsi", "channel", "atr") if c in featured.columns]]
    later = featured.select(*keep, F.floor(F.col("bar_ix") / s.hold).cast("bigint").alias("bucket")).withColumnsRenamed({"upper": "upper_now", "lower": "lower_now"})
    spread = signals.withColumn("bucket", F.explode(F.sequence(F.floor((F.col("entry_ix") + 1) / s.hold).cast("bigint"), F.floor((F.col("entry_ix") + s.hold) / s.hold).cast("bigint"))))
    path = spread.join(later, ["symbol", "bucket"]).where((F.col("at") > F.col("entry_ix")) & (F.col("at") <= F.col("entry_ix") + s.hold))
    price, risk, close, side = F.col("entry_price"), F.col("risk"), F.col("close"), s.side
    walk = Window.partitionBy("symbol", "entry_ix").orderBy("at")
    stop = F.col("stop")
    if s.trail > 0:
        best_before = F.max("high").over(walk.rowsBetween(Window.unboundedPreceding, -1))
        stop = F.greatest(stop, F.greatest(price, best_before) - s.trail * risk)
        path = path.withColumn("stop_now", F.when(best_before.isNull(), F.col("stop")).otherwise(stop))
    else:
        path = path.withColumn("stop_now", stop)
    if s.exit_rule == "chandelier":
        path = path.withColumn("best", F.greatest(price, F.max("high").over(walk.rowsBetween(Window.unboundedPreceding, 0))))
    stopped = F.col("low") <= F.col("stop_now") if side > 0 else F.col("high") > F.col("stop_now")
    reached = F.lit(False) if s.take_profit == 0 else (F.col("high") >= F.col("target") if side > 0 else F.col("low") < F.col("target"))
    width = F.col("upper_now") - F.col("lower_now")
    leaves = {
        None: F.lit(False),
        "rsi": F.col("rsi") < s.exit_level if s.exit_rule == "rsi" else None,
        "donchian": close < F.col("channel") if s.exit_rule == "donchian" else None,
        "chandelier": close < F.col("best") - s.exit_level * F.col("atr") if s.exit_rule == "chandelier" else None,
        "pctb": (width > 0) & (F.try_divide(close - F.col("lower_now"), width) < s.exit_level) if s.exit_rule == "pctb" else None,
    }[s.exit_rule]
    out = (
        F.when(F.col("at") - F.col("entry_ix") >= s.hold, "timeout")
        .when(stopped, F.when(F.col("stop_now") == F.col("stop"), "stop").otherwise("trail"))
        .when(reached, "target")
        .when(F.col("at") == F.col("last_ix"), "end")
        .when(F.coalesce(leaves, F.lit(False)), f"exit_{s.exit_rule}")
    )
    path = path.withColumn("outcome", out).where("outcome IS NOT NULL")
    first = path.groupBy("symbol", "entry_ix", "entry_price", "risk", "stop", "target").agg(F.min_by(F.struct("at", "outcome", "close", "stop_now"), "at").alias("x"))
    market = side * (F.col("x.close") - price) / risk
    gross = F.when(F.col("x.outcome") == "stop", F.lit(-1.0)).when(F.col("x.outcome") == "trail", side * (F.col("x.stop_now") - price) / risk).when(F.col("x.outcome") == "target", side * (F.col("target") - price) / risk if s.take_profit < 0 else F.lit(float(s.take_profit))).otherwise(market)
    fees = ENTRY_FEE * price / risk + HOLDING_FEE * ((F.col("x.at") - F.col("entry_ix")) / s.fee_bars) * price / risk
    return first.select("symbol", "entry_ix", "entry_price", "risk", F.col("x.at").alias("exit_ix"), F.col("x.outcome").alias("outcome"), gross.alias("gross_r"), (gross - fees).alias("net_r"))


def taken(trades: DataFrame, most_open: int | None) -> DataFrame:
    """The trades that are taken if at most ``most_open`` may be open: in order of entry, unless all places are held.

    A trade holds its place on its exit's bar too. Rows of a symbol stream in order; a task holds the open trades alone.
    """
    if most_open is None:
        return trades

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol, held = None, []
        for batch in batches:
            names, entries, ends = batch.column("symbol").to_pylist(), batch.column("entry_ix").to_pylist(), batch.column("exit_ix").to_pylist()
            ok = np.zeros(len(names), bool)
            for k, (name, at, end) in enumerate(zip(names, entries, ends)):
                if name != symbol:
                    symbol, held = name, []
                held = [x for x in held if x >= at]
                if len(held) < most_open:
                    ok[k] = True
                    held.append(end)
            yield batch.filter(pa.array(ok))

    return trades.repartition("symbol").sortWithinPartitions("symbol", "entry_ix").mapInArrow(run, trades.schema)


def trades_of(bars: DataFrame, s: Setup) -> DataFrame:
    featured = with_features(bars, s)
    return taken(exits(featured, candidates(featured, s), s), s.most_open)


def random_entries(bars: DataFrame, s: Setup, runs: int, seed: str = "entries") -> DataFrame:
    """symbol, n_trades, mean_r, n_runs, null_mean, percentile: a setup's trades against entries at random.

    Each run enters on any bar whose trade the setup's risk allows, with the probability that gives as many
    entries as the setup has; stop, target, exits and fees are the setup's. A draw is a digest of the seed, the run, the symbol and the
    bar's number, so it's the same on any layout. Outcomes of all bars are resolved once for all runs. percentile:
    share of runs (with entries) whose mean is below the setup's. Any number of positions may be open.
    """
    featured = with_features(bars, s)
    hits = featured.where(entry(s)).select("symbol", F.col("bar_ix").alias("entry_ix"), F.lit(True).alias("real"))
    done = exits(featured, candidates(featured, s, every=True), s).join(hits, ["symbol", "entry_ix"], "left").select("symbol", "entry_ix", "net_r", F.coalesce("real", F.lit(False)).alias("real"))
    real = done.groupBy("symbol").agg(F.count_if("real").alias("n_trades"), F.avg(F.when(F.col("real"), F.col("net_r"))).alias("mean_r"), (F.count_if("real") / F.count("*")).alias("p"))
    drawn = done.join(real, "symbol").withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(runs))))
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.col("run"), F.col("symbol"), F.col("entry_ix")))
    draw = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)
    nulls = drawn.where(draw < F.col("p")).groupBy("symbol", "run").agg(F.avg("net_r").alias("null_r"))
    told = nulls.join(real.select("symbol", F.col("mean_r").alias("r")), "symbol").groupBy("symbol").agg(F.count("*").alias("n_runs"), F.avg("null_r").alias("null_mean"), (F.count_if(F.col("null_r") < F.col("r")) / F.count("*")).alias("percentile"))
    return real.join(told, "symbol").select("symbol", "n_trades", "mean_r", "n_runs", "null_mean", "percentile")
