"""Bracket trades as relations: entries at the next open, exits at the first touched level.

With no limit on open positions each signal is a trade of its own, so trades are a
join of signals to the bars of their holding time. The join has an equi-key
(symbol and a bucket of bar numbers), never a bare range condition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.functions import features as ft


def numbered(bars: DataFrame) -> DataFrame:
    """Bars with bar_ix, the bar's number within its symbol from 0."""
    return bars.withColumn("bar_ix", (F.row_number().over(ft.order()) - 1).cast("bigint"))


def bracket_trades(bars: DataFrame, signals: DataFrame, hold: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row a signal (symbol, bar_ix, stop_distance, target_distance and ``keys``) with an entry bar.

    Long only: entry at the open after the signal's bar; stop and target lie around
    the signal's close. On a bar that touches both, the stop wins; a gap fills at
    the open; after ``hold`` bars the close ends the trade, and so do the data's last bars.
    """
    b = bars.select("symbol", "bar_ix", "open", "high", "low", "close")
    entry = b.select("symbol", (F.col("bar_ix") - 1).alias("bar_ix"), F.col("open").alias("entry_price"))
    s = signals.join(b.select("symbol", "bar_ix", F.col("close").alias("signal_close")), ["symbol", "bar_ix"]).join(entry, ["symbol", "bar_ix"])
    s = s.withColumn("stop", F.col("signal_close") - F.col("stop_distance")).withColumn("target", F.col("signal_close") + F.col("target_distance"))
    spread = s.withColumn("bucket", F.explode(F.sequence(F.floor((F.col("bar_ix") + 1) / hold).cast("bigint"), F.floor((F.col("bar_ix") + hold) / hold).cast("bigint"))))
    later = b.select("symbol", F.col("bar_ix").alias("at"), F.floor(F.col("bar_ix") / hold).cast("bigint").alias("bucket"), "open", "high", "low", "close")
    path = spread.join(later, ["symbol", "bucket"]).where((F.col("at") > F.col("bar_ix")) & (F.col("at") <= F.col("bar_ix") + hold))
    stop_hit, target_hit = F.col("low") <= F.col("stop"), F.col("high") >= F.col("target")
    step = F.struct(
        "at",
        F.when(stop_hit, F.lit("stop")).when(target_hit, F.lit("target")).alias("outcome"),
        F.when(stop_hit, F.least("open", "stop")).when(target_hit, F.greatest("open", "target")).alias("price"),
    )
    trade = ["symbol", "bar_ix", *keys, "entry_price", "stop_distance"]
    done = path.groupBy(*trade).agg(F.min(F.when(stop_hit | target_hit, step)).alias("hit"), F.max(F.struct("at", "close")).alias("end"))
    return done.select(
        "symbol",
        "bar_ix",
        *keys,
        "entry_price",
        F.coalesce("hit.at", "end.at").alias("exit_ix"),
        F.coalesce("hit.price", "end.close").alias("exit_price"),
        F.coalesce("hit.outcome", F.lit("timeout")).alias("outcome"),
        F.try_divide(F.coalesce("hit.price", "end.close") - F.col("entry_price"), F.col("stop_distance")).alias("gross_r"),
    )


def open_positions(bars: DataFrame, trades: DataFrame) -> DataFrame:
    """symbol, bar_ix, n_open for every bar: starts and ends as signed steps, summed in order (no interval join)."""
    steps = trades.select("symbol", (F.col("bar_ix") + 1).alias("bar_ix"), F.lit(1).alias("step")).union(trades.select("symbol", "exit_ix", F.lit(-1)))
    per_bar = steps.groupBy("symbol", "bar_ix").agg(F.sum("step").alias("step"))
    joined = bars.select("symbol", "ts", "bar_ix").join(per_bar, ["symbol", "bar_ix"], "left")
    return joined.select("symbol", "bar_ix", F.sum(F.coalesce("step", F.lit(0))).over(ft.running()).alias("n_open"))
