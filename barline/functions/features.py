"""Causal features of ordered bars as Spark columns.

Rows are partitioned by symbol and ordered by ts. A window that is not full gives
NULL (never NaN), and so do zero denominators. Recursions are restarted in each
bar's own window of ``lookback`` bars, as a fold over the window's array.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

_PARTS: ContextVar[tuple[str, ...]] = ContextVar("parts", default=("symbol",))


@contextmanager
def partitioned(*columns: str) -> Iterator[None]:
    """Features built inside are windows over these columns: those of a symbol's blocks, say."""
    token = _PARTS.set(columns)
    try:
        yield
    finally:
        _PARTS.reset(token)


def order() -> WindowSpec:
    return Window.partitionBy(*_PARTS.get()).orderBy("ts")


def running() -> WindowSpec:
    return order().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def last(n: int) -> WindowSpec:
    return order().rowsBetween(1 - n, 0)


def full(x: Column, n: int, value: Column) -> Column:
    """``value`` where the last ``n`` rows all have ``x``."""
    return F.when(F.count(x).over(last(n)) == n, value)


def ago(x: Column, k: int) -> Column:
    if k < 0:
        raise ValueError("a feature must not look ahead")
    return F.lag(x, k).over(order())


def sma(x: Column, n: int) -> Column:
    return full(x, n, F.sum(x).over(last(n)) / n)


def rolling_max(x: Column, n: int) -> Column:
    return full(x, n, F.max(x).over(last(n)))


def rolling_min(x: Column, n: int) -> Column:
    return full(x, n, F.min(x).over(last(n)))


def std(x: Column, n: int) -> Column:
    """Population deviation, from sums that are exact for whole units."""
    s, q = F.sum(x).over(last(n)), F.sum(x * x).over(last(n))
    return full(x, n, F.sqrt(F.greatest(n * q - s * s, F.lit(0.0))) / n)


def zscore(x: Column, n: int) -> Column:
    return F.try_divide(x - sma(x, n), F.nullif(std(x, n), F.lit(0.0)))


def bollinger(x: Column, n: int, deviations: float, up: bool) -> Column:
    return sma(x, n) + (deviations if up else -deviations) * std(x, n)


def bandwidth(x: Column, n: int) -> Column:
    mean, dev = sma(x, n), std(x, n)
    return F.when((mean > 0) & (dev > 0), 4 * dev / (mean * F.sqrt(F.lit(float(n)))))


def band_ratio(x: Column, fast: int, slow: int) -> Column:
    return F.try_divide(bandwidth(x, fast), bandwidth(x, slow))


def spread_std(x: Column, y: Column, n: int) -> Column:
    return F.nullif(std(x - y, n), F.lit(0.0))


def true_range() -> Column:
    before = F.lag("close").over(order())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def smoothed(values: Column, n: int, alpha: float) -> Column:
    """Seeded recursion over an array: the mean of its first n values, then v += alpha * (x - v)."""
    seed = F.aggregate(F.slice(values, 1, n), F.lit(0.0), lambda a, x: a + x) / n
    rest = F.slice(values, F.lit(n + 1), F.greatest(F.size(values) - n, F.lit(0)))
    return F.when(F.size(values) >= n, F.aggregate(rest, seed, lambda a, x: a + alpha * (x - a)))


def window_array(x: Column, lookback: int) -> Column:
    return F.collect_list(x).over(last(lookback))


def ema(x: Column, n: int, lookback: int) -> Column:
    return smoothed(window_array(x, lookback), n, 2 / (n + 1))


def atr_of(ranges: Column, n: int) -> Column:
    """Wilder's average over an array of true ranges."""
    return smoothed(ranges, n, 1 / n)


def rsi_of(closes: Column, n: int) -> Column:
    """Wilder's index over an array of closes; 100 without losses."""
    moves = F.zip_with(F.slice(closes, F.lit(2), F.greatest(F.size(closes) - 1, F.lit(0))), F.slice(closes, F.lit(1), F.greatest(F.size(closes) - 1, F.lit(0))), lambda b, a: b - a)
    gain = smoothed(F.transform(moves, lambda d: F.greatest(d, F.lit(0.0))), n, 1 / n)
    loss = smoothed(F.transform(moves, lambda d: F.greatest(-d, F.lit(0.0))), n, 1 / n)
    return F.when(loss == 0, F.lit(100.0)).otherwise(100 - 100 / (1 + gain / loss))


def cross_up(a: Column, b: Column) -> Column:
    return F.coalesce((ago(a, 1) <= ago(b, 1)) & (a > b), F.lit(False))


def cross_down(a: Column, b: Column) -> Column:
    return F.coalesce((ago(a, 1) >= ago(b, 1)) & (a < b), F.lit(False))


def donchian_low(n: int) -> Column:
    before = order().rowsBetween(-n, -1)
    return F.when(F.count("low").over(before) == n, F.min("low").over(before))


def momentum_sign(x: Column, lookbacks: list[int]) -> Column:
    """Mean of the signs of returns over several lookbacks."""
    signs = [F.signum(x - ago(x, k)) for k in lookbacks]
    total = signs[0]
    for s in signs[1:]:
        total = total + s
    return total / len(lookbacks)


def close_location() -> Column:
    return F.try_divide(2 * F.col("close") - F.col("high") - F.col("low"), F.nullif(F.col("high") - F.col("low"), F.lit(0.0)))


def fill_forward(x: Column) -> Column:
    return F.last(x, ignorenulls=True).over(running())


def zero_seeded_rsi(closes: Column, n: int) -> Column:
    """Index over an array of closes whose averages start at zero; NULL for the first n - 1 moves."""
    moves = F.zip_with(F.slice(closes, F.lit(2), F.greatest(F.size(closes) - 1, F.lit(0))), F.slice(closes, F.lit(1), F.greatest(F.size(closes) - 1, F.lit(0))), lambda b, a: b - a)
    a = 1 / n
    gain = F.aggregate(moves, F.lit(0.0), lambda v, d: v + a * (F.greatest(d, F.lit(0.0)) - v))
    loss = F.aggregate(moves, F.lit(0.0), lambda v, d: v + a * (F.greatest(-d, F.lit(0.0)) - v))
    return F.when(F.size(moves) >= n - 1, F.when(loss == 0, F.lit(100.0)).otherwise(100 - 100 / (1 + gain / loss)))


def half_life_deviation(values: Column, half_life: float, least: int) -> Column:
    """Square root of the half-life weighted mean square of an array (newest last)."""
    keep = 0.5 ** (1 / half_life)
    sums = F.aggregate(values, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w")), lambda v, x: F.struct((v["s"] * keep + x * x).alias("s"), (v["w"] * keep + 1).alias("w")))
    return F.when(F.size(values) >= least, F.sqrt(sums["s"] / sums["w"]))


def atr(n: int, lookback: int) -> Column:
    """Wilder's average true range; the range stands in a column ``range``."""
    return atr_of(window_array(F.col("range"), lookback), n)


def ewm_rsi(closes: Column, n: int) -> Column:
    """Index over an array of closes whose averages begin with the first move."""
    k = F.greatest(F.size(closes) - 1, F.lit(0))
    moves = F.zip_with(F.slice(closes, F.lit(2), k), F.slice(closes, F.lit(1), k), lambda b, a: b - a)
    a = 1 / n

    def average(sign: int) -> Column:
        parts = F.transform(moves, lambda d: F.greatest(sign * d, F.lit(0.0)))
        return F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), F.get(parts, F.lit(0)), lambda v, x: v + a * (x - v))

    gain, loss = average(1), average(-1)
    return F.when(k >= n, F.when(loss == 0, F.lit(100.0)).otherwise(100 - 100 / (1 + gain / loss)))


def growth(x: Column, k: int = 1) -> Column:
    """Return over ``k`` rows; NULL where the start is zero."""
    return F.try_divide(x, F.nullif(ago(x, k), F.lit(0.0))) - 1


def log_growth(x: Column) -> Column:
    """Log return over a row; NULL unless both values are positive."""
    before = ago(x, 1)
    return F.when((x > 0) & (before > 0), F.ln(x / before))


def sample_std(x: Column, n: int) -> Column:
    return full(x, n, F.stddev_samp(x).over(last(n)))


def over_median(x: Column, n: int) -> Column:
    """``x`` over the median of its last ``n`` values; a third of them must be there."""
    w = last(n)
    return F.when(F.count(x).over(w) >= n // 3, F.try_divide(x, F.nullif(F.percentile(x, F.lit(0.5)).over(w), F.lit(0.0))))


def efficiency(x: Column, n: int) -> Column:
    """Net move over the sum of the moves; NULL on a flat window. ``x`` must have a column ``step`` of absolute moves beside it."""
    return F.try_divide(F.abs(x - ago(x, n)), F.nullif(full(F.col("step"), n, F.sum("step").over(last(n))), F.lit(0.0)))


def ewm_deviation(values: Column, half_life: float, least: int) -> Column:
    """Sample deviation of an array (newest last) with half-life weights, corrected for bias."""
    keep = 0.5 ** (1 / half_life)
    zero = F.struct(*[F.lit(0.0).alias(k) for k in ("w", "w2", "x", "xx")])
    s = F.aggregate(values, zero, lambda v, x: F.struct((v["w"] * keep + 1).alias("w"), (v["w2"] * (keep * keep) + 1).alias("w2"), (v["x"] * keep + x).alias("x"), (v["xx"] * keep + x * x).alias("xx")))
    mean = s["x"] / s["w"]
    biased = F.greatest(s["xx"] / s["w"] - mean * mean, F.lit(0.0))
    return F.when(F.size(values) >= least, F.sqrt(biased * s["w"] * s["w"] / (s["w"] * s["w"] - s["w2"])))
