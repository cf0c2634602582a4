"""Leak checks of any plan: does what lies after a cut change what a feature said before it?

A feature is a function from bars to bars with more columns. It is computed over all bars, over the
bars up to each cut (truncated), and over all bars with the prices and volumes after the cut
changed (perturbed). A value at or before the cut that differs has looked ahead. Truncation alone misses
features that fill in for missing bars; perturbation alone misses those that only count them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODES = ("truncated", "perturbed")


def shaken(day: Column) -> Column:
    """A factor from 1 1/16 to 1 13/16 that a day gives: exact in binary, another one on most days."""
    return 1 + (day * 7919 % 13 + 1) / 16.0


def variants(bars: DataFrame, cuts: Sequence, factor: Callable[[Column], Column] = shaken) -> DataFrame:
    """Bars once for each cut and mode: cut (its number), mode, cut_ts and the bars as they are in it."""
    kinds = F.explode(F.array(*[F.struct(F.lit(i).alias("cut"), F.lit(mode).alias("mode"), F.lit(c).cast(bars.schema["ts"].dataType).alias("cut_ts")) for i, c in enumerate(cuts) for mode in MODES]))
    d = bars.withColumn("__v", kinds).select("*", "__v.*").drop("__v").where((F.col("mode") == "perturbed") | (F.col("ts") <= F.col("cut_ts")))
    after = F.col("ts") > F.col("cut_ts")
    by = factor(F.datediff("ts", F.lit("1970-01-01").cast("date")))
    return d.withColumns({c: F.when(after, F.col(c) * by).otherwise(F.col(c)) for c in ("open", "high", "low", "close", "volume")})


def leak_check(bars: DataFrame, feature: Callable[[DataFrame], DataFrame], columns: Sequence[str], cuts: Sequence, tolerance: float = 1e-9, across: bool = False) -> DataFrame:
    """cut, mode, feature, n, n_changed, first_ts (the first changed bar), causal, for each cut, mode and column.

    ``feature`` keeps symbol and ts. Where it looks at one symbol at a time, all variants are symbols of
    one call, so there is one plan for all cuts; ``across`` (it looks across symbols): one call a variant.
    Equal is NULL and NULL, or numbers within ``tolerance``.
    """
    spread = variants(bars, cuts)
    if across:
        one = lambda i, mode: feature(spread.where((F.col("cut") == i) & (F.col("mode") == mode)).drop("cut", "mode", "cut_ts")).select("symbol", "ts", *columns).withColumns({"cut": F.lit(i), "mode": F.lit(mode)})
        cut = reduce(DataFrame.unionByName, [one(i, mode) for i in range(len(cuts)) for mode in MODES])
    else:
        tag = F.to_json(F.struct("cut", "mode", "symbol"))
        told = feature(spread.withColumn("symbol", tag).drop("cut", "mode", "cut_ts")).select(F.from_json("symbol", "cut int, mode string, symbol string").alias("v"), "ts", *columns)
        cut = told.select("v.*", "ts", *columns)
    full = feature(bars).select("symbol", "ts", *[F.col(c).alias(f"__{c}") for c in columns])
    at = F.get(F.array(*[F.lit(c).cast(bars.schema["ts"].dataType) for c in cuts]), F.col("cut"))
    j = cut.where(F.col("ts") <= at).join(full, ["symbol", "ts"])
    same = lambda c: F.col(c).eqNullSafe(F.col(f"__{c}")) | F.coalesce(F.abs(F.col(c).cast("double") - F.col(f"__{c}").cast("double")) <= tolerance, F.lit(False))
    long = j.select("cut", "mode", "ts", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), same(c).alias("same")) for c in columns])).alias("x")).select("cut", "mode", "ts", "x.*")
    out = long.groupBy("cut", "mode", "feature").agg(F.count("*").alias("n"), F.count_if(~F.col("same")).alias("n_changed"), F.min(F.when(~F.col("same"), F.col("ts"))).alias("first_ts"))
    return out.withColumn("causal", F.col("n_changed") == 0)
