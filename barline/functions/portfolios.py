"""Portfolios of many campaigns at once as relations: representatives, the correlation filter in rounds, weights, returns.

Nothing is collected. Relations are keyed by ``campaign``; the trials of one are few by nature (its pairs are the square of their
number), campaigns and points are not.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.operators.lineage import cut

KEY = ["campaign"]


def net_returns(bars: DataFrame, side: Column, cost: float) -> DataFrame:
    """symbol, ts, ret of holding the side that the bar before decided, less the cost of what was turned over for it.

    ``side`` is decided at a bar's close (NULL: flat); a bar without one before it has no return.
    """
    w = Window.partitionBy("symbol").orderBy("ts")
    d = bars.select("symbol", "ts", "close", F.coalesce(side.cast("double"), F.lit(0.0)).alias("side"))
    held, before = (F.coalesce(F.lag("side", k).over(w), F.lit(0.0)) for k in (1, 2))
    move = F.try_divide("close", F.nullif(F.lag("close").over(w), F.lit(0.0))) - 1
    return d.select("symbol", "ts", (held * move - cost * F.abs(held - before)).alias("ret")).where("ret IS NOT NULL")


def on_days(returns: DataFrame, keys: list[str]) -> DataFrame:
    """Returns compounded by day; a bar is labelled by its close, so one that closes at midnight belongs to the day before.

    Labels are the ends of days. A day of one bar keeps its return as it is.
    """
    day = F.date_trunc("day", "ts")
    label = F.when(F.col("ts") == day, day).otherwise(day + F.expr("INTERVAL 1 DAY")).cast("timestamp_ntz")
    g = returns.groupBy(*keys, label.alias("ts")).agg(F.product(1 + F.col("ret")).alias("__p"), F.count("*").alias("__n"), F.min("ret").alias("__r"))
    return g.select(*keys, "ts", F.when(F.col("__n") == 1, F.col("__r")).otherwise(F.col("__p") - 1).alias("ret"))


def annual_ratio(ret: Column, periods_per_year: float) -> Column:
    """Mean over sample deviation a year, as an aggregate; 0 where nothing deviates."""
    dev = F.stddev_samp(ret)
    return F.when(dev > 0, F.avg(ret) / dev * periods_per_year**0.5).otherwise(F.lit(0.0))


def representatives(trials: DataFrame) -> DataFrame:
    """campaign, trial, score, place: the best trial of each cell (the earlier on a tie), ranked by score in its campaign.

    ``trials``: campaign, trial, cell, score. A trial without a cell stands for itself; one without a score is left out.
    """
    order = [F.desc("score"), "trial"]
    own = F.coalesce(F.concat(F.lit("c"), F.col("cell").cast("string")), F.concat(F.lit("t"), F.col("trial").cast("string")))
    d = trials.where(F.col("score").isNotNull() & ~F.isnan("score")).withColumn("__own", own)
    best = d.withColumn("__n", F.row_number().over(Window.partitionBy("campaign", "__own").orderBy(*order))).where("__n = 1")
    return best.select("campaign", "trial", "score", F.row_number().over(Window.partitionBy("campaign").orderBy(*order)).cast("bigint").alias("place"))


def correlations(ranked: DataFrame, returns: DataFrame, least: int) -> DataFrame:
    """campaign, trial, other, rho of each ranked trial with the better ones, on the points that both have; NULL below ``least`` of them, or if one doesn't move."""
    mine = returns.join(ranked.select("campaign", "trial", "place"), ["campaign", "trial"])
    a = mine.select("campaign", "ts", "trial", "place", F.col("ret").alias("x"))
    b = mine.select("campaign", "ts", F.col("trial").alias("other"), F.col("place").alias("better"), F.col("ret").alias("y"))
    g = a.join(b, ["campaign", "ts"]).where("better < place").groupBy("campaign", "trial", "other").agg(F.count("*").alias("n"), F.covar_pop("x", "y").alias("cov"), F.stddev_pop("x").alias("dx"), F.stddev_pop("y").alias("dy"))
    measured = (F.col("n") >= least) & (F.col("dx") > 0) & (F.col("dy") > 0)
    return g.select("campaign", "trial", "other", F.when(measured, F.col("cov") / F.col("dx") / F.col("dy")).alias("rho"))


def decorrelated(ranked: DataFrame, rho: DataFrame, most: float) -> DataFrame:
    """``ranked`` with ``kept``: in order of place each trial stays that correlates with no kept one by more than ``most``, up or down.

    A pair without a measured correlation counts as one that correlates. The walk is done in rounds for all campaigns together: a trial
    goes once it fits fewer of the better ones that stay than there are, and stays once it fits all better ones that stay or are
    open. The best open trial of a campaign is settled in every round; the rounds are as many as the longest chain of conflicts.
    """
    fits = cut(rho.where(F.coalesce(F.abs("rho") <= most, F.lit(False)) & ~F.isnan("rho")).select("campaign", "trial", "other"))
    state = cut(ranked.withColumn("kept", F.lit(None).cast("boolean")))
    before = Window.partitionBy("campaign").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    open_ = F.col("kept").isNull()
    while not state.where(open_).isEmpty():
        others = state.where(F.coalesce("kept", F.lit(True))).select("campaign", F.col("trial").alias("other"), F.col("kept").alias("stays"))
        met = fits.join(others, ["campaign", "other"]).groupBy("campaign", "trial").agg(F.count_if(F.col("stays")).alias("fits_kept"), F.count_if(F.col("stays").isNull()).alias("fits_open"))
        counted = state.withColumns({"n_kept": F.coalesce(F.count_if(F.col("kept")).over(before), F.lit(0)), "n_open": F.coalesce(F.count_if(open_).over(before), F.lit(0))})
        of = lambda c: F.coalesce(c, F.lit(0))
        now = F.when(~open_, F.col("kept")).when(of("fits_kept") < F.col("n_kept"), False).when(of("fits_open") == F.col("n_open"), True)
        state = cut(counted.join(met, ["campaign", "trial"], "left").select(*ranked.columns, now.alias("kept")))
    return state


def members(kept: DataFrame, most: int) -> DataFrame:
    """campaign, trial, place of the first ``most`` that stay."""
    w = Window.partitionBy("campaign").orderBy("place")
    return kept.where("kept").withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).select("campaign", "trial", "place")


def common_points(chosen: DataFrame, returns: DataFrame) -> DataFrame:
    """Returns of the members at the points that all members of their campaign have."""
    size = chosen.groupBy("campaign").agg(F.count("*").alias("__size"))
    mine = returns.join(chosen.select("campaign", "trial"), ["campaign", "trial"])
    full = mine.groupBy("campaign", "ts").agg(F.count("*").alias("__k")).join(size, "campaign").where("__k = __size").select("campaign", "ts")
    return mine.join(full, ["campaign", "ts"], "left_semi")


def weights(common: DataFrame, least: int) -> DataFrame:
    """campaign, trial, n_common, weight, reason: shares by inverse sample deviation; a member that doesn't move has weight 0.

    A campaign of fewer than ``least`` common points, or in which nothing moves, has NULL weights and a reason.
    """
    v = common.groupBy("campaign", "trial").agg(F.count("*").alias("n_common"), F.stddev_samp("ret").alias("dev"))
    inverse = F.when(F.col("dev") > 0, 1 / F.col("dev")).otherwise(F.lit(0.0))
    v = v.withColumn("inverse", inverse).withColumn("total", F.sum("inverse").over(Window.partitionBy("campaign")))
    reason = F.when(F.col("n_common") < least, "too few common points").when(~(F.col("total") > 0), "nothing moves")
    return v.select("campaign", "trial", "n_common", F.when(reason.isNull(), F.col("inverse") / F.col("total")).alias("weight"), reason.alias("reason"))


def combined(common: DataFrame, shares: DataFrame, period: Column) -> DataFrame:
    """campaign, ts, ret: holdings are set to the weights at each period's start and drift inside of it.

    A holding is its weight times its growth since the period's start: windows by member and period, no state.
    """
    w = Window.partitionBy("campaign", "trial", "__period").orderBy("ts")
    d = common.join(shares.where("weight IS NOT NULL").select("campaign", "trial", "weight"), ["campaign", "trial"]).withColumn("__period", period)
    after = F.product(1 + F.col("ret")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    before = F.coalesce(F.product(1 + F.col("ret")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(1.0))
    held = d.select("campaign", "ts", (F.col("weight") * after).alias("after"), (F.col("weight") * before).alias("before"))
    return held.groupBy("campaign", "ts").agg(F.try_divide(F.sum("after"), F.nullif(F.sum("before"), F.lit(0.0))).alias("ratio")).select("campaign", "ts", (F.col("ratio") - 1).alias("ret"))


@dataclass(frozen=True)
class Portfolios:
    """What :func:`build` gives: ``steps`` has the ranked representatives with ``kept``, ``shares`` the members' weights."""

    steps: DataFrame
    shares: DataFrame
    returns: DataFrame


def build(trials: DataFrame, returns: DataFrame, period: Column, most_rho: float = 0.5, most: int = 10, least: int = 30) -> Portfolios:
    """Portfolios of all campaigns: one trial a cell, the correlation filter, the cap, inverse deviations, rebalanced returns.

    ``trials``: campaign, trial, cell, score; ``returns``: campaign, trial, ts, ret.
    """
    ranked = representatives(trials)
    steps = decorrelated(ranked, correlations(ranked, returns, least), most_rho)
    common = common_points(members(steps, most), returns)
    shares = weights(common, least)
    return Portfolios(steps, shares, combined(common, shares, period))
