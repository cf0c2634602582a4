"""Selection-bias checks and portfolios as plans over long relations (config_id, obs_ix, ret)."""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cross_validation_paths(returns: DataFrame, groups: int = 6, test_groups: int = 2, label_span: int = 1, embargo: float = 0.01) -> DataFrame:
    """path, n, sharpe: out-of-sample paths of choosing the best configuration in sample.

    Observations are cut in groups; each choice of test groups is a split, whose training rows are the others but those
    whose label reaches into a test group and those within the embargo behind one. Per split the configuration with the
    best mean over sample deviation in training is taken; a group's k-th split gives its part of the k-th path.
    Splits are a broadcast table of C(groups, test_groups) * groups rows; sums are aggregated once a split.
    """
    spark = returns.sparkSession
    axis = returns.select("obs_ix").distinct()
    order = Window.orderBy("obs_ix")  # one row an observation
    tiled = axis.select("obs_ix", F.ntile(groups).over(order).alias("tile"), (F.row_number().over(order) - 1).alias("at"))
    n = F.count("*").over(Window.partitionBy())
    edges = tiled.withColumn("total", n).withColumn("first", F.min("at").over(Window.partitionBy("tile"))).withColumn("last", F.max("at").over(Window.partitionBy("tile")))
    # How near a row is to the group behind and before it decides whether that group, if tested, bars it.
    gap = F.floor(F.col("total") * embargo)
    placed = edges.select("obs_ix", "tile", (F.col("last") - F.col("at") < label_span).alias("reaches"), (F.col("at") - F.col("first") < gap).alias("waits"))
    table = []
    for split, chosen in enumerate(itertools.combinations(range(1, groups + 1), test_groups)):
        table += [(split, g, g in chosen, g + 1 in chosen, g - 1 in chosen) for g in range(1, groups + 1)]
    splits = F.broadcast(spark.createDataFrame(table, "split int, tile int, test boolean, before boolean, behind boolean"))
    rows = returns.join(placed, "obs_ix").join(splits, "tile")
    train = rows.where(~F.col("test") & ~(F.col("before") & F.col("reaches")) & ~(F.col("behind") & F.col("waits")))
    score = train.groupBy("split", "config_id").agg(F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("dev")).withColumn("score", F.when(F.col("dev") > 0, F.col("mean") / F.col("dev")).otherwise(F.lit(0.0)))
    best = score.groupBy("split").agg(F.max_by("config_id", F.struct("score", -F.col("config_id"))).alias("config_id"))
    paths = spark.createDataFrame([(s, g, sum(g in c for c in list(itertools.combinations(range(1, groups + 1), test_groups))[:s])) for s, c0 in enumerate(itertools.combinations(range(1, groups + 1), test_groups)) for g in c0], "split int, tile int, path int")
    out = rows.where("test").join(F.broadcast(best), ["split", "config_id"]).join(F.broadcast(paths), ["split", "tile"])
    g = out.groupBy(F.col("path").cast("bigint").alias("path")).agg(F.count("*").alias("n"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("dev"))
    return g.select("path", "n", F.when(F.col("dev") > 0, F.col("mean") / F.col("dev")).otherwise(F.lit(0.0)).alias("sharpe"))


def diverging(points: DataFrame, least: int = 3, flat: float = 1e-9) -> DataFrame:
    """n, in_slope, out_slope, diverging of checkpoints (step, in_sample, out_of_sample): the record rises while the paths' median doesn't."""
    g = points.agg(F.count("*").alias("n"), F.regr_slope("in_sample", "step").alias("in_slope"), F.regr_slope("out_of_sample", "step").alias("out_slope"))
    return g.select("n", "in_slope", "out_slope", F.coalesce((F.col("n") >= least) & (F.col("in_slope") > flat) & (F.col("out_slope") <= flat), F.lit(False)).alias("diverging"))


def rebalanced(returns: DataFrame, weights: DataFrame, period: Column) -> DataFrame:
    """ts, ret of a portfolio whose holdings are set to ``weights`` (member, weight) at each period's start and drift inside of it.

    ``returns``: member, ts, ret on common days. A holding is its weight times the product of its growth since the
    period's start, so a day's return is a ratio of two sums: windows by member and period, no state.
    """
    w = Window.partitionBy("member", "period").orderBy("ts")
    d = returns.join(F.broadcast(weights), "member").withColumn("period", period)
    after = F.product(1 + F.col("ret")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    before = F.coalesce(F.product(1 + F.col("ret")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(1.0))
    held = d.select("ts", (F.col("weight") * after).alias("after"), (F.col("weight") * before).alias("before"))
    return held.groupBy("ts").agg((F.sum("after") / F.sum("before") - 1).alias("ret"))


def inverse_volatility(returns: DataFrame) -> DataFrame:
    """member, weight: one over the sample deviation, as shares of the sum; none for a member that doesn't move."""
    v = returns.groupBy("member").agg(F.stddev_samp("ret").alias("dev")).where("dev > 0").select("member", (1 / F.col("dev")).alias("inverse"))
    return v.select("member", (F.col("inverse") / F.sum("inverse").over(Window.partitionBy())).alias("weight"))


def admitted(requests: DataFrame, at: str, order: list[str], equity: Column, risk: float, cap: float, open_risk: Column) -> DataFrame:
    """``requests`` with ``admitted`` and ``reason``: all of one time against one equity, in canonical order, while the risk committed stays within the cap.

    Each takes the same risk and what is refused commits nothing, so the first floor((cap * equity - open) / risk) valid
    ones of a time are admitted: a rank, no loop. ``stop_distance`` must be positive.
    """
    valid = F.coalesce(F.col("stop_distance") > 0, F.lit(False))
    place = F.sum(valid.cast("int")).over(Window.partitionBy(at).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    budget, each = equity * cap, equity * risk
    reason = F.when(~(equity > 0), "no_equity").when(~valid, "no_stop_distance").when(open_risk + place * each > budget, "portfolio_risk_cap")
    return requests.withColumn("reason", reason).withColumn("admitted", F.col("reason").isNull())


def cluster_series(distance: np.ndarray, most: int | None = None, seed: int = 0) -> np.ndarray:
    """Cluster numbers of series from their distance matrix: k-means on its rows, the number of clusters by the t-statistic of silhouettes.

    Clusters whose statistic is below the mean are clustered anew and kept if the mean rises. Series are few (trials of
    a campaign); the matrix comes from pairwise correlations that are aggregated in Spark.
    """
    n = len(distance)
    if n < 3:
        return np.zeros(n, int)

    def kmeans(k: int) -> np.ndarray:
        best, least = np.zeros(n, int), math.inf
        for start in range(5):
            rng = np.random.default_rng(seed + start)
            centers = distance[[int(rng.integers(n))]]
            while len(centers) < k:  # far points first
                d = ((distance[:, None] - centers[None]) ** 2).sum(2).min(1)
                centers = np.vstack([centers, distance[int(rng.choice(n, p=d / d.sum())) if d.sum() > 0 else int(rng.integers(n))]])
            for _ in range(100):
                label = ((distance[:, None] - centers[None]) ** 2).sum(2).argmin(1)
                moved = np.array([distance[label == j].mean(0) if (label == j).any() else centers[j] for j in range(k)])
                if np.allclose(moved, centers):
                    break
                centers = moved
            inertia = float(((distance - centers[label]) ** 2).sum())
            if inertia < least - 1e-12:
                best, least = label, inertia
        return best

    def silhouettes(label: np.ndarray) -> np.ndarray:
        gaps = np.sqrt(((distance[:, None] - distance[None]) ** 2).sum(2))
        out = np.zeros(n)
        for i in range(n):
            mine = (label == label[i]) & (np.arange(n) != i)
            others = [gaps[i, label == j].mean() for j in set(label.tolist()) - {int(label[i])}]
            if mine.any() and others:
                a, b = gaps[i, mine].mean(), min(others)
                out[i] = (b - a) / max(a, b) if max(a, b) > 0 else 0.0
        return out

    def quality(s: np.ndarray) -> float:
        return float(s.mean() / s.std()) if s.std() > 0 else 0.0

    best = max((kmeans(k) for k in range(2, min(most or n - 1, n - 1) + 1)), key=lambda label: quality(silhouettes(label)))
    s = silhouettes(best)
    parts = {j: quality(s[best == j]) for j in sorted(set(best.tolist()))}
    mean = float(np.mean(list(parts.values())))
    again = [j for j, q in parts.items() if q < mean]
    if 1 < len(again) < len(parts):
        rows = np.flatnonzero(np.isin(best, again))
        inner = cluster_series(distance[np.ix_(rows, rows)], most, seed)
        trial = best.copy()
        trial[rows] = best.max() + 1 + inner
        t = silhouettes(trial)
        if np.mean([quality(t[trial == j]) for j in set(trial.tolist())]) > mean:
            best = trial
    return np.unique(best, return_inverse=True)[1]


def select_features(stats: list[dict], correlation: dict[tuple[str, str], float], least_rank: float = 0.7, least_t: float = 3.0, most_rho: float = 0.7, most: int = 3) -> list[str]:
    """Names of features that are monotonic over deciles and significant over weeks, by |t|, none too like a kept one."""
    fit = sorted((s for s in stats if abs(s["decile_rank"]) >= least_rank and abs(s["week_t"]) >= least_t), key=lambda s: (-abs(s["week_t"]), s["name"]))
    kept: list[str] = []
    for s in fit:
        if len(kept) < most and all(abs(correlation.get((s["name"], k), correlation.get((k, s["name"]), 0.0))) <= most_rho for k in kept):
            kept.append(s["name"])
    return kept


def build_portfolio(trials: DataFrame, returns: DataFrame, period: Column, most_rho: float = 0.5, most: int = 10, least: int = 30) -> tuple[dict[str, list[int]], DataFrame, DataFrame]:
    """Steps (trial ids after each), weights (member, weight) and returns (ts, ret) of a portfolio.

    ``trials``: trial_id, cell, score; ``returns``: member (a trial), ts, ret. One trial a cell stays (the best score,
    the earlier on a tie); in order of score each stays that correlates with none kept, on their common points; the
    first ``most`` get weights by inverse deviation over the points that all have, and are rebalanced by period.
    Correlations are aggregated in Spark; the walk in order of score is over one row a cell, on the driver.
    """
    from barline.functions.stats import greedy_decorrelate, pairwise_correlation

    order = [F.desc("score"), "trial_id"]
    kept = trials.withColumn("__n", F.row_number().over(Window.partitionBy("cell").orderBy(*order))).where("__n = 1").orderBy(*order)
    ranked = [(r["trial_id"], r["score"]) for r in kept.select("trial_id", "score").collect()]
    ids = [t for t, _ in ranked]
    mine = returns.where(F.col("member").isin(ids))
    rho = {(r["a"], r["b"]): r["rho"] for r in pairwise_correlation(mine, "member", "ts", "ret", least).where("rho IS NOT NULL").collect()}
    apart = greedy_decorrelate({t: -i for i, (t, _) in enumerate(ranked)}, rho, most_rho)
    chosen = apart[:most]
    if not chosen:
        raise ValueError("no trial is left for a portfolio")
    few = mine.where(F.col("member").isin(chosen))
    common = few.join(few.groupBy("ts").agg(F.count("*").alias("__k")).where(F.col("__k") == len(chosen)).select("ts"), "ts", "left_semi")
    if common.limit(least).count() < least:
        raise ValueError("too few common points")
    weights = inverse_volatility(common)
    return {"representatives": ids, "decorrelated": apart, "capped": chosen}, weights, rebalanced(common, weights, period)
