"""Clusters of series by their correlations, without a matrix on the driver.

A series' row holds its distances sqrt((1 - rho) / 2) to all series. Rows are clustered by
k-means for every k at once: centres start farthest-first (so those of k are the first k of one
sequence), and a round is one pass that sums rows by their nearest centres for all k. Silhouettes come from
squared distances to whole clusters, which a cluster's number of rows, sum of rows and sum of their squares
give. The k with the greatest mean silhouette over its deviation is taken; clusters below
the mean of the clusters' own ratios are clustered anew, and that is kept if their ratios rise. At
last a guard: a series stays in its cluster only while its mean correlation with the other members is
above z / sqrt(T), T their mean common observations; the weakest of a cluster leaves first, and becomes one of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barline.operators.lineage import cut

#: Clusters at most, rounds of k-means, and the guard's z.
MOST, ROUNDS, Z = 10, 50, 3.0


def distance_rows(series: DataFrame, pairs: DataFrame) -> DataFrame:
    """series, ix, x: each series' distances to all of ``series`` (one column, series) in order. ``pairs``: a, b, rho, once a pair; pairs that aren't there or NULL have correlation 0."""
    ix = series.select("series").distinct().withColumn("ix", F.row_number().over(Window.orderBy("series")) - 1)
    both = pairs.select("a", "b", "rho").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "rho"))
    named = lambda c, side: ix.select(F.col("series").alias(side), F.col("ix").alias(c))
    told = both.join(named("i", "a"), "a").join(named("j", "b"), "b").select("i", "j", "rho")
    n = ix.count()
    held = told.groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct("j", F.coalesce("rho", F.lit(0.0)).alias("rho")))).alias("rhos"))
    rho = lambda j: F.when(j == F.col("ix"), 1.0).otherwise(F.coalesce(F.try_element_at("rhos", j.cast("int")), F.lit(0.0)))
    rows = ix.join(held, F.col("i") == F.col("ix"), "left").withColumn("rhos", F.coalesce("rhos", F.expr("map_from_arrays(CAST(array() AS array<int>), CAST(array() AS array<double>))")))
    return rows.select("series", "ix", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.sqrt(F.greatest((1 - rho(j)) / 2, F.lit(0.0)))).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centres], axis=1).argmin(axis=1)


def farthest_first(rows: DataFrame, most: int) -> np.ndarray:
    """Centres: the row of the greatest sum of distances, then again and again the row farthest from those taken; ties to the lower number."""
    centres: list[np.ndarray] = []
    while len(centres) < most:
        taken = np.array(centres)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column("x"))
                far = x.sum(axis=1) if not len(taken) else np.min([((x - c) ** 2).sum(axis=1) for c in taken], axis=0)  # noqa: B023
                yield pa.RecordBatch.from_arrays([batch.column("ix"), pa.array(far), batch.column("x")], ["ix", "far", "x"])

        found = rows.select("ix", "x").mapInArrow(run, "ix int, far double, x array<double>").orderBy(F.desc(F.round("far", 12)), "ix").first()
        if centres and found.far <= 1e-18:
            break  # all other rows equal a centre
        centres.append(np.array(found.x))
    return np.array(centres)


def k_means(rows: DataFrame, first: np.ndarray, rounds: int = ROUNDS) -> dict[int, np.ndarray]:
    """Centres for each k from 2 on, from the first k of ``first``."""
    now = {k: first[:k].copy() for k in range(2, len(first) + 1)}
    for _ in range(rounds):
        held = now

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, counts = {k: np.zeros_like(c) for k, c in held.items()}, {k: np.zeros(k, np.int64) for k in held}  # noqa: B023
            for batch in batches:
                x = _matrix(batch.column("x"))
                for k, centres in held.items():  # noqa: B023
                    label = nearest(x, centres)
                    np.add.at(sums[k], label, x)
                    counts[k] += np.bincount(label, minlength=k)
            at = [(k, j) for k in held for j in range(k) if counts[k][j]]  # noqa: B023
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in at], pa.int32()), pa.array([j for _, j in at], pa.int32()), pa.array([int(counts[k][j]) for k, j in at], pa.int64()), pa.array([sums[k][j].tolist() for k, j in at], pa.list_(pa.float64()))], ["k", "j", "n", "s"])

        parts = rows.select("x").mapInArrow(run, "k int, j int, n bigint, s array<double>").collect()  # k (k + 1) / 2 sums a task at most
        new = {k: c.copy() for k, c in held.items()}
        for k, j in {(r.k, r.j) for r in parts}:
            mine = [r for r in parts if (r.k, r.j) == (k, j)]
            new[k][j] = np.sum([r.s for r in mine], axis=0) / sum(r.n for r in mine)
        now = new
        if all(np.allclose(new[k], held[k], rtol=0, atol=1e-12) for k in new):
            break
    return now


def labelled(rows: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """series, ix, x, k, label for each k."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"))
            for k, c in centres.items():
                yield pa.RecordBatch.from_arrays([*[batch.column(f) for f in ("series", "ix", "x")], pa.array(np.full(len(x), k, np.int32)), pa.array(nearest(x, c).astype(np.int32))], ["series", "ix", "x", "k", "label"])

    return rows.select("series", "ix", "x").mapInArrow(run, f"series {rows.schema['series'].dataType.simpleString()}, ix int, x array<double>, k int, label int")


def silhouettes(told: DataFrame) -> DataFrame:
    """``told`` (series, ix, x, k, label) with s: the silhouette of squared distances, from each cluster's number, sum and sum of squares; 0 alone in a cluster."""
    sums = told.select("k", "label", F.posexplode("x").alias("i", "v")).groupBy("k", "label", "i").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"), F.count("*").alias("n"))
    whole = sums.groupBy("k", "label").agg(F.max("n").alias("n"), F.sum("q").alias("q"), F.transform(F.sort_array(F.collect_list(F.struct("i", "s"))), lambda e: e["s"]).alias("y"))
    clusters = whole.groupBy("k").agg(F.collect_list(F.struct("label", "n", "q", "y")).alias("clusters"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda v, e: v + e)
    far = lambda c, n: F.greatest((c["n"] * F.col("xx") - 2 * dot(F.col("x"), c["y"]) + c["q"]) / n, F.lit(0.0))
    d = told.join(clusters, "k").withColumn("xx", dot(F.col("x"), F.col("x")))
    mine = F.filter("clusters", lambda c: c["label"] == F.col("label"))[0]
    d = d.withColumn("n_own", mine["n"]).withColumn("a", F.when(F.col("n_own") > 1, far(mine, mine["n"] - 1))).withColumn("b", F.array_min(F.transform(F.filter("clusters", lambda c: c["label"] != F.col("label")), lambda c: far(c, c["n"]))))
    s = F.when(F.col("n_own") == 1, 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.nullif(F.greatest("a", "b"), F.lit(0.0))), F.lit(0.0)))
    return d.withColumn("s", s).drop("clusters", "xx", "n_own", "a", "b")


def _ratio(mean: float, std: float, alone: float) -> float:
    return mean / std if std > 1e-12 else alone


def _cluster_ratios(scored: DataFrame) -> dict[int, float]:
    rows = scored.groupBy("label").agg(F.avg("s").alias("m"), F.stddev_pop("s").alias("d")).collect()
    return {r.label: _ratio(r.m, r.d, r.m * 1e6) for r in rows}


def _partition(series: DataFrame, pairs: DataFrame, most: int) -> DataFrame:
    """series, label."""
    rows = cut(distance_rows(series, pairs))
    n, widest = rows.agg(F.count("*"), F.max(F.array_max("x"))).first()
    if n < 3:
        return rows.select("series", F.col("ix").alias("label"))
    if widest < 1e-9:
        return rows.select("series", F.lit(0).alias("label"))
    first = farthest_first(rows, min(most, n - 1))
    if len(first) < 2:
        return rows.select("series", F.lit(0).alias("label"))
    scored = cut(silhouettes(labelled(rows, k_means(rows, first))))
    by_k = scored.groupBy("k").agg(F.avg("s").alias("m"), F.stddev_pop("s").alias("d")).orderBy("k").collect()
    best = max(by_k, key=lambda r: _ratio(r.m, r.d, -np.inf)).k
    scored = scored.where(F.col("k") == best)
    ratios = _cluster_ratios(scored)
    again = sorted(j for j, t in ratios.items() if t < np.mean(list(ratios.values())))
    labels = scored.select("series", "label")
    if len(again) <= 1:
        return labels
    part = cut(labels.where(F.col("label").isin(again)).select("series"))
    inner = part.select(F.col("series").alias("a")), part.select(F.col("series").alias("b"))
    sub = cut(_partition(part, pairs.join(inner[0], "a", "left_semi").join(inner[1], "b", "left_semi"), most))
    new = labels.join(sub.withColumnRenamed("label", "inner"), "series", "left").select("series", F.when(F.col("inner").isNull(), F.col("label")).otherwise(F.col("inner") + MOST_LABEL).alias("label"))
    told = _cluster_ratios(silhouettes(rows.join(new, "series").select("series", "ix", "x", F.lit(0).alias("k"), "label")))
    better = np.mean([t for j, t in told.items() if j >= MOST_LABEL]) > np.mean([ratios[j] for j in again])
    return new if better else labels


#: Labels of clusters that are clustered anew begin here.
MOST_LABEL = 1_000_000


def guarded(labels: DataFrame, pairs: DataFrame, z: float = Z) -> DataFrame:
    """``labels`` (series, cluster) after the guard: one member of each cluster leaves in a round, while one is too weak. ``pairs``: a, b, rho, n."""
    both = cut(pairs.select("a", "b", "rho", "n").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "rho", "n")))
    now = cut(labels.select("series", F.struct(F.col("cluster").cast("string").alias("of"), F.lit(None).cast(labels.schema["series"].dataType).alias("alone")).alias("c")))
    while True:
        sides = both.join(now.select(F.col("series").alias("a"), F.col("c").alias("ca")), "a").join(now.select(F.col("series").alias("b"), F.col("c").alias("cb")), "b").where(F.col("ca").eqNullSafe(F.col("cb")))
        sizes = now.groupBy("c").agg(F.count("*").alias("size")).where("size > 1")
        told = sides.groupBy("a").agg(F.sum(F.coalesce("rho", F.lit(0.0))).alias("rho"), F.sum("n").alias("n"))
        # A pair that was never measured counts as uncorrelated, without observations.
        members = now.join(sizes, "c").join(told.withColumnRenamed("a", "series"), "series", "left").select("series", "c", (F.coalesce("rho", F.lit(0.0)) / (F.col("size") - 1)).alias("rho"), (F.coalesce("n", F.lit(0)) / (F.col("size") - 1)).alias("n"))
        margin = F.round(F.col("rho") - z / F.sqrt(F.greatest("n", F.lit(1.0))), 12)
        weakest = members.groupBy("c").agg(F.min(F.struct(margin.alias("margin"), "series")).alias("w")).where("w.margin <= 0").select("w.series")
        leaving = cut(weakest)
        if not leaving.count():
            break
        now = cut(now.join(leaving.withColumn("leaves", F.lit(True)), "series", "left").select("series", F.when(F.col("leaves"), F.struct(F.col("c.of").alias("of"), F.col("series").alias("alone"))).otherwise(F.col("c")).alias("c")))
    names = now.groupBy("c").agg(F.min("series").alias("cluster"))
    return now.join(names, "c").select("series", "cluster")


def clusters(series: DataFrame, pairs: DataFrame, most: int = MOST, z: float = Z) -> DataFrame:
    """series, cluster (its least member) of ``series``; ``pairs``: a, b, rho, n (common observations), once a pair."""
    pairs = cut(pairs.select("a", "b", "rho", "n"))
    parts = _partition(cut(series.select("series").distinct()), pairs, most)
    return guarded(parts.withColumnRenamed("label", "cluster"), pairs, z)
