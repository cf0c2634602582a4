"""Clusters of series on Spark against the same steps in numpy."""

import numpy as np
import pytest

from barline.operators import clusters as cl


def relations(spark, corr, n):
    names = [f"s{i:02d}" for i in range(len(corr))]
    rows = [(names[i], names[j], float(corr[i, j]), int(n[i, j])) for i in range(len(corr)) for j in range(i)]
    return spark.createDataFrame([(x,) for x in names], "series string"), spark.createDataFrame(rows, "a string, b string, rho double, n bigint").repartition(3)


def grouped(rng, sizes, noise, t=250):
    out = []
    for size in sizes:
        common = rng.normal(size=t)
        out += [common + noise * rng.normal(size=t) for _ in range(size)]
    return np.corrcoef(out)


def numpy_silhouettes(x, label):
    gaps = ((x[:, None] - x[None]) ** 2).sum(2)
    out = np.zeros(len(x))
    for i in range(len(x)):
        mine = (label == label[i]) & (np.arange(len(x)) != i)
        if mine.any():
            a, b = gaps[i, mine].mean(), min(gaps[i, label == j].mean() for j in set(label.tolist()) - {label[i]})
            out[i] = (b - a) / max(a, b) if max(a, b) > 0 else 0.0
    return out


def test_steps_equal_numpy(spark):
    corr = grouped(np.random.default_rng(3), (4, 5, 3), 0.8)
    series, pairs = relations(spark, corr, np.full(corr.shape, 250))
    rows = cl.distance_rows(series, pairs)
    x = np.array([r.x for r in rows.orderBy("ix").collect()])
    assert np.allclose(x, np.sqrt(np.clip((1 - corr) / 2, 0, None)), atol=1e-7)
    first = cl.farthest_first(rows, 5)
    want = [int(np.argmax(np.round(x.sum(1), 12)))]
    while len(want) < 5:
        want.append(int(np.argmax(np.round(np.min([((x - x[c]) ** 2).sum(1) for c in want], axis=0), 12))))
    assert np.allclose(first, x[want])
    centres = cl.k_means(rows, first)
    for k, c in centres.items():
        mine = x[want[:k]].copy()
        for _ in range(cl.ROUNDS):
            label = cl.nearest(x, mine)
            mine = np.array([x[label == j].mean(0) if (label == j).any() else mine[j] for j in range(k)])
        assert np.allclose(c, mine)
    for r in cl.silhouettes(cl.labelled(rows, centres)).groupBy("k").agg({"s": "avg"}).collect():
        assert r["avg(s)"] == pytest.approx(numpy_silhouettes(x, cl.nearest(x, centres[r.k])).mean())


def parts(spark_rows):
    out = {}
    for r in spark_rows:
        out.setdefault(r.cluster, set()).add(r.series)
    return sorted(map(sorted, out.values()))


def test_groups_are_found_and_strangers_stand_alone(spark):
    rng = np.random.default_rng(5)
    corr = grouped(rng, (4, 5, 1, 1), 0.5)
    series, pairs = relations(spark, corr, np.full(corr.shape, 250))
    got = parts(cl.clusters(series, pairs).collect())
    assert got == [["s00", "s01", "s02", "s03"], ["s04", "s05", "s06", "s07", "s08"], ["s09"], ["s10"]]


def test_guard_takes_the_weakest_first(spark):
    corr = np.array([[1, 0.9, 0.1, 0.0], [0.9, 1, 0.2, 0.0], [0.1, 0.2, 1, 0.0], [0.0, 0.0, 0.0, 1]])
    _, pairs = relations(spark, corr, np.full((4, 4), 100))
    labels = spark.createDataFrame([("s00", 7), ("s01", 7), ("s02", 7), ("s03", 7)], "series string, cluster int")
    assert parts(cl.guarded(labels, pairs).collect()) == [["s00", "s01"], ["s02"], ["s03"]]


def test_few_or_equal_series(spark):
    series, pairs = relations(spark, np.ones((2, 2)), np.full((2, 2), 50))
    assert parts(cl.clusters(series, pairs).collect()) == [["s00"], ["s01"]]
    series, pairs = relations(spark, np.ones((4, 4)), np.full((4, 4), 50))
    assert parts(cl.clusters(series, pairs).collect()) == [["s00", "s01", "s02", "s03"]]
