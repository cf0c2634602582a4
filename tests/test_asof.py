"""As-of joins on irregular times against plain loops."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barline.operators.asof import asof_join


def sides(spark, seed):
    r = random.Random(seed)
    at = lambda: datetime(2001, 1, 1) + timedelta(seconds=r.choice([r.randint(0, 300), r.randint(0, 90_000_000)]))
    left = [(r.choice(["a", "a", "a", "b", "c", None]), at() if r.random() < 0.95 else None, i) for i in range(400)]
    right = [(r.choice(["a", "a", "b", "d", None]), at() if r.random() < 0.95 else None, r.choice([None, r.randint(0, 5)])) for _ in range(300)]
    return left, right, spark.createDataFrame(left, "k string, ts timestamp_ntz, n int").repartition(3), spark.createDataFrame(right, "k string, known timestamp_ntz, v int").repartition(2)


def expected(left, right, keyed, direction, strict):
    out = []
    for k, t, n in left:
        best = None
        for k2, t2, v in right:
            if t is None or t2 is None or (keyed and (k is None or k != k2)):
                continue
            ok = (t2 < t if strict else t2 <= t) if direction == "backward" else (t2 > t if strict else t2 >= t)
            place = ((t2 - t) if direction == "backward" else (t - t2), v is not None, v or 0)
            if ok and (best is None or place > best[0]):
                best = place, t2, v
        out.append((n, *(best[1:] if best else (None, None))))
    return out


@pytest.mark.parametrize("block", [5, 4096])
@pytest.mark.parametrize("keyed, direction, strict", [(True, "backward", False), (False, "backward", False), (True, "forward", False), (True, "backward", True), (False, "forward", True)])
def test_by_brute_force(spark, block, keyed, direction, strict):
    left, right, a, b = sides(spark, 4)
    if not keyed:
        b = b.drop("k")
    got = asof_join(a, b, ("k",) if keyed else (), "ts", "known", ["v"], direction, block, strict)
    assert got.columns == ["k", "ts", "n", "known", "v"]
    assert sorted(((r.n, r.known, r.v) for r in got.collect()), key=str) == sorted(expected(left, right, keyed, direction, strict), key=str)



def test_no_range_join_and_many_tasks_for_one_key(spark):
    _, _, a, b = sides(spark, 5)
    joined = asof_join(a.withColumn("k", F.lit("x")), b.withColumn("k", F.lit("x")), ("k",), "ts", "known", ["v"], block=20)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    keys = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.autoBroadcastJoinThreshold")
    before = {k: spark.conf.get(k) for k in keys}
    try:
        # As for tables too large to be broadcast.
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        joined = asof_join(a.withColumn("k", F.lit("x")), b.withColumn("k", F.lit("x")), ("k",), "ts", "known", ["v"], block=20)
        assert joined.where("known IS NOT NULL").rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).filter(lambda n: n > 0).count() > 4
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_refusals_and_empty_sides(spark):
    _, _, a, b = sides(spark, 6)
    with pytest.raises(ValueError):
        asof_join(a, b, ("k",), "ts", "known", ["v"], "nearest")
    with pytest.raises(ValueError):
        asof_join(a.withColumn("v", F.lit(1)), b, ("k",), "ts", "known", ["v"])
    assert asof_join(a, b.where("false"), ("k",), "ts", "known", ["v"]).where("v IS NULL AND known IS NULL").count() == a.count()
    assert asof_join(a.where("false"), b, ("k",), "ts", "known", ["v"]).count() == 0
