import random
from datetime import datetime, timedelta
from statistics import median

import pytest

from barline.operators import trailing as tr
from barline.plans import research_queries as rq


def brute(rows, key, at, days):
    return [v for k, t, v in rows if k == key and v is not None and at - timedelta(days=days) <= t <= at]


@pytest.mark.parametrize("bucket_rows", [7, 20_000])
def test_trailing_against_brute_force(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(tr, "BUCKET_ROWS", bucket_rows)
    rnd, start = random.Random(5), datetime(2024, 1, 1)
    hour = lambda: start + timedelta(hours=rnd.randrange(24 * 40))
    rows = [(k, hour(), rnd.choice([None, 0.25, 0.25, -1.0, rnd.random(), rnd.randrange(4) / 3])) for k in "abbb" for _ in range(90)]
    points = [(k, hour()) for k in "ab" for _ in range(40)] + [("a", start - timedelta(days=1)), ("c", start)]
    got = tr.trailing(spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, rate double"), spark.createDataFrame(points + points[:3], "symbol string, ts timestamp_ntz"), "ts", "rate", 10, 7).collect()
    assert {(r.symbol, r.ts) for r in got} == set(points) and len(got) == len(set(points))
    for r in got:
        ten, seven = brute(rows, r.symbol, r.ts, 10), brute(rows, r.symbol, r.ts, 7)
        assert r.median == (median(ten) if ten else None)
        assert r["mean"] == (pytest.approx(sum(seven) / len(seven), rel=1e-14, abs=1e-15) if seven else None)


def test_means_after_large_values(spark):
    """A running sum of doubles would lose the small values that follow a large one."""
    rows = [("a", datetime(2024, 1, 1), 1e15), *[("a", datetime(2024, 2, 1) + timedelta(hours=i), 1e-7) for i in range(5)]]
    got = tr.trailing(spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, rate double"), spark.createDataFrame([rows[-1][:2]], "symbol string, ts timestamp_ntz"), "ts", "rate", 10, 7).first()
    assert got["mean"] == pytest.approx(1e-7, rel=1e-14) and got.median == 1e-7


def test_funding_features_have_no_frame_over_a_range(spark, small):
    """A frame over a range of time looks at every settlement of ten days for each one."""
    plan = rq.funding_features(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "RangeFrame" not in plan and "percentile" not in plan
