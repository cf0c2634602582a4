"""Seeded search over rules."""

import numpy as np
import pytest

from barline.operators import search as se
from barline.operators.rules import Rule, parameters


def test_rules_are_valid_and_repeatable():
    a, b = ([se.sample_rule(np.random.default_rng(seed)) for seed in range(60)] for _ in range(2))
    assert a == b and len(set(a)) > 50
    rng = np.random.default_rng(1)
    for x, y in zip(a, a[1:]):
        for r in (x, se.vary(x, rng), se.cross(x, y, rng)):
            r.check()
            assert Rule.from_json(r.to_json()) == r and r.warmup() >= 0 and len(r.clauses) <= 3
    assert se.likeness(a[0], a[0]) == 1 and 0 <= se.likeness(a[0], a[1]) <= 1 and se.categories(a[0]) > 0


def test_archive_and_bins(spark):
    rows = [(1, "a", 1.0), (2, "b", 5.0), (3, "a", 2.0), (4, "b", 5.0)]
    assert se.archive(rows) == {"a": (3, 2.0), "b": (2, 5.0)}
    got = se.archive_frame(spark.createDataFrame(rows, "trial_id bigint, cell string, score double")).collect()
    assert {r.cell: (r.trial_id, r.score) for r in got} == se.archive(rows)
    assert [se.bin_of(x, 0, 10, 5) for x in (-1, 0, 4.1, 99, None, float("nan"))] == [0, 0, 2, 4, 0, 0]
    assert se.bin_of(100, 1, 10_000, 4, True) == 2 and se.bin_of(0, 1, 10, 4, True) == 0


def test_islands_parents_and_quotas():
    moved = se.migrate([[(1, 1.0), (2, 9.0)], [(3, 5.0)], []])
    assert moved == [[(1, 1.0), (2, 9.0)], [(3, 5.0), (2, 9.0)], [(3, 5.0)]]
    picks = se.pick_parents([(i, float(i)) for i in range(20)], np.random.default_rng(0), 300)
    assert np.mean(picks) > 11 and picks == se.pick_parents([(i, float(i)) for i in range(20)], np.random.default_rng(0), 300)
    assert se.quotas(10, {"a": 1, "b": 1, "c": 1}) == {"a": 4, "b": 3, "c": 3} and sum(se.quotas(7, {"x": 0.5, "y": 2}).values()) == 7


def test_grids_and_calibration():
    g = se.grid({"a": [1, 2], "b": [3, 4]}, [{"a": 1, "b": 3}, {"a": 9, "b": 9}])
    assert len(g) == 5 and g[1] == {"a": 9, "b": 9}
    assert len(se.grid({"a": list(range(50)), "b": list(range(50))}, [], 200)) == 200
    rows = se.calibrate({"x": (-5, 5)}, lambda batch: [-((v["x"] - 2) ** 2) for v in batch], 80)
    assert [r["attempt"] for r in rows] == list(range(80)) and max(r["score"] for r in rows) > -0.05
    assert rows == se.calibrate({"x": (-5, 5)}, lambda batch: [-((v["x"] - 2) ** 2) for v in batch], 80)


def test_declared_parameters():
    names = {"n": (10, 2, 50, True), "k": (1.0, 0.5, 3.0, False)}
    assert parameters(names, {"k": 2}) == {"n": 10, "k": 2.0}
    for bad in ({"z": 1}, {"n": 1}, {"n": 2.5}):
        with pytest.raises(ValueError):
            parameters(names, bad)
