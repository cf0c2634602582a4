"""Search over rules: seeded sampling, variation, archive, islands and quotas; proposals are batches for one Spark job.

All randomness comes from a numpy generator that the caller seeds, so a search can be repeated.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.operators.rules import PERIODS, Clause, Feature, Rule

PRICED, LEVELS = ("sma", "ema", "upper", "lower", "max", "min"), {"zscore": (-3.0, 3.0), "rsi": (10.0, 90.0)}
#: Categories of features, for signatures and cells.
CATEGORIES = {"trend": ("sma", "ema", "close"), "band": ("upper", "lower", "zscore", "bandwidth", "band_ratio"), "extreme": ("max", "min"), "momentum": ("rsi",), "range": ("atr", "atr_ratio", "spread"), "volume": ("volume", "volume_sma")}


def sample_period(rng: np.random.Generator, low: int = PERIODS[0], high: int = 60) -> int:
    """A period, evenly in its logarithm."""
    return int(round(math.exp(rng.uniform(math.log(low), math.log(high)))))


def sample_clause(rng: np.random.Generator) -> Clause:
    kind = str(rng.choice(["compare", "cross", "threshold", "cross_level", "breakout", "slope", "distance"]))
    up = bool(rng.integers(2))
    priced = lambda: Feature(str(rng.choice(PRICED)), sample_period(rng))
    if kind in ("compare", "cross"):
        return Clause(kind, priced(), up, priced())
    if kind == "distance":
        return Clause(kind, Feature("close"), up, priced(), round(float(rng.uniform(-2, 2)), 2))
    if kind == "breakout":
        return Clause(kind, Feature("max" if up else "min", sample_period(rng)), up)
    if kind == "slope":
        return Clause(kind, priced(), up)
    op = str(rng.choice(sorted(LEVELS)))
    return Clause(kind, Feature(op, sample_period(rng)), up, None, round(float(rng.uniform(*LEVELS[op])), 2))


def sample_rule(rng: np.random.Generator, most: int = 3) -> Rule:
    clauses = tuple(sample_clause(rng) for _ in range(int(rng.integers(1, most + 1))))
    return Rule(clauses, str(rng.choice(["and", "or"])), sample_period(rng), round(float(rng.uniform(0.5, 3)), 2), 2.0, "long", "atr")


def vary(rule: Rule, rng: np.random.Generator) -> Rule:
    """One clause with another period or level (parameters), or a new one in its place (point)."""
    k = int(rng.integers(len(rule.clauses)))
    c = rule.clauses[k]
    if rng.random() < 0.5:
        c = sample_clause(rng)
    elif c.level is not None and c.kind != "distance":
        c = replace(c, level=round(float(np.clip(c.level + rng.normal(0, 0.1) * (LEVELS[c.left.op][1] - LEVELS[c.left.op][0]), *LEVELS[c.left.op])), 2))
    elif c.left.period:
        c = replace(c, left=replace(c.left, period=int(np.clip(c.left.period + rng.integers(-5, 6), PERIODS[0], 60))))
    return replace(rule, clauses=(*rule.clauses[:k], c, *rule.clauses[k + 1 :]))


def cross(a: Rule, b: Rule, rng: np.random.Generator, most: int = 3) -> Rule:
    """The first clauses of one rule and the last ones of another, at most ``most``; stop and target of the first."""
    i, j = int(rng.integers(1, len(a.clauses) + 1)), int(rng.integers(len(b.clauses)))
    return replace(a, clauses=(*a.clauses[:i], *b.clauses[j:])[:most])


def signature(rule: Rule) -> frozenset[str]:
    """Kinds, features and directions of a rule's clauses: what its likeness to others is measured by."""
    return frozenset(f"{c.kind}:{f.op}:{'up' if c.up else 'down'}" for c in rule.clauses for f in (c.left, c.right) if f is not None)


def likeness(a: Rule, b: Rule) -> float:
    x, y = signature(a), signature(b)
    return len(x & y) / len(x | y)


def categories(rule: Rule) -> int:
    """The categories of a rule's features as bits."""
    ops = {f.op for c in rule.clauses for f in (c.left, c.right) if f is not None}
    return sum(1 << i for i, (_, members) in enumerate(sorted(CATEGORIES.items())) if ops & set(members))


def bin_of(x: float | None, low: float, high: float, bins: int, log: bool = False) -> int:
    """A clamped bin, even in the value or its logarithm; missing values are in the first."""
    if x is None or not math.isfinite(x) or (log and x <= 0):
        return 0
    a, b, v = (math.log(low), math.log(high), math.log(x)) if log else (low, high, x)
    return min(max(int((v - a) / (b - a) * bins), 0), bins - 1)


def archive(scored: Iterable[tuple[int, str, float]]) -> dict[str, tuple[int, float]]:
    """cell: (trial, score) of the best of (trial, cell, score); on a tie the one that was there stays."""
    out: dict[str, tuple[int, float]] = {}
    for trial, cell, score in scored:
        if cell not in out or score > out[cell][1]:
            out[cell] = (trial, score)
    return out


def archive_frame(trials: DataFrame) -> DataFrame:
    """The same as a relation (trial_id, cell, score): the best of each cell, the earliest on a tie."""
    return trials.groupBy("cell").agg(F.max_by(F.struct("trial_id", "score"), F.struct("score", -F.col("trial_id"))).alias("b")).select("cell", "b.trial_id", "b.score")


def migrate(islands: list[list[tuple[int, float]]], share: float = 0.1) -> list[list[tuple[int, float]]]:
    """Each island's best go to the next one of the ring, unless they are there."""
    best = [sorted(m, key=lambda x: (-x[1], x[0]))[: max(1, int(len(m) * share))] if m else [] for m in islands]
    return [[*m, *(x for x in best[k - 1] if x[0] not in {y[0] for y in m})] for k, m in enumerate(islands)]


def pick_parents(scored: list[tuple[int, float]], rng: np.random.Generator, n: int, size: int = 3) -> list[int]:
    """Winners of small tournaments: the best of ``size`` drawn, the earlier one on a tie."""
    draws = (rng.choice(len(scored), min(size, len(scored)), replace=False) for _ in range(n))
    return [min((scored[int(i)] for i in d), key=lambda x: (-x[1], x[0]))[0] for d in draws]


def quotas(total: int, weights: dict[str, float]) -> dict[str, int]:
    """Whole shares of a total, by largest remainder, ties by name."""
    exact = {k: total * w / sum(weights.values()) for k, w in weights.items()}
    out = {k: int(x) for k, x in exact.items()}
    for k in sorted(exact, key=lambda k: (out[k] - exact[k], k))[: total - sum(out.values())]:
        out[k] += 1
    return out


def grid(parameters: dict[str, list[float]], own: list[dict[str, float]], most: int = 200, seed: int = 0) -> list[dict[str, float]]:
    """Configurations: ``own`` ones first, then the product of all values, repeats left out, at most ``most``, the rest drawn by seed."""
    import itertools

    product = [dict(zip(parameters, v)) for v in itertools.product(*parameters.values())]
    unique: dict[tuple, dict[str, float]] = {}
    for c in [*own, *product]:
        unique.setdefault(tuple(sorted(c.items())), c)
    first, rest = list(unique.values())[: len(own)], list(unique.values())[len(own) :]
    room = max(0, most - len(first))
    if len(rest) > room:
        rest = [rest[i] for i in sorted(np.random.default_rng(seed).choice(len(rest), room, replace=False))]
    return [*first, *rest][:most]


def calibrate(propose: dict[str, tuple[float, float]], score: Callable[[list[dict[str, float]]], list[float]], budget: int, batch: int = 16, seed: int = 0) -> list[dict]:
    """Audit rows (attempt, values, score) of a seeded search in bounds: a first batch at random, later ones around the best so far.

    ``score`` evaluates a whole batch, so it can be one Spark job.
    """
    rng, rows = np.random.default_rng(seed), []
    while len(rows) < budget:
        n = min(batch, budget - len(rows))
        best = max(rows, key=lambda r: r["score"])["values"] if rows else None
        tries = []
        for i in range(n):
            tries.append({k: float(rng.uniform(a, b)) if best is None or i % 2 else float(np.clip(best[k] + rng.normal(0, 0.1) * (b - a), a, b)) for k, (a, b) in propose.items()})
        rows += [{"attempt": len(rows) + i, "values": v, "score": float(s)} for i, (v, s) in enumerate(zip(tries, score(tries)))]
    return rows
