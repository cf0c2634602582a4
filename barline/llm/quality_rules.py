"""Quality rules: decision lists learned by sequential covering.

From labelled statistics, rules (conjunctions of thresholds) for bad text are
grown one after the other on one part of the rows and pruned on the other; rows
that a rule covers leave before the next is grown. The list is emitted as one
ordered Spark conditional expression, so applying it stays inside codegen.

Defined results: null statistics never fulfil a condition; no labelled rows, or
labels of one class alone, give an empty list, which keeps everything.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # value > threshold, else value <= threshold
    threshold: float

    def column(self) -> Column:
        c = F.col(self.feature)
        return c > F.lit(self.threshold) if self.above else c <= F.lit(self.threshold)

    def holds(self, values: np.ndarray) -> np.ndarray:
        return values > self.threshold if self.above else values <= self.threshold


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    covered_bad: int
    covered_good: int

    def column(self) -> Column:
        out = self.conditions[0].column()
        for c in self.conditions[1:]:
            out = out & c.column()
        return F.coalesce(out, F.lit(False))

    def __str__(self) -> str:
        return " and ".join(f"{c.feature} {'>' if c.above else '<='} {c.threshold:.6g}" for c in self.conditions)


def covers(conditions: list[Condition] | tuple[Condition, ...], x: np.ndarray, features: list[str]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in conditions:
        out &= c.holds(x[:, features.index(c.feature)])
    return out


def _best_condition(x: np.ndarray, bad: np.ndarray, features: list[str], cuts: int) -> tuple[float, Condition | None]:
    """The condition with the largest information gain for bad rows among quantile cuts."""
    p0, n0 = bad.sum(), len(bad) - bad.sum()
    base = np.log2(p0 / (p0 + n0))
    best: tuple[float, Condition | None] = (1e-9, None)
    for j, name in enumerate(features):
        order = np.argsort(x[:, j], kind="stable")
        v, b = x[order, j], np.cumsum(bad[order])
        edges = np.flatnonzero(v[1:] > v[:-1])
        if len(edges) > cuts:
            edges = edges[np.linspace(0, len(edges) - 1, cuts).astype(int)]
        if not len(edges):
            continue
        low_bad, low_all = b[edges].astype(float), edges + 1.0
        for above, p, t in ((False, low_bad, low_all), (True, p0 - low_bad, len(v) - low_all)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / t) - base), -1.0)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), Condition(name, above, float((v[edges[k]] + v[edges[k] + 1]) / 2)))
    return best


def learn_rules(x: np.ndarray, bad: np.ndarray, features: list[str], max_rules: int = 12, max_conditions: int = 4, min_precision: float = 0.8, min_cover: int = 3, cuts: int = 256, seed: int = 7) -> list[Rule]:
    """Sequential covering with a growing and a pruning part (two to one)."""
    x, bad = np.asarray(x, float), np.asarray(bad, bool)
    rules: list[Rule] = []
    rng = np.random.default_rng(seed)
    left = np.arange(len(x))
    while len(rules) < max_rules and 0 < bad[left].sum() < len(left):
        shuffled = rng.permutation(left)
        grow, prune = shuffled[: 2 * len(left) // 3], shuffled[2 * len(left) // 3 :]
        conditions: list[Condition] = []
        inside = grow
        while len(conditions) < max_conditions and 0 < bad[inside].sum() < len(inside):
            _, c = _best_condition(x[inside], bad[inside], features, cuts)
            if c is None:
                break
            conditions.append(c)
            inside = inside[c.holds(x[inside, features.index(c.feature)])]
        if not conditions:
            break

        def worth(cs: list[Condition], rows: np.ndarray) -> float:
            hit = covers(cs, x[rows], features)
            p, n = bad[rows][hit].sum(), (~bad[rows][hit]).sum()
            return (p - n) / (p + n) if p + n else -1.0

        while len(conditions) > 1 and worth(conditions[:-1], prune) >= worth(conditions, prune):
            conditions.pop()
        hit = covers(conditions, x[left], features)
        p, n = int(bad[left][hit].sum()), int((~bad[left][hit]).sum())
        if p < min_cover or p < min_precision * (p + n):
            break
        rules.append(Rule(tuple(conditions), p, n))
        left = left[~hit]
    return rules


def keep_column(rules: list[Rule]) -> Column:
    """Ordered conditional expression: the first rule that holds rejects; else kept."""
    if not rules:
        return F.lit(True)
    out = F.when(rules[0].column(), F.lit(False))
    for r in rules[1:]:
        out = out.when(r.column(), F.lit(False))
    return out.otherwise(F.lit(True))


def fit_rules(statistics: DataFrame, features: list[str], label_column: str = "label", **options: object) -> list[Rule]:
    """Learns from rows of statistics with a 0/1 label (0 is bad).

    The caller bounds these rows (numbers only); they come to the driver, where the learner runs.
    """
    rows = statistics.select(*features, label_column).toPandas().sort_values([*features, label_column])
    return learn_rules(rows[features].to_numpy(float), rows[label_column].to_numpy() == 0, features, **options)
