"""Rule trees over features, checked and compiled to one boolean column.

A rule is data: clauses on features joined by "and" or "or", a stop and a take
profit. It round-trips through JSON, is checked for units and bounds before any
column is built, and compiles to Catalyst expressions; nothing is evaluated as code.
"""

from __future__ import annotations

import ast
import json
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.functions import features as ft

#: Unit of each feature: a power of price and of volume.
UNITS = {
    "close": (1, 0), "sma": (1, 0), "ema": (1, 0), "max": (1, 0), "min": (1, 0), "upper": (1, 0), "lower": (1, 0), "atr": (1, 0), "spread": (1, 0),
    "zscore": (0, 0), "rsi": (0, 0), "bandwidth": (0, 0), "atr_ratio": (0, 0), "band_ratio": (0, 0), "volume": (0, 1), "volume_sma": (0, 1),
}
#: Values that a feature can take, where they are bounded: a level outside of them never or always holds.
VALUES = {"rsi": (0.0, 100.0), "bandwidth": (0.0, float("inf")), "atr_ratio": (0.0, float("inf")), "band_ratio": (0.0, float("inf"))}
PERIODS = (2, 400)
MOST_CLAUSES = 8
#: Bars in which recursive features restart.
LOOKBACK = 64
#: Clauses of two features, and those of a feature and a number.
PAIRED, LEVELLED = ("compare", "cross", "distance"), ("threshold", "cross_level", "distance")


@dataclass(frozen=True)
class Feature:
    """``slow``: the second period of a ratio. Features of ranges need ``with_ranges``."""

    op: str
    period: int = 0
    slow: int = 0

    def warmup(self) -> int:
        """Bars before the first value."""
        return {"close": 0, "volume": 0, "rsi": self.period, "spread": self.period - 1}.get(self.op, max(self.period, self.slow) - 1)

    def column(self) -> Column:
        c = F.col("close")
        n = self.period
        return {
            "close": lambda: c,
            "volume": lambda: F.col("volume"),
            "sma": lambda: ft.sma(c, n),
            "max": lambda: ft.rolling_max(c, n),
            "min": lambda: ft.rolling_min(c, n),
            "upper": lambda: ft.bollinger(c, n, 2.0, True),
            "lower": lambda: ft.bollinger(c, n, 2.0, False),
            "zscore": lambda: ft.zscore(c, n),
            "bandwidth": lambda: ft.bandwidth(c, n),
            "ema": lambda: ft.ema(c, n, LOOKBACK),
            "rsi": lambda: ft.rsi_of(ft.window_array(c, LOOKBACK), n),
            "atr": lambda: ft.atr(n, LOOKBACK),
            "atr_ratio": lambda: F.try_divide(ft.atr(n, LOOKBACK), F.nullif(ft.atr(self.slow, LOOKBACK), F.lit(0.0))),
            "band_ratio": lambda: ft.band_ratio(c, n, self.slow),
            "spread": lambda: ft.spread_std(c, ft.ago(c, 1), n),
            "volume_sma": lambda: ft.sma(F.col("volume"), n),
        }[self.op]()


@dataclass(frozen=True)
class Clause:
    """kind: compare, cross, threshold, cross_level, breakout, slope, distance; ``up`` is the direction.

    distance: (left - right) in units of ``scale`` ("atr": the range of 14 bars, "spread": the deviation of the two
    over the right one's period) is above ``level``, or below it.
    """

    kind: str
    left: Feature
    up: bool
    right: Feature | None = None
    level: float | None = None
    scale: str = "atr"

    def column(self) -> Column:
        x = self.left.column()
        if self.kind == "distance":
            y = self.right.column()
            unit = ft.atr(14, LOOKBACK) if self.scale == "atr" else ft.spread_std(x, y, max(self.right.period, 2))
            ratio = F.try_divide(x - y, F.nullif(unit, F.lit(0.0)))
            return F.coalesce(ratio > self.level if self.up else ratio < self.level, F.lit(False))
        if self.kind in ("compare", "cross"):
            y = self.right.column()
        else:
            y = F.lit(self.level) if self.kind in ("threshold", "cross_level") else ft.ago(x, 1)
        if self.kind == "breakout":
            x = F.col("close")
        if self.kind in ("cross", "cross_level"):
            before = ft.ago(y, 1) if self.kind == "cross" else y
            hit = (ft.ago(x, 1) <= before) & (x > y) if self.up else (ft.ago(x, 1) >= before) & (x < y)
        else:
            hit = x > y if self.up else x < y
        return F.coalesce(hit, F.lit(False))


def with_ranges(bars: DataFrame) -> DataFrame:
    """Bars with the true range, which features of ranges look at."""
    return bars.withColumn("range", ft.true_range())


@dataclass(frozen=True)
class Rule:
    """``stop_kind``: "band" (the far band of ``stop_period``) or "atr"; ``take_profit``: a multiple of the stop ("ratio") or of the range ("atr")."""

    clauses: tuple[Clause, ...]
    combine: str = "and"
    stop_period: int = 20
    stop_multiple: float = 1.0
    take_profit: float | None = None
    direction: str = "long"
    stop_kind: str = "band"
    target_kind: str = "ratio"

    def check(self) -> None:
        """Raises for what would compare unlike units, leave bounds, never or always hold, or has no clause."""
        if not 0 < len(self.clauses) <= MOST_CLAUSES or self.combine not in ("and", "or"):
            raise ValueError("a rule joins one to eight clauses by and/or")
        if self.direction not in ("long", "short") or self.stop_kind not in ("band", "atr") or self.target_kind not in ("ratio", "atr"):
            raise ValueError("no such direction, stop or target")
        if not self.stop_multiple > 0 or (self.take_profit is not None and not self.take_profit > 0):
            raise ValueError("stop and target need positive multiples")
        for c in self.clauses:
            for f in (c.left, c.right):
                if f is not None and (f.op not in UNITS or (f.op not in ("close", "volume") and not PERIODS[0] <= f.period <= PERIODS[1])):
                    raise ValueError(f"no such feature: {f}")
                if f is not None and f.op.endswith("_ratio") and not f.period < f.slow <= PERIODS[1]:
                    raise ValueError(f"a ratio needs a slower second period: {f}")
            if (c.kind in PAIRED) != (c.right is not None) or (c.kind in LEVELLED) != (c.level is not None):
                raise ValueError(f"{c.kind} has other parts")
            if c.right is not None and UNITS[c.left.op] != UNITS[c.right.op]:
                raise ValueError(f"unlike units: {c.left} and {c.right}")
            if c.kind == "distance" and UNITS[c.left.op] != (1, 0):
                raise ValueError(f"a distance is one of prices: {c.left}")
            if c.level is not None and c.kind != "distance" and UNITS[c.left.op] != (0, 0) and c.level != 0:
                raise ValueError(f"a literal level needs a feature without unit: {c.left}")
            low, high = VALUES.get(c.left.op, (-float("inf"), float("inf")))
            if c.kind in ("threshold", "cross_level") and not low <= c.level <= high:
                raise ValueError(f"{c.left.op} never reaches {c.level}")

    def warmup(self) -> int:
        """Bars before the rule can fire."""
        return max(f.warmup() + (c.kind in ("cross", "cross_level", "slope", "breakout")) for c in self.clauses for f in (c.left, c.right) if f is not None)

    def entry(self) -> Column:
        self.check()
        join = (lambda a, b: a & b) if self.combine == "and" else (lambda a, b: a | b)
        return reduce(join, [c.column() for c in self.clauses])

    def stop(self) -> Column:
        """Distance of the stop from the close; NULL unless positive."""
        c, long = F.col("close"), self.direction == "long"
        if self.stop_kind == "atr":
            d = self.stop_multiple * ft.atr(self.stop_period, LOOKBACK)
        else:
            band = ft.bollinger(c, self.stop_period, 2.0, not long)
            d = self.stop_multiple * (c - band if long else band - c)
        return F.when(d > 0, d)

    def target(self) -> Column:
        """Distance of the take profit; NULL without one."""
        if self.take_profit is None:
            return F.lit(None).cast("double")
        return self.take_profit * (self.stop() if self.target_kind == "ratio" else ft.atr(14, LOOKBACK))

    def signals(self, bars: DataFrame) -> DataFrame:
        """symbol, ts, direction, strength, stop_distance, take_profit of bars at which the rule fires and can place its stop."""
        d = with_ranges(bars).withColumns({"__hit": self.entry(), "stop_distance": self.stop(), "take_profit": self.target()})
        ready = F.col("__hit") & F.col("stop_distance").isNotNull() & (ft.atr(14, LOOKBACK) > 0)
        fired = d.withColumn("__ready", F.coalesce(ready, F.lit(False))).where("__ready")
        return fired.select("symbol", "ts", F.lit(self.direction).alias("direction"), F.lit(1.0).alias("strength"), "stop_distance", "take_profit")

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Rule:
        d = json.loads(text)
        feature = lambda x: None if x is None else Feature(**x)
        clauses = tuple(Clause(c["kind"], feature(c["left"]), c["up"], feature(c["right"]), c["level"], c.get("scale", "atr")) for c in d.pop("clauses"))
        return Rule(clauses, **d)


def distinct_features(rules: list[Rule]) -> list[Feature]:
    """Each feature instance of all rules once, so that configurations share columns."""
    return sorted({f for r in rules for c in r.clauses for f in (c.left, c.right) if f is not None}, key=lambda f: (f.op, f.period, f.slow))


def parameters(names: dict[str, tuple[float, float, float, bool]], values: dict[str, float]) -> dict[str, float]:
    """Values of declared parameters (name: default, low, high, whole number), defaults where none is given; raises for others and beyond bounds."""
    if len(names) > 7 or set(values) - set(names):
        raise ValueError(f"not declared, or too many: {sorted(values)}")
    out = {}
    for k, (default, low, high, whole) in names.items():
        v = values.get(k, default)
        if not low <= v <= high or (whole and v != int(v)):
            raise ValueError(f"{k} = {v} is out of bounds")
        out[k] = int(v) if whole else float(v)
    return out


@dataclass
class Formula:
    """An arithmetic score formula over named columns, parsed to a column (at most 64 nodes)."""

    text: str
    names: tuple[str, ...] = field(default_factory=tuple)

    def column(self) -> Column:
        tree = ast.parse(self.text, mode="eval")
        if sum(1 for _ in ast.walk(tree)) > 64:
            raise ValueError("the formula is too long")
        out = self._node(tree.body)
        return F.when(~F.isnan(out) & (F.abs(out) < float("inf")), out)

    def _node(self, n: ast.AST) -> Column:
        if isinstance(n, ast.Constant) and isinstance(n.value, int | float):
            return F.lit(float(n.value))
        if isinstance(n, ast.Name) and n.id in self.names:
            return F.col(n.id).cast("double")
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.USub):
            return -self._node(n.operand)
        if isinstance(n, ast.BinOp):
            a, b = self._node(n.left), self._node(n.right)
            for kind, f in ((ast.Add, lambda: a + b), (ast.Sub, lambda: a - b), (ast.Mult, lambda: a * b), (ast.Div, lambda: F.try_divide(a, b)), (ast.Pow, lambda: F.pow(a, b))):
                if isinstance(n.op, kind):
                    return f()
        raise ValueError(f"not allowed in a formula: {ast.dump(n)[:80]}")
