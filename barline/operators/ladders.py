"""Ladders of orders: neutral grids and averaging-down cycles replayed bar by bar, one group a symbol.

A bar visits its open, its near extreme, the far one and its close (the low first if it closes up). A leg of that
path crosses all levels between its ends, so its fills are found by one search and summed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def visited(before: float, o: float, h: float, l: float, c: float) -> tuple[float, ...]:
    """The prices that a bar passes, from the close before it."""
    return (before, o, l, h, c) if c >= o else (before, o, h, l, c)


@dataclass(frozen=True)
class Grid:
    """``levels`` gaps over twice the monthly deviation around the start; values are shares of a capital of 1."""

    levels: int = 20
    least_step: float = 0.002
    maker: float = 0.0002
    taker: float = 0.0005
    recentre: bool = True  # beyond a step outside of the range: close at market and begin anew there; else hold


def ladder(price: float, deviation: float, equity: float, rules: Grid) -> tuple[np.ndarray, np.ndarray]:
    """Prices of the levels, evenly apart in logarithms, and units bought or sold in each gap."""
    reach = 2 * deviation * np.sqrt(30.0)
    step = max(2 * reach / rules.levels, rules.least_step)
    at = price * np.exp((np.arange(rules.levels + 1) - rules.levels / 2) * step)
    return at, 2 * equity / rules.levels / at[:-1]


def grid_equity(o: np.ndarray, h: np.ndarray, l: np.ndarray, c: np.ndarray, deviation: np.ndarray, rules: Grid) -> tuple[np.ndarray, dict[str, float]]:
    """Equity at each close (0 once ruined) and counts: fills, resets, fees."""
    out, count = np.ones(len(o)), {"fills": 0, "resets": 0, "fees": 0.0}
    cash, units, levels, gaps, place = 1.0, 0.0, None, None, 0
    for i in range(len(o)):
        fresh = levels is None
        if fresh:
            if not deviation[i] > 0:
                out[i] = cash
                continue
            levels, gaps = ladder(o[i], deviation[i], cash, rules)
            place = rules.levels // 2
        points = visited(o[i] if fresh else c[i - 1], o[i], h[i], l[i], c[i])
        for x, y in zip(points, points[1:]):
            # ``place``: the level that was passed last; gap k lies between levels k and k + 1.
            if y < x:
                new = min(place, int(np.searchsorted(levels, y)))
                bought = gaps[new:place]
                value = float((bought * levels[new:place]).sum())
                units, cash = units + float(bought.sum()), cash - value * (1 + rules.maker)
            elif y > x:
                new = max(place, int(np.searchsorted(levels, y, "right")) - 1)
                sold = gaps[place:new]
                value = float((sold * levels[place + 1 : new + 1]).sum())
                units, cash = units - float(sold.sum()), cash + value * (1 - rules.maker)
            else:
                continue
            count["fills"] += abs(new - place)
            count["fees"] += value * rules.maker
            place = new
            step = levels[1] / levels[0]
            if rules.recentre and ((place == 0 and y < levels[0] / step) or (place == rules.levels and y > levels[-1] * step)):
                fee = abs(units) * y * rules.taker
                cash, units = cash + units * y - fee, 0.0
                count["resets"] += 1
                count["fees"] += fee
                levels, gaps = ladder(y, deviation[i], max(cash, 0.0), rules)
                place = rules.levels // 2
        out[i] = cash + units * c[i]
        if out[i] <= 0:
            out[i:] = 0.0
            break
    return out, count


@dataclass(frozen=True)
class Averaging:
    """A base order and ``orders`` more, each ``first`` * ``spread`` ** k further away and ``growth`` times as large; profit is taken at ``profit`` over the average."""

    side: int = 1
    orders: int = 5
    first: float = 0.01
    spread: float = 1.3
    growth: float = 1.5
    profit: float = 0.01
    stop: float = 0.0  # beyond the last order; 0: none
    maker: float = 0.0002
    taker: float = 0.0005


def averaging_equity(o: np.ndarray, h: np.ndarray, l: np.ndarray, c: np.ndarray, rules: Averaging) -> tuple[np.ndarray, dict[str, float]]:
    """Equity at each close (0 once ruined) and counts: cycles, profits, stops, fees. A cycle begins at the open after the last one ended."""
    d = rules.side
    away = np.cumsum(rules.first * rules.spread ** np.arange(rules.orders))
    sizes = rules.growth ** np.arange(1, rules.orders + 1)
    out, count = np.ones(len(o)), {"cycles": 0, "profits": 0, "stops": 0, "fees": 0.0}
    cash, units, cost, filled = 1.0, 0.0, 0.0, 0

    def trade(value: float, price: float, fee: float) -> None:
        """Adds ``value`` (signed) at a price."""
        nonlocal cash, units, cost
        units, cost, cash = units + value / price, cost + value, cash - value - abs(value) * fee
        count["fees"] += abs(value) * fee

    for i in range(len(o)):
        fresh = units == 0.0
        if fresh:
            base = cash / (1 + float(sizes.sum()))
            trade(d * base, o[i], rules.taker)
            prices, filled = o[i] * (1 - d * away), 0
            count["cycles"] += 1
        points = visited(o[i] if fresh else c[i - 1], o[i], h[i], l[i], c[i])
        for x, y in zip(points, points[1:]):
            if d * y < d * x:
                reached = max(filled, int(np.searchsorted(-d * prices, -d * y, "right")))
                for k in range(filled, reached):
                    trade(d * base * float(sizes[k]), d * min(d * float(prices[k]), d * x), rules.maker)
                filled = reached
                end = float(prices[-1]) * (1 - d * rules.stop)
                if rules.stop > 0 and filled == rules.orders and d * y <= d * end:
                    price, kind, fee = d * min(d * end, d * x), "stops", rules.taker
                else:
                    continue
            elif d * y > d * x:
                target = cost / units * (1 + d * rules.profit)
                if d * y < d * target:
                    continue
                price, kind, fee = d * max(d * target, d * x), "profits", rules.maker
            else:
                continue
            value = abs(units) * price
            cash, units, cost = cash + units * price - value * fee, 0.0, 0.0
            count["fees"] += value * fee
            count[kind] += 1
            break
        out[i] = cash + units * c[i]
        if out[i] <= 0:
            out[i:] = 0.0
            break
    return out, count


LADDERS = "symbol string, kind string, fills bigint, ends bigint, fees double, final_equity double, max_drawdown double"


def replay_ladders(bars: DataFrame, grid: Grid = Grid(), averaging: Averaging = Averaging()) -> DataFrame:
    """A grid and an averaging cycle over each symbol's bars (with a column ``deviation`` known at the open)."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        t = table.sort_by("ts")
        p = [t.column(k).to_numpy() for k in ("open", "high", "low", "close")]
        e1, n1 = grid_equity(*p, t.column("deviation").fill_null(0).to_numpy(), grid)
        e2, n2 = averaging_equity(*p, averaging)
        fall = lambda e: float(np.max(1 - e / np.maximum.accumulate(np.maximum(e, 1e-12))))
        rows = [(key[0].as_py(), "grid", n1["fills"], n1["resets"], n1["fees"], float(e1[-1]), fall(e1)), (key[0].as_py(), "averaging", n2["cycles"], n2["profits"] + n2["stops"], n2["fees"], float(e2[-1]), fall(e2))]
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
        return pa.table([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], [f.split()[0] for f in LADDERS.split(", ")])

    return bars.groupBy("symbol").applyInArrow(run, LADDERS)
