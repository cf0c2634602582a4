"""Accounts replayed over ordered bars: one bracketed position at a time.

A signal at a bar's close proposes a stop and a target around that close. The next
open enters, unless it lies outside of both (the order is denied, as is one that
affords no lot): the quantity risks a share of the signal's equity between the open
and the stop, capped by the cash. From the entry bar on, the worse touch counts: a low
at the stop fills at the stop or a lower open; a high above the target (strictly)
fills at the target. A position's bars are counted from the entry's; after ``hold`` of
them the next open ends it. Fees are taken on both sides.

Bars of a symbol are one group; configurations are lists of fired ids on its bars, so
bars are shuffled once for each CONFIGS_A_TASK of them. Within a group a configuration
leaps from signal to exit over slices; nothing is done bar by bar.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONFIGS_A_TASK = 100
TRADES = "symbol string, config_id bigint, entry_ix bigint, exit_ix bigint, entry_price double, exit_price double, quantity double, outcome string"
TOTALS = (
    "symbol string, config_id bigint, n_trades bigint, n_stops bigint, n_targets bigint, n_timeouts bigint, n_denied bigint, n_ambiguous bigint, "
    "bars_held bigint, final_equity double, max_drawdown double, turned double, mean_equity double, sharpe double, sortino double"
)
CURVES = "symbol string, config_id bigint, bar_ix bigint, equity double"


@dataclass(frozen=True)
class Account:
    """Rules of the account; ``lot`` is the smallest step of a quantity; ``year`` the bars of a year, for ratios."""

    cash: float = 100_000.0
    risk: float = 0.01
    fee: float = 0.0015
    lot: float = 1e-6
    hold: int = 100
    year: float = 365.0


def lots(quantity: float, step: float) -> float:
    return math.floor(quantity / step + 1e-9) * step if quantity > 0 else 0.0


@dataclass
class Run:
    """What one configuration did: its trades (entry, exit, prices, quantity, outcome), counts and equity by bar."""

    trades: list[tuple] = field(default_factory=list)
    denied: int = 0
    ambiguous: int = 0
    equity: np.ndarray = field(default_factory=lambda: np.zeros(0))
    turned: float = 0.0  # traded value, with that of a position still open


def replay(bars: dict[str, np.ndarray], fired: np.ndarray, stop_distance: np.ndarray, target_distance: np.ndarray, rules: Account) -> Run:
    """``fired``: ascending bar numbers of signals, all with positive distances."""
    o, h, l, c = (bars[k] for k in ("open", "high", "low", "close"))
    n, run, cash, fee = len(o), Run(equity=np.zeros(len(o))), rules.cash, rules.fee
    at, flat_from = 0, 0  # the next signal's bar at least; first bar whose equity isn't known yet
    while True:
        k = int(np.searchsorted(fired, at))
        if k == len(fired) or fired[k] + 1 >= n:
            break
        i = int(fired[k])
        e, stop, target = i + 1, c[i] - stop_distance[i], c[i] + target_distance[i]
        at = e
        quantity = 0.0
        if 0 < stop < o[e] < target:
            quantity = min(lots(cash * rules.risk / (o[e] - stop), rules.lot), lots(cash / (o[e] * (1 + fee)), rules.lot))
        if not quantity > 0:
            run.denied += 1
            continue
        run.equity[flat_from:e] = cash
        notional = quantity * o[e]
        cash -= notional * (1 + fee)
        run.turned += notional
        end = min(e + rules.hold, n)
        low, high = l[e:end] <= stop, h[e:end] > target
        touched = np.flatnonzero(low | high)
        if len(touched):
            j = e + int(touched[0])
            outcome = "stop" if low[j - e] else "target"
            price = min(stop, o[j]) if outcome == "stop" else target
            run.ambiguous += int(low[j - e] and high[j - e])
        elif e + rules.hold < n:
            j, outcome, price = e + rules.hold, "timeout", o[e + rules.hold]
        else:
            run.equity[e:] = cash + quantity * c[e:]
            return run
        run.equity[e:j] = cash + quantity * c[e:j]
        proceeds = quantity * price
        cash += proceeds * (1 - fee)
        run.turned += proceeds
        run.trades.append((e, j, float(o[e]), float(price), quantity, outcome))
        at = flat_from = j
    run.equity[flat_from:] = cash
    return run


def totals(run: Run, rules: Account) -> dict[str, float]:
    outcome = [t[5] for t in run.trades]
    e = run.equity
    r = np.where(e[:-1] > 0, e[1:] / np.where(e[:-1] > 0, e[:-1], 1) - 1, 0.0)
    deviation = float(np.std(r, ddof=1)) if len(r) > 1 else 0.0
    downside = float(np.sqrt(np.mean(np.minimum(r, 0) ** 2))) if len(r) > 1 else 0.0
    mean, year = float(np.mean(r)) if len(r) else 0.0, math.sqrt(rules.year)
    return {
        "n_trades": len(outcome),
        "n_stops": outcome.count("stop"),
        "n_targets": outcome.count("target"),
        "n_timeouts": outcome.count("timeout"),
        "n_denied": run.denied,
        "n_ambiguous": run.ambiguous,
        # A touched exit counts its own bar; one at the next open doesn't.
        "bars_held": sum(t[1] - t[0] + (t[5] != "timeout") for t in run.trades),
        "final_equity": float(e[-1]) if len(e) else rules.cash,
        "max_drawdown": float(np.max(1 - e / np.maximum.accumulate(e))) if len(e) else 0.0,
        "turned": float(run.turned),
        "mean_equity": float(np.mean(e)) if len(e) else rules.cash,
        "sharpe": mean / deviation * year if deviation > 0 else 0.0,
        "sortino": mean / downside * year if downside > 0 else 0.0,
    }


def _replayed(bars: DataFrame, configs: int, rules: Account, target: Column, schema: str, give) -> DataFrame:
    """``bars`` has symbol, ts, open, high, low, close, stop_distance and fired (ids of the configurations that fire)."""
    ok = (F.col("stop_distance") > 0) & (target > 0)
    tasks = -(-configs // CONFIGS_A_TASK)
    rows = bars.select("symbol", "ts", "open", "high", "low", "close", "stop_distance", target.alias("target_distance"), F.when(ok, F.col("fired").cast("array<int>")).otherwise(F.array().cast("array<int>")).alias("fired"))
    rows = rows.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))) if tasks > 1 else F.lit(0))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        t = table.sort_by("ts").combine_chunks()
        prices = {k: t.column(k).to_numpy() for k in ("open", "high", "low", "close")}
        stop, reach = (t.column(k).fill_null(0).to_numpy() for k in ("stop_distance", "target_distance"))
        lists = t.column("fired").combine_chunks()
        ids = lists.flatten().to_numpy()
        where = np.repeat(np.arange(len(t)), np.diff(lists.offsets.to_numpy()))
        symbol, task = key[0].as_py(), key[1].as_py()
        out = []
        for config in range(task * CONFIGS_A_TASK, min(configs, (task + 1) * CONFIGS_A_TASK)):
            out += give(symbol, config, replay(prices, where[ids == config], stop, reach, rules))
        names = [x.split()[0] for x in schema.split(", ")]
        return pa.Table.from_pylist([dict(zip(names, x)) for x in out], pa.schema([(x.split()[0], {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64()}[x.split()[1]]) for x in schema.split(", ")]))

    return rows.groupBy("symbol", "task").applyInArrow(run, schema)


def replay_grid(bars: DataFrame, configs: int, rules: Account = Account(), target: Column | None = None) -> DataFrame:
    """Totals of each (symbol, configuration); ``target``: distance of the take profit, twice the stop's by default."""
    target = 2 * F.col("stop_distance") if target is None else target
    return _replayed(bars, configs, rules, target, TOTALS, lambda s, k, r: [(s, k, *totals(r, rules).values())])


def replay_trades(bars: DataFrame, configs: int, rules: Account = Account(), target: Column | None = None) -> DataFrame:
    """Each closed trade of each (symbol, configuration)."""
    target = 2 * F.col("stop_distance") if target is None else target
    return _replayed(bars, configs, rules, target, TRADES, lambda s, k, r: [(s, k, *t) for t in r.trades])


def replay_curves(bars: DataFrame, configs: int, rules: Account = Account(), target: Column | None = None) -> DataFrame:
    """Equity at each bar's close of each (symbol, configuration)."""
    target = 2 * F.col("stop_distance") if target is None else target
    return _replayed(bars, configs, rules, target, CURVES, lambda s, k, r: [(s, k, i, float(x)) for i, x in enumerate(r.equity)])
