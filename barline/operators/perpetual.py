"""Perpetual contracts on isolated margin: closed forms as columns, and accounts of one position replayed.

A position is opened at the next open with the lowest leverage that the balance can fund and that keeps its
liquidation price at least ``clearance`` of the stop's distance behind the stop. Within a bar the minutes of the
trade and the mark path tell what comes first: liquidation (mark), stop (trade), take profit (trade, beyond the
price), in this order within one minute. Settlements change the margin, and so the liquidation price, from their
minute on. Between two settlements all levels stand still, so a span of minutes is searched at once.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def liquidation_column(side: Column, quantity: Column, entry: Column, margin: Column, mmr: Column, amount: Column) -> Column:
    """Price at which an isolated position's margin is used up to its maintenance."""
    value = entry * quantity
    return F.when(side > 0, (value - margin - amount) / (quantity * (1 - mmr))).otherwise((value + margin + amount) / (quantity * (1 + mmr)))


def maintenance_column(value: Column, mmr: Column, amount: Column) -> Column:
    return value * mmr - amount


@dataclass(frozen=True)
class Tier:
    cap: float
    leverage: int
    mmr: float
    amount: float


#: Tiers of the fixtures: up to a cap of value, most leverage, maintenance rate and amount.
TIERS = (Tier(50_000, 50, 0.004, 0), Tier(250_000, 20, 0.005, 50), Tier(1_000_000, 10, 0.01, 1300), Tier(5_000_000, 5, 0.025, 16_300))


@dataclass(frozen=True)
class Margin:
    cash: float = 100_000.0
    risk: float = 0.01
    cap: float = 0.1
    fee: float = 0.0005
    leverage: int = 20
    clearance: float = 0.25
    hold: int = 60
    ratio: float = 2.0
    tiers: tuple[Tier, ...] = TIERS


@dataclass
class Outcome:
    trades: list[tuple] = field(default_factory=list)  # entry bar, exit bar, entry price, exit price, quantity, leverage, outcome
    denied: int = 0
    ambiguous: int = 0
    paid: float = 0.0  # settlements paid, less those received
    equity: np.ndarray = field(default_factory=lambda: np.zeros(0))


def tier_of(value: float, tiers: Sequence[Tier]) -> Tier | None:
    return next((t for t in tiers if value <= t.cap), None)


def liquidation(side: int, quantity: float, entry: float, margin: float, t: Tier) -> float:
    if side > 0:
        return (entry * quantity - margin - t.amount) / (quantity * (1 - t.mmr))
    return (entry * quantity + margin + t.amount) / (quantity * (1 + t.mmr))


def lowest_leverage(side: int, quantity: float, entry: float, stop: float, balance: float, rules: Margin) -> tuple[int, Tier] | None:
    """The least leverage that can be funded with its fee and liquidates far enough behind the stop."""
    value = quantity * entry
    t = tier_of(value, rules.tiers)
    if t is None:
        return None
    for leverage in range(1, min(rules.leverage, t.leverage) + 1):
        margin = value / leverage
        room = side * (stop - liquidation(side, quantity, entry, margin, t))
        if margin + value * rules.fee <= balance and room >= rules.clearance * abs(entry - stop):
            return leverage, t
    return None


def replay(bars: dict[str, np.ndarray], path: dict[str, np.ndarray], begin: np.ndarray, due: np.ndarray, payments: np.ndarray, fired: np.ndarray, distance: np.ndarray, side: int, rules: Margin) -> Outcome:
    """``bars``: open, close, mark (closes). ``path``: low, high, mark_low, mark_high of all minutes; those of bar b are
    begin[b] to begin[b + 1]. ``due``: ascending minutes of settlements, ``payments``: mark times rate of each."""
    o, c, mark = bars["open"], bars["close"], bars["mark"]
    n, out, balance = len(o), Outcome(equity=np.zeros(len(o))), rules.cash
    bar_of = np.repeat(np.arange(n), np.diff(begin))
    at = flat = 0
    while True:
        k = int(np.searchsorted(fired, at))
        if k == len(fired) or fired[k] + 1 >= n:
            break
        i = int(fired[k])
        at = e = i + 1
        stop, target, price = c[i] - side * distance[i], c[i] + side * rules.ratio * distance[i], float(o[e])
        risk, chosen, quantity = balance * rules.risk, None, 0.0
        if min(price, stop, target) > 0 and side * stop < side * price < side * target and balance > 0 and risk <= balance * rules.cap:
            quantity = risk / abs(price - stop)
            chosen = lowest_leverage(side, quantity, price, stop, balance, rules)
        if chosen is None:
            out.denied += 1
            continue
        out.equity[flat:e] = balance
        leverage, t = chosen
        margin = quantity * price / leverage
        balance -= margin + quantity * price * rules.fee
        margins = np.full(n, margin)
        a, end = int(begin[e]), int(begin[min(e + rules.hold, n)])
        found = None
        while a < end and found is None:
            s = int(np.searchsorted(due, a))
            while s < len(due) and due[s] == a:
                cost = side * quantity * float(payments[s])
                margin -= cost
                out.paid += cost
                margins[bar_of[a] :] = margin
                s += 1
            b = min(end, int(due[s])) if s < len(due) else end
            level = liquidation(side, quantity, price, margin, t)
            worst, best, m_worst = (path["low"], path["high"], path["mark_low"]) if side > 0 else (path["high"], path["low"], path["mark_high"])
            hits = [np.flatnonzero(side * m_worst[a:b] <= side * level), np.flatnonzero(side * worst[a:b] <= side * stop), np.flatnonzero(side * best[a:b] > side * target)]
            first = sorted((int(h[0]), p) for p, h in enumerate(hits) if len(h))
            if first:
                found = (a + first[0][0], first[0][1])
                out.ambiguous += len(first) > 1 and first[1][0] == first[0][0]
                break
            a = b
        if found is not None:
            j = int(bar_of[found[0]])
            outcome = ("liquidation", "stop", "target")[found[1]]
            fill = level if outcome == "liquidation" else target if outcome == "target" else side * min(side * stop, side * float(o[j]))
        elif e + rules.hold < n:
            j, outcome, fill = e + rules.hold, "timeout", float(o[e + rules.hold])
        else:
            j, outcome, fill = n, "open", 0.0
        held = slice(e, j)
        out.equity[held] = balance + margins[held] + np.maximum(side * quantity * (mark[held] - price), -margins[held])
        if outcome == "open":
            return out
        if outcome != "liquidation":
            balance += margin + max(side * quantity * (fill - price), -margin) - quantity * fill * rules.fee
        out.trades.append((e, j, price, float(fill), quantity, leverage, outcome))
        at = flat = j
    out.equity[flat:] = balance
    return out


TOTALS = "symbol string, config_id bigint, n_trades bigint, n_stops bigint, n_targets bigint, n_timeouts bigint, n_liquidations bigint, n_denied bigint, n_ambiguous bigint, funding_paid double, final_equity double, max_drawdown double"


def replay_perpetual(bars: DataFrame, configs: int, side: int = 1, rules: Margin = Margin()) -> DataFrame:
    """Totals of each (symbol, configuration).

    ``bars``: symbol, ts, open, close, mark_close, stop_distance, fired (ids), path (array of minute, low, high,
    mark_low, mark_high in order) and settlements (array of minute, rate, mark): a bar's own, so bounded.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.sort_by("ts").to_pydict()
        points = [p for ps in rows["path"] for p in ps]
        begin = np.concatenate([[0], np.cumsum([len(p) for p in rows["path"]])])
        path = {k: np.array([p[k] for p in points], float) for k in ("low", "high", "mark_low", "mark_high")}
        due, payments = [], []
        for b, (ps, settled) in enumerate(zip(rows["path"], rows["settlements"])):
            minutes = [p["minute"] for p in ps]
            for x in settled or []:
                due.append(int(begin[b]) + int(np.searchsorted(minutes, x["minute"])))
                payments.append((x["mark"] or 0.0) * x["rate"])
        prices = {k: np.array(rows[c], float) for k, c in (("open", "open"), ("close", "close"), ("mark", "mark_close"))}
        distance = np.array([d or 0.0 for d in rows["stop_distance"]])
        out = []
        for config in range(configs):
            fired = np.array([i for i, f in enumerate(rows["fired"]) if config in f and distance[i] > 0], np.int64)
            r = replay(prices, path, begin, np.array(due, np.int64), np.array(payments), fired, distance, side, rules)
            kinds = [t[6] for t in r.trades]
            peak = np.maximum.accumulate(r.equity)
            out.append((key[0].as_py(), config, len(kinds), *[kinds.count(k) for k in ("stop", "target", "timeout", "liquidation")], r.denied, r.ambiguous, r.paid, float(r.equity[-1]), float(np.max(1 - r.equity / peak))))
        fields = [f.split() for f in TOTALS.split(", ")]
        return pa.Table.from_pylist([dict(zip([f[0] for f in fields], x)) for x in out], pa.schema([(a, {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64()}[b]) for a, b in fields]))

    return bars.groupBy("symbol").applyInArrow(run, TOTALS)


@dataclass(frozen=True)
class SharedCash:
    """Rules of one cash account over many slots."""

    cash: float = 100_000.0
    risk: float = 0.01
    cap: float = 0.1
    fee: float = 0.0015
    lot: float = 1e-6
    hold: int = 100
    ratio: float = 2.0


def shared_account(rows: list[dict], rules: SharedCash) -> tuple[list[tuple], list[tuple], dict[str, int]]:
    """Closed trades (slot, entry ts, exit ts, entry price, exit price, quantity, outcome), the curve (ts, equity, n_open) and refusals by reason.

    ``rows``: ts, slot, open, high, low, close, stop_distance (None: no signal), in order of time; a slot may have no bar
    at a time. At each time: timeouts leave, entries fill in the order of their signals and slots while the risk open
    stays within the cap, touched positions leave, then one equity values what is held at the last closes.
    """
    held: dict[str, list] = {}  # slot: quantity, distance, stop, target, entry price, entry ts, bars
    asked: dict[str, tuple] = {}  # slot: signal's time, stop, target, equity
    cash, last, closed, curve = rules.cash, {}, [], []
    refused: dict[str, int] = {}
    left = {s: sum(r["slot"] == s for r in rows) for s in {r["slot"] for r in rows}}

    def leave(slot: str, ts: object, price: float, outcome: str) -> None:
        nonlocal cash
        q = held.pop(slot)
        cash += q[0] * price * (1 - rules.fee)
        closed.append((slot, q[5], ts, q[4], price, q[0], outcome))

    def refuse(reason: str) -> None:
        refused[reason] = refused.get(reason, 0) + 1

    start = 0
    while start < len(rows):
        ts = rows[start]["ts"]
        end = start
        while end < len(rows) and rows[end]["ts"] == ts:
            end += 1
        here = {r["slot"]: r for r in sorted(rows[start:end], key=lambda r: r["slot"])}
        for slot, r in here.items():
            if slot in held and held[slot][6] >= rules.hold:
                leave(slot, ts, r["open"], "timeout")
        for slot in sorted((s for s in asked if s in here), key=lambda s: (asked[s][0], s)):
            _, stop, target, equity = asked.pop(slot)
            price = here[slot]["open"]
            if slot in held:
                continue
            risk = equity * rules.risk
            if not 0 < stop < price < target:
                refuse("bracket_entry")
            elif sum(q[0] * q[1] for q in held.values()) + risk > equity * rules.cap:
                refuse("portfolio_risk_cap")
            else:
                wanted, afford = (math.floor(x / rules.lot + 1e-9) * rules.lot for x in (risk / (price - stop), cash / (price * (1 + rules.fee))))
                quantity = min(wanted, afford)
                if quantity > 0:
                    cash -= quantity * price * (1 + rules.fee)
                    held[slot] = [quantity, price - stop, stop, target, price, ts, 0]
                else:
                    refuse("cash" if wanted > 0 else "lot")
        for slot, r in here.items():
            left[slot] -= 1
            last[slot] = r["close"]
            if slot in held:
                held[slot][6] += 1
                if r["low"] <= held[slot][2]:
                    leave(slot, ts, min(held[slot][2], r["open"]), "stop")
                elif r["high"] > held[slot][3]:
                    leave(slot, ts, held[slot][3], "target")
        equity = cash + sum(q[0] * last[s] for s, q in held.items())
        curve.append((ts, equity, len(held)))
        for slot, r in here.items():
            if slot not in held and left[slot] and (r["stop_distance"] or 0) > 0:
                asked[slot] = (ts, r["close"] - r["stop_distance"], r["close"] + rules.ratio * r["stop_distance"], equity)
        start = end
    return closed, curve, refused


CURVE = "account bigint, ts timestamp_ntz, equity double, n_open bigint"


def shared_curves(bars: DataFrame, rules: SharedCash = SharedCash()) -> DataFrame:
    """account, ts, equity, n_open of accounts that share their cash among slots (``bars``: account, slot, ts, prices, stop_distance).

    An account is one sequence, so one group; accounts (scenarios) run beside each other.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        _, curve, _ = shared_account(table.sort_by([("ts", "ascending"), ("slot", "ascending")]).to_pylist(), rules)
        ts, equity, n = zip(*curve) if curve else ((), (), ())
        return pa.table({"account": pa.array([key[0].as_py()] * len(ts), pa.int64()), "ts": pa.array(ts, pa.timestamp("us")), "equity": pa.array(equity, pa.float64()), "n_open": pa.array(n, pa.int64())})

    return bars.groupBy("account").applyInArrow(run, CURVE)
