"""Margin accounts, shared accounts and ladders against plain loops and by hand."""

import numpy as np
import pytest

from barline.operators import ladders as la
from barline.operators import perpetual as pe
from barline.operators import replay as rp


def market(seed, n=160, minutes=6):
    r = np.random.default_rng(seed)
    steps = r.normal(0, 0.6, n * minutes).cumsum() + 100
    mid = steps.reshape(n, minutes)
    noise = np.abs(r.normal(0, 0.4, (4, n, minutes)))
    path = {"low": mid - noise[0], "high": mid + noise[1], "mark_low": mid - noise[2] * 0.7, "mark_high": mid + noise[3] * 0.7}
    bars = {"open": mid[:, 0], "close": mid[:, -1], "mark": mid[:, -1] + r.normal(0, 0.1, n)}
    due = np.sort(r.choice(n * minutes, 60, replace=False))
    fired = np.flatnonzero(r.random(n) < 0.3)
    return bars, {k: v.ravel() for k, v in path.items()}, np.arange(n + 1) * minutes, due, r.normal(0.02, 0.05, 60), fired, np.abs(r.normal(1.5, 0.4, n)) + 0.2


def minute_by_minute(bars, path, begin, due, payments, fired, distance, side, rules):
    """The same rules with one step a minute."""
    n, balance, held, trades, denied, curve, due_at = len(bars["open"]), rules.cash, None, [], 0, [], {}
    for d, p in zip(due, payments):
        due_at.setdefault(int(d), []).append(p)
    asked = None
    for b in range(n):
        o = float(bars["open"][b])
        if held and b - held["bar"] >= rules.hold:
            balance += held["margin"] + max(side * held["q"] * (o - held["entry"]), -held["margin"]) - held["q"] * o * rules.fee
            trades.append((held["bar"], b, "timeout"))
            held = None
        if asked is not None and held is None:
            stop, target = asked
            risk = balance * rules.risk
            lev = None
            if min(o, stop, target) > 0 and side * stop < side * o < side * target and balance > 0 and risk <= balance * rules.cap:
                q = risk / abs(o - stop)
                t = next((t for t in rules.tiers if q * o <= t.cap), None)
                for k in range(1, (min(rules.leverage, t.leverage) if t else 0) + 1):
                    liq = pe.liquidation(side, q, o, q * o / k, t)
                    if q * o / k + q * o * rules.fee <= balance and side * (stop - liq) >= rules.clearance * abs(o - stop):
                        lev = k
                        break
            if lev is None:
                denied += 1
            else:
                held = {"bar": b, "q": q, "entry": o, "margin": q * o / lev, "stop": stop, "target": target, "t": t}
                balance -= held["margin"] + q * o * rules.fee
        asked = None
        for minute in range(begin[b], begin[b + 1]):
            if not held:
                break
            for p in due_at.get(minute, []):
                held["margin"] -= side * held["q"] * p
            liq = pe.liquidation(side, held["q"], held["entry"], held["margin"], held["t"])
            low, high, ml, mh = (path[k][minute] for k in ("low", "high", "mark_low", "mark_high"))
            if (ml <= liq) if side > 0 else (mh >= liq):
                trades.append((held["bar"], b, "liquidation"))
                held = None
            elif (low <= held["stop"]) if side > 0 else (high >= held["stop"]):
                fill = min(held["stop"], o) if side > 0 else max(held["stop"], o)
                balance += held["margin"] + max(side * held["q"] * (fill - held["entry"]), -held["margin"]) - held["q"] * fill * rules.fee
                trades.append((held["bar"], b, "stop"))
                held = None
            elif (high > held["target"]) if side > 0 else (low < held["target"]):
                fill = held["target"]
                balance += held["margin"] + max(side * held["q"] * (fill - held["entry"]), -held["margin"]) - held["q"] * fill * rules.fee
                trades.append((held["bar"], b, "target"))
                held = None
        curve.append(balance + (held["margin"] + max(side * held["q"] * (bars["mark"][b] - held["entry"]), -held["margin"]) if held else 0))
        if not held and b + 1 < n and b in fired:
            c = bars["close"][b]
            asked = (c - side * distance[b], c + side * rules.ratio * distance[b])
    return trades, denied, curve


@pytest.mark.parametrize("side", [1, -1])
@pytest.mark.parametrize("seed", range(4))
def test_perpetual_against_minutes(side, seed):
    data = market(seed)
    rules = pe.Margin(hold=(8, 20, 60, 5)[seed], risk=(0.01, 0.05, 0.02, 0.1)[seed], clearance=(0.25, 0.0, 0.25, -50.0)[seed], leverage=(20, 50, 3, 50)[seed])
    run = pe.replay(*data, side, rules)
    trades, denied, curve = minute_by_minute(*data, side, rules)
    assert [(t[0], t[1], t[6]) for t in run.trades] == trades and trades
    assert run.denied == denied and run.equity == pytest.approx(curve, rel=1e-9)


def test_liquidation_and_tiers():
    t = pe.TIERS[0]
    level = pe.liquidation(1, 10.0, 100.0, 50.0, t)
    assert 50 + 10 * (level - 100) == pytest.approx(level * 10 * t.mmr - t.amount)
    assert pe.tier_of(50_000, pe.TIERS) is t and pe.tier_of(6e6, pe.TIERS) is None
    assert pe.lowest_leverage(1, 10.0, 100.0, 99.0, 1100.0, pe.Margin())[0] == 1 and pe.lowest_leverage(1, 10.0, 100.0, 99.0, 600.0, pe.Margin())[0] == 2


def test_one_slot_is_a_single_replay():
    r = np.random.default_rng(3)
    c = 100 + r.normal(0, 1, 300).cumsum()
    o = np.concatenate([[100], c[:-1]]) + r.normal(0, 0.3, 300)
    h, l = np.maximum(o, c) + np.abs(r.normal(0, 0.5, 300)), np.minimum(o, c) - np.abs(r.normal(0, 0.5, 300))
    fired = np.flatnonzero(r.random(300) < 0.2)
    d = np.full(300, 1.5)
    run = rp.replay({"open": o, "high": h, "low": l, "close": c}, fired, d, 2 * d, rp.Account(hold=15))
    rows = [{"ts": i, "slot": "X", "open": o[i], "high": h[i], "low": l[i], "close": c[i], "stop_distance": 1.5 if i in fired else None} for i in range(300)]
    closed, curve, refused = pe.shared_account(rows, pe.SharedCash(hold=15))
    assert [(t[1], t[2], t[6]) for t in closed] == [(t[0], t[1], t[5]) for t in run.trades] and sum(refused.values()) == run.denied
    assert [x[1] for x in curve] == pytest.approx(run.equity.tolist())


def test_shared_cash_is_capped_in_order():
    flat = {"open": 10.0, "high": 10.0, "low": 10.0, "close": 10.0}
    rows = [{"ts": t, "slot": s, **flat, "stop_distance": 1.0 if t == 0 else None} for t in range(3) for s in "CAB"]
    rows = sorted(rows, key=lambda r: (r["ts"], r["slot"]))
    _, curve, refused = pe.shared_account(rows, pe.SharedCash(cash=1000, fee=0.0, lot=0.001, risk=0.01, cap=0.02))
    assert [x[2] for x in curve] == [0, 2, 2] and refused == {"portfolio_risk_cap": 1}
    # A slot without a bar waits, and the snapshot that its signal saw still holds.
    rows = [r for r in rows if not (r["slot"] == "A" and r["ts"] == 1)]
    closed, curve, _ = pe.shared_account(rows, pe.SharedCash(cash=1000, fee=0.0, lot=0.001, risk=0.01, cap=0.05))
    assert [x[2] for x in curve] == [0, 2, 3] and closed == []


def test_grid_by_hand():
    rules = la.Grid(levels=4, maker=0.0, taker=0.0, least_step=0.1)
    levels, gaps = la.ladder(100.0, 1e-9, 1.0, rules)
    assert levels == pytest.approx(100 * np.exp(0.1 * np.arange(-2, 3))) and gaps == pytest.approx(0.5 / levels[:-1])
    # One level down and up again earns one gap; a third bar stands still.
    low = levels[1] * 0.999
    e, n = la.grid_equity(np.array([100.0, 100, 100]), np.array([100.0, 100, 100]), np.array([100.0, low, 100]), np.array([100.0, 100, 100]), np.full(3, 1e-9), rules)
    assert n["fills"] == 2 and e[-1] == pytest.approx(1 + gaps[1] * (levels[2] - levels[1]))
    # Far below the range everything is sold and a new grid begins.
    e, n = la.grid_equity(np.array([100.0, 60]), np.array([100.0, 60]), np.array([100.0, 60]), np.array([100.0, 60]), np.full(2, 1e-9), rules)
    assert n["resets"] == 1 and e[-1] == pytest.approx(1 + sum(g * (60 - p) for g, p in zip(gaps[:2], levels[:2])))


def test_averaging_by_hand():
    rules = la.Averaging(orders=2, first=0.1, spread=1.0, growth=1.0, profit=0.05, maker=0.0, taker=0.0)
    third = 1 / 3
    # Base at 100, one order at 90: the average is 94.7..., profit five percent above it.
    units = third / 100 + third / 90
    target = 2 * third / units * 1.05
    e, n = la.averaging_equity(np.array([100.0, 90]), np.array([100.0, 120]), np.array([89.0, 90]), np.array([90.0, 110]), rules)
    assert n == {"cycles": 1, "profits": 1, "stops": 0, "fees": 0.0} and e[-1] == pytest.approx(1 - 2 * third + units * target)
    short = la.averaging_equity(np.array([100.0, 100]), np.array([100.0, 100]), np.array([100.0, 90]), np.array([100.0, 90]), la.Averaging(side=-1, orders=2, profit=0.05, maker=0.0, taker=0.0))
    assert short[1]["profits"] == 1 and short[0][-1] > 1
    stopped = la.averaging_equity(np.array([100.0, 100]), np.array([100.0, 100]), np.array([100.0, 50]), np.array([100.0, 50]), la.Averaging(orders=2, first=0.1, spread=1.0, growth=1.0, stop=0.05, maker=0.0, taker=0.0))
    assert stopped[1]["stops"] == 1 and stopped[0][-1] < 1
