"""Every band strategy as a registered query: the same setup gives the plan and the SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.functions import gates as gt
from barline.functions import stats as st
from barline.operators import chunks as ck
from barline.operators import clusters as cl
from barline.operators import config_grid as cg
from barline.operators import strategies as so
from barline.operators.lineage import cut
from barline.operators.strategies import Setup
from barline.plans.feature_queries import SMA, STD, W
from barline.plans.ledger import trial_stats
from barline.registry import Registry
from barline.sources import market as m

R = Registry()
LAG = "OVER (PARTITION BY symbol ORDER BY ts)"

#: One row a strategy folder of the catalogue, then the exits and limits on open positions.
SETUPS = (
    Setup("long_rsi", window=10, deviations=1.0, rsi_window=7, rsi_level=55.0),
    Setup("short_rsi", -1, window=10, deviations=1.0, rsi_window=7, rsi_level=45.0),
    Setup("long_atr_ratio", window=10, deviations=1.0, ratio_of="atr", ratio_most=1.0),
    Setup("long_band_ratio", window=10, deviations=1.0, ratio_of="band", ratio_most=1.5),
    Setup("short_atr_ratio", -1, window=10, deviations=1.0, ratio_of="atr", ratio_most=1.0),
    Setup("short_band_ratio", -1, window=10, deviations=1.0, ratio_of="band", ratio_most=1.5),
    Setup("long_regime", window=10, deviations=1.0, rsi_window=7, trend_window=50),
    Setup("short_regime", -1, window=10, deviations=1.0, rsi_window=7, trend_window=50),
    Setup("long_volume", window=10, deviations=1.0, rsi_window=7, volume_window=20, volume_multiple=1.1),
    Setup("long_meanrev", mode="returning", window=10, deviations=1.0, rsi_window=7, rsi_level=50.0, take_profit=1.0),
    Setup("long_pullback", mode="returning", window=10, deviations=1.0, trend_window=30),
    Setup("long_fade", mode="leaving", window=10, deviations=1.0, rsi_window=7, rsi_level=50.0, take_profit=-1.0),
    Setup("long_fade_v2", mode="returning", window=10, deviations=1.0, rsi_window=7, rsi_level=55.0, take_profit=-1.0, width_most=1.2, hold=12),
    Setup("short_fade", -1, "leaving", window=10, deviations=1.0, rsi_window=7, rsi_level=50.0, take_profit=-1.0),
    Setup("long_trend", window=30, deviations=1.0, rsi_window=5, rsi_level=55.0, take_profit=0.0),
    Setup("long_trend_v2", window=30, deviations=1.0, rsi_window=5, take_profit=0.0, width_most=1.1, hold=30),
    Setup("short_trend", -1, window=30, deviations=1.0, rsi_window=5, rsi_level=45.0, take_profit=0.0),
    Setup("short_volfilter", -1, window=10, deviations=1.0, vol_most=1.1),
    Setup("long_volfilter_trail", window=10, deviations=1.0, vol_most=1.1, trail=1.0),
    Setup("exit_rsi", window=10, deviations=1.0, rsi_window=7, exit_rule="rsi", exit_level=40.0, take_profit=0.0),
    Setup("exit_donchian", window=10, deviations=1.0, exit_rule="donchian", exit_level=5.0, take_profit=0.0),
    Setup("exit_chandelier", window=10, deviations=1.0, exit_rule="chandelier", exit_level=1.0, take_profit=0.0),
    Setup("exit_pctb", window=10, deviations=1.0, exit_rule="pctb", exit_level=0.3, take_profit=0.0),
    Setup("exit_trailing", window=10, deviations=1.0, trail=0.5, take_profit=3.0),
    Setup("single_position", window=10, deviations=1.0, most_open=1),
    Setup("three_positions", window=10, deviations=1.0, rsi_window=7, most_open=3),
)


def _fold(values: str, alpha: float, seed: str) -> str:
    return f"list_reduce({values}, lambda v, x: v + {alpha} * (x - v), {seed})"


def _smoothed(values: str, n: int) -> str:
    return f"CASE WHEN len({values}) >= {n} THEN {_fold(f'{values}[{n + 1}:]', 1 / n, f'list_reduce({values}[1:{n}], lambda v, x: v + x, 0.0) / {n}')} END"


def _median_ratio(x: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER {W(n)} >= {n // 3} THEN {x} / NULLIF(quantile_cont({x}, 0.5) OVER {W(n)}, 0) END"


def _band(x: str, n: int) -> str:
    return f"CASE WHEN ({SMA(x, n)}) > 0 AND ({STD(x, n)}) > 0 THEN 4 * ({STD(x, n)}) / (({SMA(x, n)}) * sqrt({float(n)})) END"


def setup_sql(s: Setup, every: bool = False) -> str:
    """The trades of a setup, before any limit on open positions, as relation ``trades``; features in steps. ``every``: of each bar, with ``real`` for the setup's own."""
    steps = [f"""b0 AS (SELECT *, row_number() {LAG} - 1 AS bar_ix, ({SMA('close', s.window)}) + {s.deviations} * ({STD('close', s.window)}) AS upper, ({SMA('close', s.window)}) + {-s.deviations} * ({STD('close', s.window)}) AS lower, lag(close) {LAG} AS before,
  greatest(high - low, abs(high - lag(close) {LAG}), abs(low - lag(close) {LAG})) AS range, close - lag(close) {LAG} AS move, list(close) OVER {W(so.LOOKBACK)} AS closes FROM bars)"""]

    def step(columns: str) -> None:
        steps.append(f"b{len(steps)} AS (SELECT *, {columns} FROM b{len(steps) - 1})")

    step(f"max(bar_ix) OVER (PARTITION BY symbol) AS last_ix, list(range) OVER {W(so.LOOKBACK)} AS ranges, [closes[i + 1] - closes[i] for i in range(1, len(closes))] AS moves")
    keep, hit = [], []
    c, up, low, side = "close", "upper", "lower", s.side
    if s.mode == "breakout":
        hit.append(f"before < {up} AND {c} > {up}" if side > 0 else f"before > {low} AND {c} < {low}")
    else:
        band = low if side > 0 else up
        falls, rises = f"before > {band} AND {c} < {band}", f"before < {band} AND {c} > {band}"
        hit.append((falls if side > 0 else rises) if s.mode == "leaving" else (rises if side > 0 else falls))
    if s.rsi_window:
        a = 1 / s.rsi_window
        step(f"{_fold('[greatest(x, 0.0) for x in moves]', a, '0.0')} AS gain, {_fold('[greatest(-x, 0.0) for x in moves]', a, '0.0')} AS loss")
        step(f"CASE WHEN len(moves) >= {s.rsi_window - 1} THEN CASE WHEN loss = 0 THEN 100.0 ELSE 100 - 100 / (1 + gain / loss) END END AS rsi")
        hit.append(f"rsi {'>' if (side > 0) == (s.mode == 'breakout') else '<'} {s.rsi_level}")
        keep.append("rsi")
    if s.trend_window:
        step(f"{SMA('close', s.trend_window)} AS trend")
        hit.append(f"{side} * (close - trend) > 0")
    if s.volume_window:
        step(f"{SMA('volume', s.volume_window)} AS volume_mean")
        step(f"lag(volume_mean) {LAG} AS usual_volume")
        hit.append(f"volume > {s.volume_multiple} * usual_volume")
    if s.ratio_of:
        fast, slow = (_smoothed("ranges", n) if s.ratio_of == "atr" else _band("close", n) for n in (s.ratio_fast, s.ratio_slow))
        step(f"{fast} AS fast, {slow} AS slow")
        step("CASE WHEN slow > 0 THEN fast / slow END AS ratio_now")
        step(f"lag(ratio_now) {LAG} AS ratio")
        hit.append(f"ratio < {s.ratio_most}")
    if s.width_most is not None:
        step("upper - lower AS width")
        step(f"{_median_ratio('width', s.median_window)} AS width_ratio")
        hit.append(f"width_ratio <= {s.width_most}")
    if s.vol_most is not None:
        step(f"{STD('move', s.window)} AS vol")
        step(f"{_median_ratio('vol', s.median_window)} AS vol_ratio")
        hit.append(f"vol_ratio < {s.vol_most}")
    if s.exit_rule == "donchian":
        n = int(s.exit_level)
        frame = f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
        step(f"CASE WHEN count(low) OVER {frame} = {n} THEN min(low) OVER {frame} END AS channel")
        keep.append("channel")
    if s.exit_rule == "chandelier":
        step(f"{_smoothed('ranges', 20)} AS atr")
        keep.append("atr")
    base = ("close - lower" if side > 0 else "upper - close") if s.mode == "breakout" else "upper - lower"
    target = "middle" if s.take_profit < 0 else f"entry_price + {side * s.take_profit} * risk" if s.take_profit > 0 else "NULL::DOUBLE"
    stop_now = f"CASE WHEN best_before IS NULL THEN stop ELSE greatest(stop, greatest(entry_price, best_before) - {s.trail} * risk) END" if s.trail else "stop"
    stopped = "low <= stop_now" if side > 0 else "high > stop_now"
    reached = "false" if s.take_profit == 0 else "high >= target" if side > 0 else "low < target"
    leaves = {None: "false", "rsi": f"rsi < {s.exit_level}", "donchian": "close < channel", "chandelier": f"close < best - {s.exit_level} * atr", "pctb": f"upper_now - lower_now > 0 AND (close - lower_now) / NULLIF(upper_now - lower_now, 0) < {s.exit_level}"}[s.exit_rule]
    market = f"{side} * (close - entry_price) / risk"
    gross = f"CASE outcome WHEN 'stop' THEN -1.0 WHEN 'trail' THEN {side} * (stop_now - entry_price) / risk WHEN 'target' THEN {f'{side} * (target - entry_price) / risk' if s.take_profit < 0 else float(s.take_profit)} ELSE {market} END"
    f = f"b{len(steps) - 1}"
    return f"""WITH RECURSIVE {m.DAILY_SQL}, {', '.join(steps)},
c0 AS (SELECT symbol, bar_ix AS entry_ix, close AS entry_price, ({base}) * {s.stop_multiple} AS risk, (upper + lower) / 2 AS middle, last_ix, coalesce({' AND '.join(hit)}, false) AS real FROM {f} WHERE bar_ix < last_ix{'' if every else ' AND real'}),
c1 AS (SELECT *, entry_price - {side} * risk AS stop, {target} AS target FROM c0 WHERE entry_price > 0 AND risk > 0 AND {so.ENTRY_FEE} * entry_price <= {so.MOST_FEE} * risk),
c2 AS (SELECT * FROM c1{f' WHERE {side} * (target - entry_price) > 0' if s.take_profit < 0 else ''}),
p0 AS (SELECT c.*, f.bar_ix AS now_ix, f.high, f.low, f.close, f.upper AS upper_now, f.lower AS lower_now{''.join(f', f.{k}' for k in keep)} FROM c2 c JOIN {f} f ON f.symbol = c.symbol AND f.bar_ix > c.entry_ix AND f.bar_ix <= c.entry_ix + {s.hold}),
p1 AS (SELECT *, max(high) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before, greatest(entry_price, max(high) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS best FROM p0 WINDOW w AS (PARTITION BY symbol, entry_ix ORDER BY now_ix)),
p2 AS (SELECT *, {stop_now} AS stop_now FROM p1),
p3 AS (SELECT *, CASE WHEN now_ix - entry_ix >= {s.hold} THEN 'timeout' WHEN {stopped} THEN CASE WHEN stop_now = stop THEN 'stop' ELSE 'trail' END WHEN {reached} THEN 'target' WHEN now_ix = last_ix THEN 'end' WHEN coalesce({leaves}, false) THEN 'exit_{s.exit_rule}' END AS outcome FROM p2),
x AS (SELECT * FROM p3 WHERE outcome IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol, entry_ix ORDER BY now_ix) = 1),
g AS (SELECT *, {gross} AS gross_r, {so.ENTRY_FEE} * entry_price / risk + {so.HOLDING_FEE} * ((now_ix - entry_ix) / {s.fee_bars}) * entry_price / risk AS fees FROM x),
trades AS (SELECT symbol, entry_ix, entry_price, risk, now_ix AS exit_ix, outcome, gross_r, gross_r - fees AS net_r{', real' if every else ''} FROM g)"""


def limited_sql(s: Setup) -> str:
    """``trades`` in order of entry, with the exits of those open carried from one to the next."""
    return setup_sql(s) + f""", n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY entry_ix) AS k FROM trades),
go AS (SELECT symbol, k, true AS ok, [exit_ix] AS held FROM n WHERE k = 1
 UNION ALL SELECT n.symbol, n.k, len(list_filter(go.held, lambda x: x >= n.entry_ix)) < {s.most_open}, CASE WHEN len(list_filter(go.held, lambda x: x >= n.entry_ix)) < {s.most_open} THEN list_append(list_filter(go.held, lambda x: x >= n.entry_ix), n.exit_ix) ELSE list_filter(go.held, lambda x: x >= n.entry_ix) END
 FROM go JOIN n ON n.symbol = go.symbol AND n.k = go.k + 1)
SELECT symbol, entry_ix, entry_price, risk, exit_ix, outcome, gross_r, net_r FROM n JOIN go USING (symbol, k) WHERE ok"""


def _register(s: Setup) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return so.trades_of(m.daily_bars(spark, sf), s)

    run.__name__ = f"strategy_{s.name}"
    run.__doc__ = f"Trades of the setup {s.name}."
    R.query(limited_sql(s) if s.most_open else setup_sql(s) + " SELECT * FROM trades")(run)


for _setup in SETUPS:
    _register(_setup)


#: The grid whose totals are reported: each setup is a row.
GRID = tuple(Setup(f"{mode}_{w}", side, mode, w, 1.0, take_profit=2.0) for mode in ("breakout", "returning") for side in (1, -1) for w in (10, 20))


def _grid_sql() -> str:
    # Each setup is a statement of its own with the same relation names; a union of their sub-queries.
    return " UNION ALL ".join(f"SELECT {i}::BIGINT AS config_id, * FROM ({setup_sql(s)} SELECT outcome, count(*) AS n_trades, sum(exit_ix - entry_ix)::BIGINT AS bars_held, max(gross_r) AS best, min(gross_r) AS worst FROM trades GROUP BY outcome)" for i, s in enumerate(GRID))


@R.query(_grid_sql())
def strategy_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Outcomes of a grid of setups over both sides and modes: configurations are rows, the bars are read once."""
    return cg.totals(cg.trades(m.daily_bars(spark, sf), GRID))


#: Two hundred configurations; a level of an index is a knob that may be off.
CONFIGS = tuple(
    Setup(f"{mode}_{side}_{w}_{tp}_{rsi}", side, mode, w, 1.0, rsi_window=rsi, rsi_level=50.0, take_profit=tp)
    for mode in ("breakout", "returning") for side in (1, -1) for w in (10, 15, 20, 30, 40) for tp in (1.0, 1.5, 2.0, 3.0, 4.0) for rsi in (None, 7)
)


def _configs_sql() -> str:
    """Configurations as a relation, joined with the bars by their band; then with the bars of their holding time."""
    rows = ", ".join(f"({i}, {s.side}, '{s.mode}', {s.window}, {s.take_profit}, {'true' if s.rsi_window else 'false'})" for i, s in enumerate(CONFIGS))
    windows = sorted({s.window for s in CONFIGS})
    bands = ", ".join(f"({SMA('close', w)}) + 1.0 * ({STD('close', w)}) AS up{w}, ({SMA('close', w)}) + -1.0 * ({STD('close', w)}) AS low{w}" for w in windows)
    per_band = " UNION ALL ".join(f"SELECT symbol, bar_ix, last_ix, close, before, rsi, {w} AS w, up{w} AS upper, low{w} AS lower FROM b3" for w in windows)
    a = 1 / 7
    return f"""WITH {m.WIDE_SQL}, g(config_id, side, mode, w, tp, has_rsi) AS (VALUES {rows}),
b0 AS (SELECT *, row_number() {LAG} - 1 AS bar_ix, lag(close) {LAG} AS before, list(close) OVER {W(so.LOOKBACK)} AS closes, {bands} FROM bars),
b1 AS (SELECT *, max(bar_ix) OVER (PARTITION BY symbol) AS last_ix, [closes[i + 1] - closes[i] for i in range(1, len(closes))] AS moves FROM b0),
b2 AS (SELECT *, {_fold('[greatest(x, 0.0) for x in moves]', a, '0.0')} AS gain, {_fold('[greatest(-x, 0.0) for x in moves]', a, '0.0')} AS loss FROM b1),
b3 AS MATERIALIZED (SELECT *, CASE WHEN len(moves) >= 6 THEN CASE WHEN loss = 0 THEN 100.0 ELSE 100 - 100 / (1 + gain / loss) END END AS rsi FROM b2),
f AS ({per_band}),
s AS (SELECT g.*, f.symbol, f.bar_ix AS entry_ix, f.close AS entry_price, f.last_ix, CASE WHEN mode <> 'breakout' THEN upper - lower WHEN side > 0 THEN close - lower ELSE upper - close END AS risk FROM f JOIN g USING (w) WHERE f.bar_ix < f.last_ix
 AND CASE WHEN mode = 'breakout' AND side > 0 THEN before < upper AND close > upper WHEN mode = 'breakout' THEN before > lower AND close < lower WHEN side > 0 THEN before < lower AND close > lower ELSE before > upper AND close < upper END
 AND (NOT has_rsi OR coalesce(CASE WHEN (side > 0) = (mode = 'breakout') THEN rsi > 50.0 ELSE rsi < 50.0 END, false))),
c AS (SELECT *, entry_price - side * risk AS stop, entry_price + side * tp * risk AS target FROM s WHERE entry_price > 0 AND risk > 0 AND {so.ENTRY_FEE} * entry_price <= {so.MOST_FEE} * risk),
p AS (SELECT c.*, b.bar_ix AS now_ix, b.close, CASE WHEN b.bar_ix - entry_ix >= 20 THEN 'timeout' WHEN CASE WHEN side > 0 THEN b.low <= stop ELSE b.high > stop END THEN 'stop' WHEN CASE WHEN side > 0 THEN b.high >= target ELSE b.low < target END THEN 'target' WHEN b.bar_ix = c.last_ix THEN 'end' END AS outcome
 FROM c JOIN b3 b ON b.symbol = c.symbol AND b.bar_ix > c.entry_ix AND b.bar_ix <= c.entry_ix + 20),
x AS (SELECT config_id, symbol, entry_ix, arg_min({{'now_ix': now_ix, 'outcome': outcome, 'r': CASE outcome WHEN 'stop' THEN -1.0 WHEN 'target' THEN tp::DOUBLE ELSE side * (close - entry_price) / risk END}}, now_ix) AS e FROM p WHERE outcome IS NOT NULL GROUP BY config_id, symbol, entry_ix)
SELECT config_id::BIGINT AS config_id, e.outcome AS outcome, count(*) AS n_trades, sum(e.now_ix - entry_ix)::BIGINT AS bars_held, max(e.r) AS best, min(e.r) AS worst FROM x GROUP BY config_id, e.outcome"""


@R.query(_configs_sql())
def strategy_configs(spark: SparkSession, sf: str) -> DataFrame:
    """Outcomes of two hundred configurations over 42 symbols in one plan with one scan."""
    return cg.totals(cg.trades(m.wide_bars(spark, sf), CONFIGS))


_RANDOM = Setup("random", window=10, deviations=1.0)
_RUNS = 20


@R.query(setup_sql(_RANDOM, every=True) + f""", r AS (SELECT symbol, count(*) FILTER (real) AS n_trades, avg(net_r) FILTER (real) AS mean_r, count(*) FILTER (real) / count(*) AS p FROM trades GROUP BY symbol),
d AS (SELECT t.symbol, t.net_r, k.run, ('0x' || substr(md5('entries:' || k.run || ':' || t.symbol || ':' || t.entry_ix), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS draw, r.p FROM trades t JOIN r USING (symbol), (SELECT unnest(range(1, {_RUNS + 1})) AS run) k),
n AS (SELECT symbol, run, avg(net_r) AS null_r FROM d WHERE draw < p GROUP BY symbol, run)
SELECT r.symbol, r.n_trades, r.mean_r, count(*) AS n_runs, avg(null_r) AS null_mean, count(*) FILTER (null_r < r.mean_r) / count(*) AS percentile FROM n JOIN r USING (symbol) GROUP BY r.symbol, r.n_trades, r.mean_r""")
def random_entry_nulls(spark: SparkSession, sf: str) -> DataFrame:
    """A setup against random entries of its own frequency, risk, exits and fees, by symbol."""
    return so.random_entries(m.daily_bars(spark, sf), _RANDOM, _RUNS)


_A_YEAR = 252
#: Trials of one campaign: long setups whose two take profits are one effective trial.
_TRIALS = tuple(Setup(f"{mode}_{w}_{tp}", 1, mode, w, 1.0, take_profit=tp) for mode in ("breakout", "leaving", "returning") for w in (10, 20, 30) for tp in (1.5, 3.0))
_Z = lambda b: f"(sharpe - {b}) * sqrt(n - 1.0) / sqrt(1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe * sharpe)"


def _gates_sql() -> str:
    every = " UNION ALL ".join(f"SELECT {i}::BIGINT AS config_id, * FROM ({setup_sql(s)} SELECT entry_ix, exit_ix, net_r FROM trades)" for i, s in enumerate(_TRIALS))
    return f"""t AS MATERIALIZED ({every}),
a AS (SELECT config_id, count(*) AS n, avg(net_r) AS mean, avg(exit_ix - entry_ix) AS avg_holding FROM t GROUP BY config_id),
p AS (SELECT config_id, any_value(n) AS n, any_value(mean) AS mean, any_value(avg_holding) AS avg_holding, avg((net_r - mean) ** 2) AS m2, avg((net_r - mean) ** 3) AS m3, avg((net_r - mean) ** 4) AS m4 FROM t JOIN a USING (config_id) GROUP BY config_id),
q AS (SELECT config_id, n, avg_holding, mean / sqrt(m2) AS sharpe, m3 / m2 ** 1.5 * sqrt(n * (n - 1.0)) / (n - 2) AS skew, (n - 1.0) / ((n - 2.0) * (n - 3.0)) * ((n + 1.0) * (m4 / (m2 * m2) - 3) + 6) + 3 AS kurtosis FROM p),
s AS (SELECT count(*) AS n_raw, count(DISTINCT config_id // 2) AS n_eff, greatest(avg(sharpe * sharpe * {_A_YEAR}) - avg(sharpe * sqrt({_A_YEAR}.0)) ** 2, 0.0) / {_A_YEAR} AS var_sr FROM q),
b AS MATERIALIZED (SELECT *, sqrt(var_sr) * ({gt.expected_max_sql('n_eff')}) AS benchmark_n_eff, sqrt(var_sr) * ({gt.expected_max_sql('n_raw')}) AS benchmark_n_raw, {gt.expected_max_sql('(n_eff + 1)')} AS luck FROM s),
z AS (SELECT q.*, b.*, {_Z('benchmark_n_eff')} AS z_eff, {_Z('benchmark_n_raw')} AS z_raw FROM q, b),
d AS MATERIALIZED (SELECT *, {st.normal_cdf_sql('z_eff')} AS dsr_n_eff, {st.normal_cdf_sql('z_raw')} AS dsr_n_raw FROM z)"""


def _of_trials(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Trades of the grid, moments of each configuration's trades, and the trials' counts: configurations that differ in their take profit alone are one effective trial."""
    done = cut(cg.trades(m.daily_bars(spark, sf), _TRIALS).select("config_id", "entry_ix", "exit_ix", "net_r"))
    moments = st.sharpe_moments(done, ["config_id"], "net_r")
    trials = moments.select(F.lit(1).alias("campaign_id"), F.col("config_id").alias("trial_id"), (F.col("sharpe") * F.sqrt(F.lit(float(_A_YEAR)))).alias("score"))
    grouped = trials.select(F.lit(1).alias("run"), "trial_id", F.floor(F.col("trial_id") / 2).alias("cluster"))
    return done, moments, trial_stats(trials, grouped)


@R.query(f"WITH {_gates_sql()} SELECT config_id, n, sharpe, n_eff, n_raw, var_sr, benchmark_n_eff, benchmark_n_raw, dsr_n_eff, dsr_n_raw FROM d")
def deflated_by_trials(spark: SparkSession, sf: str) -> DataFrame:
    """Each configuration's ratio deflated by effective and by raw trials, side by side."""
    _, moments, counts = _of_trials(spark, sf)
    return gt.deflated(moments, counts, 0, _A_YEAR).select("config_id", "n", "sharpe", "n_eff", "n_raw", "var_sr", "benchmark_n_eff", "benchmark_n_raw", "dsr_n_eff", "dsr_n_raw")


_F = lambda x, k: f"printf('%.{k}f', {x})"


@R.query(f"""WITH {m.DAILY_SQL}, y AS (SELECT min(days) / 365.25 AS years FROM (SELECT date_diff('day', min(ts), max(ts)) AS days FROM bars GROUP BY symbol)), {_gates_sql()},
g AS (SELECT d.*, y.years, (luck / 1.5) ** 2 AS need FROM d, y)
SELECT config_id, 'g2_minbtl' AS gate, years AS value, years >= need AS passed, 'IS ' || {_F('years', 2)} || ' y vs MinBTL ' || {_F('need', 2)} || ' y (N=' || (n_eff + 1) || ', target Sharpe 1.5)' AS reason FROM g
UNION ALL SELECT config_id, 'g3_is', sharpe, n >= 500 AND avg_holding >= 3, CASE WHEN n >= 500 AND avg_holding >= 3 THEN 'IS Sharpe ' || {_F('sharpe', 2)} || ', ' || n || ' trades' ELSE concat_ws('; ', CASE WHEN n < 500 THEN n || ' trades < min_trades 500' END, CASE WHEN avg_holding < 3 THEN 'average holding ' || {_F('avg_holding', 2)} || ' bars < min_holding_bars 3' END) END FROM g
UNION ALL SELECT config_id, 'g5_dsr', dsr_n_eff, dsr_n_eff >= 0.95, 'DSR ' || {_F('dsr_n_eff', 3)} || ' (N_eff=' || n_eff || '), ' || {_F('dsr_n_raw', 3)} || ' (N_raw=' || n_raw || ') vs 0.95' FROM g""")
def gate_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts of the gates on length, in-sample limits and deflated ratio, with their reasons."""
    done, moments, counts = _of_trials(spark, sf)
    spans = m.daily_bars(spark, sf).groupBy("symbol").agg(F.datediff(F.max("ts"), F.min("ts")).alias("days")).agg((F.min("days") / 365.25).alias("years"))
    held = done.groupBy("config_id").agg(F.count("*").alias("n_trades"), F.avg(F.col("exit_ix") - F.col("entry_ix")).alias("avg_holding"))
    d = cut(gt.deflated(moments, counts, 0, _A_YEAR).join(held, "config_id").crossJoin(F.broadcast(spans)))  # one row
    parts = [gt.min_length_gate(d, F.col("years"), F.col("n_eff"), 1.5), gt.in_sample_gate(d, 500, 3), gt.deflated_gate(d, 0.95)]
    out = [p.select("config_id", "gate", "value", "passed", "reason") for p in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


@R.query()
def trial_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters of the trials by their monthly results, after the guard (iterated: no SQL; tests hold it against numpy)."""
    bars = m.daily_bars(spark, sf)
    at = ck.numbered(bars.select("symbol", "ts")).select("symbol", F.col("row_ix").alias("exit_ix"), F.date_trunc("month", "ts").alias("month"))
    monthly = cg.trades(bars, _TRIALS).join(at, ["symbol", "exit_ix"]).groupBy("config_id", "month").agg(F.sum("net_r").alias("r"))
    monthly = cut(monthly)
    pairs = st.pairwise_correlation(monthly, "config_id", "month", "r", 12)
    return cl.clusters(monthly.select(F.col("config_id").alias("series")), pairs).select(F.col("series").alias("config_id"), "cluster")
