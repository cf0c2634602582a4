"""Many configurations of band strategies in one plan over one scan of the bars.

Configurations are rows. Features are computed once for each distinct operator and
period and stand in arrays that a configuration's knobs index (NULL: the knob is off).
An entry is a conjunction of conditions, of which many configurations share each: a
bar's entries are bit sets over configurations, 64 a word, from which each condition that does
not hold takes out the configurations that ask for it. No bar meets a configuration that
doesn't fire on it. What fires is joined with its configuration's row, and folds the bars of its holding
time, which each bar holds once for all configurations.

Bars are cut into blocks with halos on both sides, so a symbol's history is spread over tasks.
Rules of exits and fees are those of :mod:`barline.operators.strategies`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.functions import features as ft
from barline.operators import chunks as ck
from barline.operators.strategies import ENTRY_FEE, HOLDING_FEE, LOOKBACK, MOST_FEE, Setup, median_ratio

#: Configurations of a grid, at most, and rows of a block.
MOST_CONFIGS, BLOCK = 4096, 1024
CHANDELIER_BARS = 20
EXITS = ("rsi", "donchian", "chandelier", "pctb")

Key = tuple


@dataclass(frozen=True)
class Features:
    """Distinct features of a grid: bands by (window, deviations), and others by name and periods."""

    bands: tuple[Key, ...]
    others: tuple[Key, ...]

    @staticmethod
    def of(setups: Sequence[Setup]) -> Features:
        others = set()
        for s in setups:
            if s.rsi_window:
                others.add(("rsi", s.rsi_window))
            if s.trend_window:
                others.add(("trend", s.trend_window))
            if s.volume_window:
                others.add(("volume", s.volume_window))
            if s.ratio_of:
                others.add(("ratio", s.ratio_of, s.ratio_fast, s.ratio_slow))
            if s.width_most is not None:
                others.add(("width", s.window, s.deviations, s.median_window))
            if s.vol_most is not None:
                others.add(("vol", s.window, s.median_window))
            if s.exit_rule == "donchian":
                others.add(("channel", int(s.exit_level)))
            if s.exit_rule == "chandelier":
                others.add(("atr", CHANDELIER_BARS))
        return Features(tuple(sorted({(s.window, s.deviations) for s in setups})), tuple(sorted(others, key=str)))

    def lookback(self) -> int:
        """Rows that any of the features looks back on, at most."""
        periods = [w for w, _ in self.bands] + [p for k in self.others for p in k[1:] if isinstance(p, int)]
        return LOOKBACK + 2 + 2 * max(periods, default=0)

    def band(self, s: Setup) -> int:
        return self.bands.index((s.window, s.deviations))

    def name(self, *key) -> str:
        return f"f{self.others.index(key)}"

    def columns(self, cut: DataFrame) -> DataFrame:
        """Rows with up0, low0, ... of the bands and f0, ... of the other features."""
        c = F.col("close")
        kinds = {k[0] for k in self.others}
        d = cut.withColumns({"before": ft.ago(c, 1), "range": ft.true_range()} | {f"{side}{i}": ft.bollinger(c, w, dev, side == "up") for i, (w, dev) in enumerate(self.bands) for side in ("up", "low")})
        first, then, last = {"move": c - F.col("before")}, {}, {}
        if "rsi" in kinds:
            first["closes"] = ft.window_array(c, LOOKBACK)
        if kinds & {"ratio", "atr"}:
            first["ranges"] = ft.window_array(F.col("range"), LOOKBACK)
        for key in self.others:
            n = self.name(*key)
            match key:
                case ("rsi", p):
                    then[n] = lambda p=p: ft.zero_seeded_rsi(F.col("closes"), p)
                case ("trend", p):
                    then[n] = lambda p=p: ft.sma(c, p)
                case ("volume", p):
                    then[f"{n}_mean"], last[n] = lambda p=p: ft.sma(F.col("volume"), p), lambda n=n: ft.ago(F.col(f"{n}_mean"), 1)
                case ("ratio", kind, fast, slow):
                    of = (lambda p: ft.atr_of(F.col("ranges"), p)) if kind == "atr" else lambda p: ft.bandwidth(c, p)
                    then[f"{n}_now"] = lambda fast=fast, slow=slow, of=of: F.when(of(slow) > 0, of(fast) / of(slow))
                    last[n] = lambda n=n: ft.ago(F.col(f"{n}_now"), 1)
                case ("width", w, dev, median):
                    i = self.bands.index((w, dev))
                    then[f"{n}_of"] = lambda i=i: F.col(f"up{i}") - F.col(f"low{i}")
                    last[n] = lambda n=n, median=median: median_ratio(F.col(f"{n}_of"), median)
                case ("vol", w, median):
                    then[f"{n}_of"] = lambda w=w: ft.std(F.col("move"), w)
                    last[n] = lambda n=n, median=median: median_ratio(F.col(f"{n}_of"), median)
                case ("channel", p):
                    then[n] = lambda p=p: ft.donchian_low(p)
                case ("atr", p):
                    then[n] = lambda p=p: ft.atr_of(F.col("ranges"), p)
        for step in (first, {k: f() for k, f in then.items()}, {k: f() for k, f in last.items()}):
            d = d.withColumns(step) if step else d
        return d


def conditions(s: Setup, have: Features) -> dict[Key, Callable[[], Column]]:
    """The conditions of a setup's entry, under keys that equal conditions of other setups share; each gives its column when called."""
    c, before, i = F.col("close"), F.col("before"), have.band(s)
    up, low = (lambda: F.col(f"up{i}")), (lambda: F.col(f"low{i}"))
    other = lambda *key: F.col(have.name(*key))
    if s.mode == "breakout":
        out = {("breakout", s.side, i): lambda: (before < up()) & (c > up()) if s.side > 0 else (before > low()) & (c < low())}
    else:
        band = low if s.side > 0 else up
        falling = (s.side > 0) == (s.mode == "leaving")
        out = {("through", s.side, falling, i): lambda: (before > band()) & (c < band()) if falling else (before < band()) & (c > band())}
    if s.rsi_window:
        above = (s.side > 0) == (s.mode == "breakout")
        out["rsi", s.rsi_window, above, s.rsi_level] = lambda: other("rsi", s.rsi_window) > s.rsi_level if above else other("rsi", s.rsi_window) < s.rsi_level
    if s.trend_window:
        out["trend", s.trend_window, s.side] = lambda: s.side * (c - other("trend", s.trend_window)) > 0
    if s.volume_window:
        out["volume", s.volume_window, s.volume_multiple] = lambda: F.col("volume") > s.volume_multiple * other("volume", s.volume_window)
    if s.ratio_of:
        ratio = ("ratio", s.ratio_of, s.ratio_fast, s.ratio_slow)
        out[*ratio, s.ratio_most] = lambda: other(*ratio) < s.ratio_most
    if s.width_most is not None:
        width = ("width", s.window, s.deviations, s.median_window)
        out[*width, s.width_most] = lambda: other(*width) <= s.width_most
    if s.vol_most is not None:
        vol = ("vol", s.window, s.median_window)
        out[*vol, s.vol_most] = lambda: other(*vol) < s.vol_most
    return out


def signed(word: int) -> int:
    return word - (1 << 64) if word >> 63 else word


def entry_words(setups: Sequence[Setup], have: Features) -> list[Column]:
    """Bit sets of the configurations that enter on a row, 64 a word (a signed long).

    A condition that is false or NULL takes out the configurations that ask for it.
    """
    asked: dict[Key, list] = {}
    for i, s in enumerate(setups):
        for key, column in conditions(s, have).items():
            if key not in asked:
                asked[key] = [column(), 0]
            asked[key][1] |= 1 << i
    words = []
    for w in range(-(-len(setups) // 64)):
        every = (1 << min(64, len(setups) - 64 * w)) - 1
        out = [F.when(column, 0).otherwise(F.lit(signed(mask)).cast("bigint")) for column, bits in asked.values() if (mask := bits >> (64 * w) & ((1 << 64) - 1))]
        words.append(F.lit(signed(every)).cast("bigint").bitwiseAND(F.bitwise_not(reduce(Column.bitwiseOR, out))))
    return words


_CONFIG = "config_id bigint, side int, band int, rsi int, channel int, atr int, stop_multiple double, breakout boolean, take_profit double, hold int, trail double, exit_rule string, exit_level double, most_open int, fee_bars int"


def configurations(spark: SparkSession, setups: Sequence[Setup], have: Features) -> DataFrame:
    """One row a configuration; ``band``, ``rsi``, ``channel`` and ``atr`` are places in the arrays of features (NULL: off)."""
    place = lambda *key: have.others.index(key)
    rows = [
        (i, s.side, have.band(s), place("rsi", s.rsi_window) if s.exit_rule == "rsi" else None, place("channel", int(s.exit_level)) if s.exit_rule == "donchian" else None, place("atr", CHANDELIER_BARS) if s.exit_rule == "chandelier" else None)
        + (float(s.stop_multiple), s.mode == "breakout", float(s.take_profit), s.hold, float(s.trail), s.exit_rule, float(s.exit_level), s.most_open, s.fee_bars)
        for i, s in enumerate(setups)
    ]
    return spark.createDataFrame(rows, _CONFIG)


def checked(setups: Sequence[Setup]) -> list[Setup]:
    if not 0 < len(setups) <= MOST_CONFIGS:
        raise ValueError(f"a grid has 1 to {MOST_CONFIGS} configurations")
    for s in setups:
        if s.exit_rule not in (None, *EXITS) or (s.exit_rule == "rsi" and not s.rsi_window) or s.mode not in ("breakout", "leaving", "returning") or s.side not in (1, -1) or s.hold < 1:
            raise ValueError(f"no such configuration: {s}")
        if s.trail and s.side < 0:
            raise ValueError("stops trail long positions alone")
    return list(setups)


def fired(bars: DataFrame, setups: Sequence[Setup], have: Features) -> DataFrame:
    """One row a signal: config_id, symbol, entry_ix, the bar's close, bands and n_rows, and path, the bars of the longest holding time from the next one on."""
    hold = max(s.hold for s in setups)
    cut = ck.blocks(ck.numbered(bars, total="n_rows"), have.lookback(), BLOCK, ahead=hold)
    with ft.partitioned("symbol", "block"):
        d = have.columns(cut)
        bands = F.array(*[F.struct(F.col(f"low{i}").alias("low"), F.col(f"up{i}").alias("up")) for i in range(len(have.bands))])
        # Only exits by an indicator look at later bars' features.
        others = [F.array(*[F.col(have.name(*k)) for k in have.others]).alias("f")] if any(s.exit_rule in ("rsi", "donchian", "chandelier") for s in setups) else []
        later = [bands.alias("bands")] if any(s.exit_rule == "pctb" for s in setups) else []
        at = F.struct(F.col("row_ix").alias("at"), "high", "low", "close", *later, *others)
        d = d.select("symbol", "ts", "block", "own", F.col("row_ix").alias("entry_ix"), "n_rows", "close", bands.alias("bands"), F.array(*entry_words(setups, have)).alias("words"), at.alias("at"))
        d = d.withColumn("path", F.collect_list("at").over(ft.order().rowsBetween(1, hold)))
    if any(s.trail or s.exit_rule == "chandelier" for s in setups):
        # The highest high of the path before each of its bars: the same for all configurations.
        best = lambda i: F.array_max(F.transform(F.slice("path", 1, i), lambda b: b["high"]))
        d = d.withColumn("path", F.transform("path", lambda b, i: b.withField("best_before", F.when(i > 0, best(i)))))
    d = d.where("own").where(F.exists("words", lambda w: w != 0)).where("entry_ix + 1 < n_rows")
    bits = d.select("symbol", "entry_ix", "n_rows", "close", "bands", "path", F.posexplode("words").alias("word_ix", "word")).where("word <> 0")
    on = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.call_function("getbit", F.col("word"), b) == 1)
    return bits.withColumn("bit", F.explode(on)).select((F.col("word_ix") * 64 + F.col("bit")).cast("bigint").alias("config_id"), "symbol", "entry_ix", "n_rows", "close", "bands", "path")


#: Outcomes by a number, in the order in which they are looked for.
OUTCOMES = ("timeout", "stop", "trail", "target", "end", *[f"exit_{r}" for r in EXITS])


def _outcome(rules: set[str | None]) -> Column:
    """The number of the first rule that holds on a bar ``b`` of a signal's path; NULL for none."""
    price, risk, stop, target = F.col("entry_price"), F.col("risk"), F.col("stop"), F.col("target")
    long, rule, level, close = F.col("side") > 0, F.col("exit_rule"), F.col("exit_level"), F.col("b.close")
    leaves = {}
    if "pctb" in rules:
        at = F.get("b.bands", F.col("band"))
        leaves["pctb"] = (at["up"] > at["low"]) & (F.try_divide(close - at["low"], at["up"] - at["low"]) < level)
    if "rsi" in rules:
        leaves["rsi"] = F.get("b.f", F.col("rsi")) < level
    if "donchian" in rules:
        leaves["donchian"] = close < F.get("b.f", F.col("channel"))
    if "chandelier" in rules:
        leaves["chandelier"] = close < F.greatest(price, F.col("b.best_before"), F.col("b.high")) - level * F.get("b.f", F.col("atr"))
    number = OUTCOMES.index
    out = (
        F.when(F.col("b.at") - F.col("entry_ix") >= F.col("hold"), number("timeout"))
        .when(F.when(long, F.col("b.low") <= F.col("stop_now")).otherwise(F.col("b.high") > F.col("stop_now")), F.when(F.col("stop_now") == stop, number("stop")).otherwise(number("trail")))
        .when(F.when(long, F.col("b.high") >= target).otherwise(F.col("b.low") < target), number("target"))
        .when(F.col("b.at") == F.col("n_rows") - 1, number("end"))
    )
    for name, column in leaves.items():
        out = out.when((rule == name) & column, number(f"exit_{name}"))
    return out


def trades(bars: DataFrame, setups: Sequence[Setup]) -> DataFrame:
    """config_id, symbol, entry_ix, entry_price, risk, exit_ix, outcome, gross_r, net_r of all configurations' trades.

    config_id: the configuration's place in ``setups``.
    """
    setups = checked(setups)
    have = Features.of(setups)
    configs = F.broadcast(configurations(bars.sparkSession, setups, have))  # at most MOST_CONFIGS rows
    c, risk, side, tp = F.col("entry_price"), F.col("risk"), F.col("side"), F.col("take_profit")
    low, up = F.get("bands", F.col("band"))["low"], F.get("bands", F.col("band"))["up"]
    base = F.when(F.col("breakout"), F.when(side > 0, c - low).otherwise(up - c)).otherwise(up - low)
    d = fired(bars, setups, have).withColumnRenamed("close", "entry_price").join(configs, "config_id").withColumns({"risk": base * F.col("stop_multiple"), "middle": (up + low) / 2})
    d = d.where((c > 0) & (risk > 0) & (ENTRY_FEE * c <= MOST_FEE * risk))
    d = d.withColumns({"stop": c - side * risk, "target": F.when(tp < 0, F.col("middle")).when(tp > 0, c + side * tp * risk)}).where((tp >= 0) | (side * (F.col("target") - c) > 0))
    knobs = ["side", "band", "rsi", "channel", "atr", "hold", "trail", "exit_rule", "exit_level", "n_rows"]
    path = d.select("config_id", "symbol", "entry_ix", "entry_price", "risk", "stop", "target", *knobs, F.explode("path").alias("b"))
    before = F.col("b.best_before") if any(s.trail for s in setups) else F.lit(None).cast("double")
    moved = F.when((F.col("trail") > 0) & before.isNotNull(), F.greatest("stop", F.greatest(c, before) - F.col("trail") * risk)).otherwise(F.col("stop"))
    out = path.withColumn("stop_now", moved).withColumn("number", _outcome({s.exit_rule for s in setups})).where("number IS NOT NULL")
    at = out.withColumn("at", F.col("b.at")).withColumn("close", F.col("b.close"))
    first = at.groupBy("config_id", "symbol", "entry_ix", "entry_price", "risk", "target").agg(F.min("at").alias("exit_ix"), *[F.min_by(k, "at").alias(k) for k in ("number", "close", "stop_now")])
    done = first.join(configs.select("config_id", "side", "take_profit", "fee_bars"), "config_id").withColumn("outcome", F.get(F.array(*[F.lit(x) for x in OUTCOMES]), F.col("number")))
    price = F.when(F.col("outcome") == "trail", F.col("stop_now")).when((F.col("outcome") == "target") & (tp < 0), F.col("target")).otherwise(F.col("close"))
    gross = F.when(F.col("outcome") == "stop", -1.0).when((F.col("outcome") == "target") & (tp > 0), tp).otherwise(side * (price - c) / risk)
    fees = ENTRY_FEE * c / risk + HOLDING_FEE * ((F.col("exit_ix") - F.col("entry_ix")) / F.col("fee_bars")) * c / risk
    out = done.select("config_id", "symbol", "entry_ix", "entry_price", "risk", "exit_ix", "outcome", gross.alias("gross_r"), (gross - fees).alias("net_r"))
    return taken(out, {i: s.most_open for i, s in enumerate(setups) if s.most_open is not None})


def taken(done: DataFrame, most_open: dict[int, int]) -> DataFrame:
    """The trades that are taken where a configuration may hold so many positions of a symbol at once, in order of entry.

    A trade holds its place on its exit's bar too. Trades of a configuration and symbol stream in order; a task holds the open ones.
    """
    if not most_open:
        return done

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for k, (config, symbol, at, end) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("config_id", "symbol", "entry_ix", "exit_ix")], strict=True)):
                if (config, symbol) != group:
                    group, held = (config, symbol), []
                held = [e for e in held if e >= at]
                if len(held) < most_open[config]:
                    ok[k] = True
                    held.append(end)
            yield batch.filter(pa.array(ok))

    limited = F.col("config_id").isin(list(most_open))
    walked = done.where(limited).repartition("config_id", "symbol").sortWithinPartitions("config_id", "symbol", "entry_ix").mapInArrow(run, done.schema)
    return done.where(~limited).unionByName(walked)


def totals(done: DataFrame) -> DataFrame:
    """config_id, outcome, n_trades, bars_held, best and worst of trades."""
    return done.groupBy("config_id", "outcome").agg(F.count("*").alias("n_trades"), F.sum(F.col("exit_ix") - F.col("entry_ix")).alias("bars_held"), F.max("gross_r").alias("best"), F.min("gross_r").alias("worst"))
