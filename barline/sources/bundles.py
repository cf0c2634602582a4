"""Bundles of contracts: marks, settlements, paths inside of bars and margin tiers, checked, cut and joined as a whole, packed flat.

A bundle is a dict of the relations that :data:`barline.sources.files.BUNDLE` names. ``marks``: symbol, bar_ix, ts (a bar's close), close and
more; ``funding``: symbol, bar_ix, ts, rate, mark; ``paths`` and ``trade_paths``: symbol, bar_ix, segment_ix, start_minute, side (0 low,
1 high), minute (within the segment), price; ``brackets``: symbol, cap, max_leverage, mmr, amount. Bars are numbered from 0 in each symbol.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.sources.files import BUNDLE

#: Relations with a row for something inside of a bar.
INNER = ("funding", "paths", "trade_paths")


def problems(bundle: dict[str, DataFrame]) -> DataFrame:
    """symbol, problem: bars without a path (of trades or marks), rows outside of the bars, bars not numbered from 0, symbols without tiers."""
    marks = bundle["marks"]
    bars = marks.groupBy("symbol").agg(F.count("*").alias("n"), F.min("bar_ix").alias("low"), F.max("bar_ix").alias("high"), F.count_distinct("bar_ix").alias("k"))
    out = [
        bars.where("n != k OR low != 0 OR high != n - 1").select("symbol", F.lit("bars are not numbered from 0 without a gap").alias("problem")),
        bars.join(bundle["brackets"].select("symbol"), "symbol", "left_anti").select("symbol", F.lit("no margin tiers").alias("problem")),
    ]
    for name in INNER:
        outside = bundle[name].select("symbol", "bar_ix").distinct().join(marks.select("symbol", "bar_ix"), ["symbol", "bar_ix"], "left_anti")
        out.append(outside.select("symbol", F.lit(f"{name} outside of the bars").alias("problem")).distinct())
        if name != "funding":
            bare = marks.select("symbol", "bar_ix").join(bundle[name].select("symbol", "bar_ix"), ["symbol", "bar_ix"], "left_anti")
            out.append(bare.select("symbol", F.lit(f"bars without {name}").alias("problem")).distinct())
    first, *rest = out
    for d in rest:
        first = first.unionByName(d)
    return first


def require(bundle: dict[str, DataFrame]) -> None:
    """Raises if a bundle has :func:`problems`."""
    found = problems(bundle).limit(5).collect()
    if found:
        raise ValueError("; ".join(f"{r['symbol']}: {r['problem']}" for r in found))


def sliced(bundle: dict[str, DataFrame], spans: DataFrame) -> dict[str, DataFrame]:
    """The bars ``start`` <= bar_ix < ``stop`` of each symbol of ``spans`` (symbol, start, stop), with all that is in them, numbered anew.

    A symbol without a span is left out; tiers stay as they are.
    """
    s = spans.select("symbol", F.col("start").alias("__start"), F.col("stop").alias("__stop"))
    out = {}
    for name in BUNDLE:
        d = bundle[name].join(s, "symbol")
        if name != "brackets":
            d = d.where("bar_ix >= __start AND bar_ix < __stop").withColumn("bar_ix", F.col("bar_ix") - F.col("__start"))
        out[name] = d.select(*bundle[name].columns)
    return out


def from_time(bundle: dict[str, DataFrame], start: Column) -> dict[str, DataFrame]:
    """The part of a bundle whose bars close at ``start`` or later; symbols without such bars are left out."""
    n = F.max("bar_ix") + 1
    spans = bundle["marks"].groupBy("symbol").agg(F.min(F.when(F.col("ts") >= start, F.col("bar_ix"))).alias("start"), n.alias("stop"))
    return sliced(bundle, spans.where("start IS NOT NULL"))


def followed_by(earlier: dict[str, DataFrame], later: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Two windows of the same contracts as one: the later one's bars are numbered on from the earlier one's; tiers are the earlier one's.

    Raises if a symbol is in one only, or the later window doesn't begin strictly after the earlier one.
    """
    a = earlier["marks"].groupBy("symbol").agg(F.max("ts").alias("last"), (F.max("bar_ix") + 1).alias("__offset"))
    b = later["marks"].groupBy("symbol").agg(F.min("ts").alias("first"))
    bad = a.join(b, "symbol", "full").where("first IS NULL OR last IS NULL OR first <= last").limit(5).collect()
    if bad:
        raise ValueError("windows don't follow one another: " + ", ".join(sorted(r["symbol"] for r in bad)))
    out = {"brackets": earlier["brackets"]}
    for name in BUNDLE:
        if name != "brackets":
            moved = later[name].join(a.select("symbol", "__offset"), "symbol").withColumn("bar_ix", F.col("bar_ix") + F.col("__offset"))
            out[name] = earlier[name].unionByName(moved.select(*earlier[name].columns))
    return out


def _block(per: int) -> Column:
    return F.floor(F.col("bar_ix") / per).cast("bigint")


def _offsets(rows: Column, field: str) -> Column:
    """[0, ends...] of sorted structs; [0] for none."""
    zero = F.array(F.lit(0).cast("bigint"))
    return F.coalesce(F.concat(zero, F.transform(rows, lambda r: r[field])), zero)


def _bar_offsets(marks: DataFrame, counts: DataFrame, per: int, name: str) -> DataFrame:
    """symbol, block, ``name``: per block, where the rows of each of its bars begin and end, from counts (symbol, bar_ix, n)."""
    d = marks.select("symbol", "bar_ix").join(counts, ["symbol", "bar_ix"], "left").withColumn("block", _block(per))
    end = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("symbol", "block").orderBy("bar_ix").rowsBetween(Window.unboundedPreceding, 0))
    g = d.withColumn("end", end).groupBy("symbol", "block").agg(F.array_sort(F.collect_list(F.struct("bar_ix", "end"))).alias("rows"))
    return g.select("symbol", "block", _offsets(F.col("rows"), "end").alias(name))


def flat_paths(marks: DataFrame, points: DataFrame, per: int = 4096, prefix: str = "") -> DataFrame:
    """symbol, block and flat arrays of the paths of ``per`` bars each: a row is bounded by its bars, not by a history.

    bar_ptr: bar b of the block has the segments bar_ptr[b] to bar_ptr[b + 1] - 1; seg_start: their first minutes; low_ptr, low_ix, low_px:
    segment s has the lows low_ptr[s] to low_ptr[s + 1] - 1, by minute within the segment; high_... alike. Names get the ``prefix``.
    """
    side = lambda k: F.array_sort(F.collect_list(F.when(F.col("side") == k, F.struct("minute", "price"))))
    s = points.groupBy("symbol", "bar_ix", "segment_ix").agg(F.min("start_minute").alias("start"), side(0).alias("low"), side(1).alias("high")).withColumn("block", _block(per))
    w = Window.partitionBy("symbol", "block").orderBy("bar_ix", "segment_ix").rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumns({"low_end": F.sum(F.size("low")).over(w), "high_end": F.sum(F.size("high")).over(w)})
    g = s.groupBy("symbol", "block").agg(F.array_sort(F.collect_list(F.struct("bar_ix", "segment_ix", "start", "low_end", "high_end", "low", "high"))).alias("rows"))
    bars = _bar_offsets(marks, points.groupBy("symbol", "bar_ix").agg(F.count_distinct("segment_ix").alias("n")), per, "bar_ptr")
    rows = F.col("rows")
    flat = lambda k, f, t: F.coalesce(F.flatten(F.transform(rows, lambda r: r[k][f])), F.array().cast(f"array<{t}>"))
    columns = {"bar_ptr": F.col("bar_ptr"), "seg_start": F.coalesce(F.transform(rows, lambda r: r["start"]), F.array().cast("array<int>"))}
    for k in ("low", "high"):
        columns |= {f"{k}_ptr": _offsets(rows, f"{k}_end"), f"{k}_ix": flat(k, "minute", "int"), f"{k}_px": flat(k, "price", "double")}
    return bars.join(g, ["symbol", "block"], "left").select("symbol", "block", *[c.alias(prefix + n) for n, c in columns.items()])


def first_touch(ix: Column, px: Column, first: Column, end: Column, level: Column, above: bool) -> Column:
    """Minute within a segment at which its highs (``above``) or lows reach a level; NULL if never. ``first`` and ``end``: its place in the flat arrays."""
    reach = (lambda p: p["px"] >= level) if above else (lambda p: p["px"] <= level)
    part = F.slice(F.arrays_zip(ix.alias("ix"), px.alias("px")), first.cast("int") + 1, (end - first).cast("int"))
    return F.get(F.filter(part, reach), F.lit(0))["ix"]


def flagged(bundle: dict[str, DataFrame], step_minutes: int) -> DataFrame:
    """symbol, bar_ix, bad: bars whose paths of marks and trades don't begin their segments at the same minutes, or that settle in between."""
    starts = lambda name, to: bundle[name].groupBy("symbol", "bar_ix").agg(F.array_sort(F.collect_set("start_minute")).alias(to))
    due = settled_minutes(bundle, step_minutes).groupBy("symbol", "bar_ix").agg(F.collect_set("minute").alias("due"))
    d = bundle["marks"].select("symbol", "bar_ix")
    for other in (starts("paths", "of_marks"), starts("trade_paths", "of_trades"), due):
        d = d.join(other, ["symbol", "bar_ix"], "left")
    none = lambda c: F.coalesce(c, F.array().cast("array<int>"))
    bad = ~none("of_marks").eqNullSafe(none("of_trades")) | (F.size(F.array_except(none("due"), none("of_marks"))) > 0)
    return d.select("symbol", "bar_ix", bad.alias("bad"))


def settled_minutes(bundle: dict[str, DataFrame], step_minutes: int) -> DataFrame:
    """``funding`` with ``minute``: the nearest one since the bar's opening."""
    closes = bundle["marks"].select("symbol", "bar_ix", F.col("ts").alias("__close"))
    seconds = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("__close").cast("timestamp"))) / 1_000_000
    return bundle["funding"].join(closes, ["symbol", "bar_ix"]).withColumn("minute", (F.round(seconds / 60) + step_minutes).cast("int")).drop("__close")


def packed(bundle: dict[str, DataFrame], step_minutes: int, per: int = 4096) -> DataFrame:
    """symbol, block and all of a replay's inputs for ``per`` bars as flat arrays: mark paths, trade paths (``t_``), settlements and flags.

    fund_ptr, fund_minute, fund_rate, fund_mark: bar b settles fund_ptr[b] to fund_ptr[b + 1] - 1, in order of time; bad: per bar.
    """
    marks = bundle["marks"]
    f = settled_minutes(bundle, step_minutes).withColumn("block", _block(per))
    g = f.groupBy("symbol", "block").agg(F.array_sort(F.collect_list(F.struct("bar_ix", "ts", "minute", "rate", "mark"))).alias("rows"))
    ptr = _bar_offsets(marks, f.groupBy("symbol", "bar_ix").agg(F.count("*").alias("n")), per, "fund_ptr")
    pick = lambda k, t: F.coalesce(F.transform("rows", lambda r: r[k]), F.array().cast(f"array<{t}>")).alias(f"fund_{k}")
    funds = ptr.join(g, ["symbol", "block"], "left").select("symbol", "block", "fund_ptr", pick("minute", "int"), pick("rate", "double"), pick("mark", "double"))
    bad = flagged(bundle, step_minutes).withColumn("block", _block(per)).groupBy("symbol", "block").agg(F.array_sort(F.collect_list(F.struct("bar_ix", "bad"))).alias("b")).select("symbol", "block", F.transform("b", lambda r: r["bad"]).alias("bad"))
    keys = ["symbol", "block"]
    return flat_paths(marks, bundle["paths"], per).join(flat_paths(marks, bundle["trade_paths"], per, "t_"), keys).join(funds, keys).join(bad, keys)
