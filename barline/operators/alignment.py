"""Relations laid on common axes: cuts, fills, settlements, panels and bundles.

All joins have an equi-key (symbol and a time bucket); order within a symbol is by time.
"""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barline.functions import features as ft

_UNITS = {"s": 1, "m": 60, "min": 60, "h": 3600, "d": 86_400, "w": 604_800}


def timeframe_seconds(text: str) -> int:
    """Seconds of a timeframe such as ``15m``, ``5min``, ``4h`` or ``1d``; raises for others."""
    found = re.fullmatch(r"([1-9][0-9]*)(s|m|min|h|d|w)", text)
    if not found:
        raise ValueError(f"not a timeframe: {text!r}")
    return int(found[1]) * _UNITS[found[2]]


def normalized_window(start: datetime, end: datetime, timeframe: str) -> tuple[datetime, datetime]:
    """The whole bars inside of a window: the start up, the end down to the grid from the epoch; raises if none is left."""
    step, epoch = timeframe_seconds(timeframe), datetime(1970, 1, 1)
    a, b = -(-int((start - epoch).total_seconds()) // step), int((end - epoch).total_seconds()) // step
    if a >= b:
        raise ValueError("the window holds no whole bar")
    return epoch + timedelta(seconds=a * step), epoch + timedelta(seconds=b * step)


def add_months(day: date, months: int) -> date:
    """The same day some months on, or the month's last day where it has fewer."""
    at = day.year * 12 + day.month - 1 + months
    first = date(at // 12, at % 12 + 1, 1)
    following = date((at + 1) // 12, (at + 1) % 12 + 1, 1)
    return first + timedelta(days=min(day.day, (following - first).days) - 1)


def fold_schedule(first: date, last: date, train_months: int, test_months: int = 3) -> list[tuple[date, date, date]]:
    """(train start, test start, test end) of walk-forward folds whose tests begin with calendar quarters."""
    start = add_months(first, train_months)
    start = date(start.year, (start.month - 1) // 3 * 3 + 1, 1) if start.day == 1 and start.month % 3 == 1 else add_months(date(start.year, (start.month - 1) // 3 * 3 + 1, 1), 3)
    out = []
    while add_months(start, test_months) <= last:
        out.append((add_months(start, -train_months), start, add_months(start, test_months)))
        start = add_months(start, test_months)
    return out


def quotes(ticks: DataFrame, bucket: Column) -> DataFrame:
    """Bars of bid and ask (eight prices) and the number of ticks; ``ticks`` has symbol, ts, seq, bid, ask."""
    prices = [f(side, "seq").alias(f"{side}_{name}") for side in ("bid", "ask") for name, f in (("open", F.min_by), ("close", F.max_by))]
    extremes = [f(side).alias(f"{side}_{name}") for side in ("bid", "ask") for name, f in (("high", F.max), ("low", F.min))]
    return ticks.groupBy("symbol", bucket.alias("bucket")).agg(*prices, *extremes, F.count("*").alias("n_ticks")).withColumnRenamed("bucket", "ts")


def between(bars: DataFrame, low: Column, high: Column, close_ts: Column) -> DataFrame:
    """Bars whose close lies in (low, high]."""
    return bars.where((close_ts > low) & (close_ts <= high))


def carve(bars: DataFrame, cut: Column, close_ts: Column) -> tuple[DataFrame, DataFrame]:
    """Bars that close by the cut, and the later ones."""
    return bars.where(close_ts <= cut), bars.where(close_ts > cut)


def content_hash(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keys, n, digest: an order-free digest of each group's rows (sums of two hashes, as text)."""
    h = [F.sum(F.xxhash64(*values, F.lit(k)).cast("decimal(38,0)")) for k in range(2)]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sha2(F.concat_ws("|", *[x.cast("string") for x in h]), 256).alias("digest"))


def misaligned(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that one side lacks, with the side that has them; empty where both lie on one axis."""
    mine = a.select(*keys).distinct()
    others = b.select(*keys).distinct()
    return mine.join(others, keys, "left_anti").withColumn("only_in", F.lit("left")).unionByName(others.join(mine, keys, "left_anti").withColumn("only_in", F.lit("right")))


def assert_aligned(a: DataFrame, b: DataFrame, keys: list[str]) -> None:
    wrong = misaligned(a, b, keys).limit(1).collect()
    if wrong:
        raise ValueError(f"not on one axis: {wrong[0].asDict()}")


def axis(*frames: DataFrame) -> DataFrame:
    """All points of time of some relations, once."""
    out = frames[0].select("ts")
    for f in frames[1:]:
        out = out.union(f.select("ts"))
    return out.distinct()


def grid(bars: DataFrame, step: str) -> DataFrame:
    """symbol, ts of each symbol's full grid from its first to its last bar."""
    ends = bars.groupBy("symbol").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return ends.select("symbol", F.explode(F.sequence("a", "b", F.expr(f"INTERVAL {step}"))).alias("ts"))


def on_axis(points: DataFrame, samples: DataFrame, seq: str, value: str, seed: float) -> DataFrame:
    """Each point of an axis (symbol, ts) with the last sample known by then; of one time's samples the last by ``seq`` holds; ``seed`` before the first."""
    last = samples.groupBy("symbol", "ts").agg(F.max_by(value, seq).alias("sample"))
    return points.join(last, ["symbol", "ts"], "left").select("symbol", "ts", F.coalesce(ft.fill_forward(F.col("sample")), F.lit(seed)).alias(value))


def fill_marks(marks: DataFrame, trades: DataFrame, step: str, seconds: int, most: int) -> DataFrame:
    """Marks with each run of at most ``most`` missing bars taken from trade bars (volume 0), and ``filled``; longer runs stay missing.

    Runs are islands of the missing grid points of a symbol.
    """
    missing = grid(marks, step).join(marks.select("symbol", "ts"), ["symbol", "ts"], "left_anti")
    island = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / seconds) - F.row_number().over(ft.order())
    runs = missing.withColumn("island", island)
    short = runs.withColumn("length", F.count("*").over(Window.partitionBy("symbol", "island"))).where(F.col("length") <= most).select("symbol", "ts")
    columns = ["symbol", "ts", "open", "high", "low", "close"]
    added = short.join(trades.select(*columns), ["symbol", "ts"]).select(*columns, F.lit(0.0).alias("volume"), F.lit(True).alias("filled"))
    return marks.select(*columns, "volume", F.lit(False).alias("filled")).unionByName(added)


def funding_rows(events: DataFrame, bars: DataFrame, marks: DataFrame, bar_seconds: int, mark_seconds: int) -> DataFrame:
    """symbol, bar_ix, stamp, rate, mark: each settlement with the bar in which it falls (opened at or before it) and the last mark completed before it.

    ``bars`` and ``marks`` are labelled by their open on a grid, so both joins are equi-joins.
    """
    micros = F.unix_micros(F.col("stamp").cast("timestamp"))
    numbered = bars.select("symbol", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (bar_seconds * 1_000_000)).alias("slot"), (F.row_number().over(ft.order()) - 1).cast("bigint").alias("bar_ix"))
    known = marks.select("symbol", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (mark_seconds * 1_000_000)).alias("mark_slot"), F.col("close").alias("mark"))
    e = events.withColumns({"slot": F.floor(micros / (bar_seconds * 1_000_000)), "mark_slot": F.floor(micros / (mark_seconds * 1_000_000)) - 1})
    return e.join(numbered, ["symbol", "slot"]).join(known, ["symbol", "mark_slot"], "left").select("symbol", "bar_ix", "stamp", "rate", "mark")


def nearest_minute(ts: Column) -> Column:
    """Minute number nearest to a time; halves go to the even minute."""
    return F.bround(F.unix_micros(ts.cast("timestamp")) / F.lit(60_000_000.0), 0).cast("bigint")


def packed_settlements(funding: DataFrame) -> DataFrame:
    """symbol, bar_ix, settlements: those inside of each bar, in order of time; several in a bar stay several."""
    return funding.groupBy("symbol", "bar_ix").agg(F.array_sort(F.collect_list(F.struct("stamp", "rate", "mark"))).alias("settlements"))


def rebased(relation: DataFrame, start: int, end: int) -> DataFrame:
    """The rows of bars [start, end), numbered from 0."""
    return relation.where((F.col("bar_ix") >= start) & (F.col("bar_ix") < end)).withColumn("bar_ix", F.col("bar_ix") - start)


def followed_by(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both relations one after the other, the second one's bars numbered on; raises unless it begins later in each symbol."""
    ends = first.groupBy("symbol").agg(F.max("ts").alias("end"), (F.max("bar_ix") + 1).alias("n"))
    starts = second.groupBy("symbol").agg(F.min("ts").alias("start"))
    if starts.join(ends, "symbol").where("start <= end").limit(1).count():
        raise ValueError("the second part doesn't begin after the first")
    moved = second.join(ends.select("symbol", "n"), "symbol", "left").withColumn("bar_ix", F.col("bar_ix") + F.coalesce("n", F.lit(0))).drop("n")
    return first.unionByName(moved)


def panel(bars: DataFrame) -> DataFrame:
    """symbol, day, close, fill (last hour's close by 01:00 of the next day), alive, traded: one row for each symbol and day of the whole range.

    ``bars`` are hourly. A day without bars is not alive and keeps the last close known.
    """
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    d = bars.groupBy("symbol", day.alias("day")).agg(F.max_by("close", "ts").alias("close"), F.sum(F.col("close") * F.col("volume")).alias("traded"))
    # The bar of midnight ends at 01:00, so it is what a fill on the next day sees.
    first = bars.where(F.hour("ts") == 0).select("symbol", (day - F.expr("INTERVAL 1 DAY")).alias("day"), F.col("close").alias("next_hour"))
    days = bars.agg(F.min(day).alias("a"), F.max(day).alias("b")).select(F.explode(F.expr("sequence(a, b, INTERVAL 1 DAY)")).alias("day"))
    every = bars.select("symbol").distinct().crossJoin(F.broadcast(days))  # a row a symbol and day is the panel itself
    w = Window.partitionBy("symbol").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    held = every.join(d, ["symbol", "day"], "left").join(first, ["symbol", "day"], "left")
    close = F.last("close", True).over(w)
    return held.select("symbol", "day", close.alias("close"), F.coalesce("next_hour", close).alias("fill"), F.col("traded").isNotNull().alias("alive"), F.coalesce("traded", F.lit(0.0)).alias("traded"))


def daily_returns(returns: DataFrame) -> DataFrame:
    """symbol, day, ret on the UTC-day clock: a bar belongs to the day that its close ends or lies in; one bar's return passes as it is, several compound."""
    day = (F.date_trunc("day", F.col("ts") - F.expr("INTERVAL 1 MICROSECOND")) + F.expr("INTERVAL 1 DAY")).cast("timestamp_ntz")
    g = returns.groupBy("symbol", day.alias("day")).agg(F.count("*").alias("n"), F.max("ret").alias("one"), F.product(1 + F.col("ret")).alias("growth"))
    return g.select("symbol", "day", F.when(F.col("n") == 1, F.col("one")).otherwise(F.col("growth") - 1).alias("ret"))


def outside(rows: DataFrame, ranges: DataFrame, month: Column) -> DataFrame:
    """Rows whose month lies in none of the half-open ranges (symbol, first_month, end_month); months are the equi-key."""
    months = ranges.select("symbol", F.explode(F.sequence("first_month", F.col("end_month") - 1)).alias("__month")).distinct()
    return rows.withColumn("__month", month).join(months, ["symbol", "__month"], "left_anti").drop("__month")


def missing_days(bars: DataFrame, least: int) -> DataFrame:
    """symbol, day of weekdays (but 25 December and 1 January) between a symbol's first and last day on which it has fewer bars than ``least``."""
    days = bars.groupBy("symbol", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    span = days.groupBy("symbol").agg(F.min("day").alias("a"), F.max("day").alias("b")).select("symbol", F.explode(F.sequence("a", "b")).alias("day"))
    holiday = ((F.month("day") == 12) & (F.dayofmonth("day") == 25)) | ((F.month("day") == 1) & (F.dayofmonth("day") == 1))
    return span.join(days, ["symbol", "day"], "left").where((F.weekday("day") < 5) & ~holiday & (F.coalesce("n", F.lit(0)) < least)).select("symbol", "day")


def best_offset(bars: DataFrame, second: DataFrame, offsets: tuple[int, ...]) -> DataFrame:
    """symbol, offset: by how many hours the second source's bids (symbol, ts, open, high, low, close) must be moved so that the closes differ least, by the median; ties: the smaller one."""
    moved = second.withColumn("offset", F.explode(F.array(*[F.lit(h) for h in offsets]))).withColumn("ts", F.col("ts") + F.expr("make_dt_interval(0, offset, 0, 0)")).withColumnRenamed("close", "other")
    apart = bars.select("symbol", "ts", "bid_close").join(moved, ["symbol", "ts"]).groupBy("symbol", "offset").agg(F.percentile(F.abs(F.col("bid_close") - F.col("other")), F.lit(0.5)).alias("apart"))
    return apart.groupBy("symbol").agg(F.min(F.struct("apart", "offset"))["offset"].alias("offset"))


def filled_quotes(bars: DataFrame, second: DataFrame, least: int, offsets: tuple[int, ...]) -> DataFrame:
    """``bars`` (symbol, ts, bid and ask prices, n_ticks) with bars of a second source on days that have too few, and ``source`` (main or second).

    Only bars that aren't there are added. The second source has bids alone, on a clock that is some hours off
    (see :func:`best_offset`); its asks lie above its bids by the main source's median spread at that hour (none: no bar is added).
    """
    spread = bars.groupBy("symbol", F.hour("ts").alias("hour")).agg(F.percentile(F.col("ask_close") - F.col("bid_close"), F.lit(0.5)).alias("spread"))
    clocked = second.join(best_offset(bars, second, offsets), "symbol").withColumn("ts", F.col("ts") + F.expr("make_dt_interval(0, offset, 0, 0)"))
    wanted = clocked.withColumn("day", F.to_date("ts")).join(missing_days(bars, least), ["symbol", "day"], "left_semi").join(bars.select("symbol", "ts"), ["symbol", "ts"], "left_anti")
    names = ("open", "high", "low", "close")
    added = wanted.withColumn("hour", F.hour("ts")).join(spread, ["symbol", "hour"]).select("symbol", "ts", *[F.col(n).alias(f"bid_{n}") for n in names], *[(F.col(n) + F.col("spread")).alias(f"ask_{n}") for n in names], "n_ticks")
    own = bars.select("symbol", "ts", *[f"{side}_{n}" for side in ("bid", "ask") for n in names], "n_ticks")
    return own.withColumn("source", F.lit("main")).unionByName(added.withColumn("source", F.lit("second")))
