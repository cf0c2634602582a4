"""Coverage that refuses: funding that does not span its trades, instruments without a common window."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A settlement belongs to its nearest minute.
MINUTE = 60_000_000


class CoverageError(ValueError):
    """Data that do not cover what they are asked for."""


def funding_spans(trades: DataFrame, funding: DataFrame) -> DataFrame:
    """symbol, first_trade, last_trade, first_funding, last_funding (microseconds; settlements at their nearest minute), covered, of each symbol that trades."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    t = trades.groupBy("symbol").agg(F.min(at).alias("first_trade"), F.max(at).alias("last_trade"))
    settled = F.bround(at / MINUTE).cast("bigint") * MINUTE
    f = funding.groupBy("symbol").agg(F.min(settled).alias("first_funding"), F.max(settled).alias("last_funding"))
    covered = (F.col("first_funding") <= F.col("first_trade")) & (F.col("last_funding") >= F.col("last_trade"))
    return t.join(f, "symbol", "left").withColumn("covered", F.coalesce(covered, F.lit(False)))


def check_funding(trades: DataFrame, funding: DataFrame) -> None:
    """Refuses funding that does not span a symbol's trades: a zero rate would be a claim about the market, not missing data."""
    bad = funding_spans(trades, funding).where("NOT covered").orderBy("symbol").first()
    if bad is not None and bad.first_funding is None:
        raise CoverageError(f"{bad.symbol}: no funding history")
    if bad is not None:
        day = lambda us: (datetime(1970, 1, 1) + timedelta(microseconds=us)).date().isoformat()
        raise CoverageError(f"{bad.symbol}: funding history covers {day(bad.first_funding)}/{day(bad.last_funding)} but the trade bars run {day(bad.first_trade)}/{day(bad.last_trade)}")


def common_window(bars: DataFrame) -> tuple[datetime, datetime]:
    """The latest start and the earliest end of all symbols; refused if they are less than a day apart."""
    spans = bars.groupBy("symbol").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).agg(F.max("a").alias("start"), F.min("b").alias("end")).first()
    if spans.start is None:
        raise CoverageError("no instruments to find a common window for")
    if spans.start >= spans.end - timedelta(days=1):
        raise CoverageError(f"no common window: the latest start {spans.start:%Y-%m-%d} is at or after the earliest end {spans.end:%Y-%m-%d}")
    return spans.start, spans.end


def cut_to_common(bars: DataFrame) -> DataFrame:
    """Bars of all symbols within their common window."""
    start, end = common_window(bars)
    return bars.where((F.col("ts") >= F.lit(start)) & (F.col("ts") <= F.lit(end)))
