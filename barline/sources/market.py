"""Ticks from the driver's tables, and bars from ticks.

Prices are whole minor units held as doubles, so that sums over windows are
exact in any order and results do not depend on how rows are partitioned.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from barline.schema import BARS


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trade_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ts, price, volume, seq: line items as day-stamped trades."""
    d = read(spark, sf_dir, "lineitem")
    return d.select(
        F.concat("l_returnflag", "l_linestatus").alias("symbol"),
        F.col("l_shipdate").alias("ts"),
        F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity")).cast("double").alias("price"),
        F.col("l_quantity").alias("volume"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("seq"),
    )


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ts, price, volume, seq: events as intraday trades."""
    e = read(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("symbol"), "ts", F.floor(F.col("value") * 100).cast("double").alias("price"), F.lit(1.0).alias("volume"), F.struct("ts", "event_id").alias("seq"))


def bars(ticks: DataFrame, bucket: Column) -> DataFrame:
    """OHLCV bars by symbol and bucket (a column that gives a bar's label): one partial and one final aggregation."""
    return ticks.groupBy("symbol", bucket.alias("ts")).agg(
        F.min_by("price", "seq").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "seq").alias("close"),
        F.sum("volume").alias("volume"),
    )


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(trade_ticks(spark, sf_dir), F.date_trunc("day", "ts").cast("timestamp_ntz"))


def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(event_ticks(spark, sf_dir), F.date_trunc("hour", "ts").cast("timestamp_ntz"))


def wide_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of six times seven symbols: line items by flag, status and line number."""
    ticks = trade_ticks(spark, sf_dir).withColumn("symbol", F.concat("symbol", F.col("seq.l_linenumber").cast("string")))
    return bars(ticks, F.date_trunc("day", "ts").cast("timestamp_ntz"))


def resample(fine: DataFrame, bucket: Column) -> DataFrame:
    """Coarser bars from bars: first open, extreme highs and lows, last close, summed volume."""
    return fine.groupBy("symbol", bucket.alias("bucket")).agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume")).withColumnRenamed("bucket", "ts")


def write_bars(df: DataFrame, path: str) -> None:
    """Writes bars once, by symbol; refuses to replace what is there."""
    df.select(*BARS.fieldNames()).write.mode("errorifexists").partitionBy("symbol").parquet(path)


def read_bars(spark: SparkSession, path: str, symbol: str | None = None) -> DataFrame:
    """Bars of a folder; a symbol reads its partition alone."""
    df = spark.read.schema(BARS).parquet(path)
    return df if symbol is None else df.where(F.col("symbol") == symbol)


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a time without a zone, whatever the session's zone is."""
    seconds = F.hour(ts) * 3600 + F.minute(ts) * 60
    return F.datediff(ts, F.lit("1970-01-01").cast("date")).cast("bigint") * 86_400_000_000 + seconds.cast("bigint") * 1_000_000 + (F.expr("extract(SECOND FROM __ts)") * 1_000_000).cast("bigint")


def write_ranged(df: DataFrame, path: str, tasks: int, group_bytes: int = 128 << 20) -> None:
    """Writes bars once, range-partitioned and sorted by symbol and time: a file, and each row group in it, holds a narrow range.

    The time stands there a second time as a number (ts_us): Parquet filters on times without a zone aren't pushed
    down to row groups, those on numbers are. :func:`range_scan` uses it.
    """
    rows = df.select(*BARS.fieldNames()).repartitionByRange(tasks, "symbol", "ts").sortWithinPartitions("symbol", "ts")
    numbered = rows.withColumn("__ts", F.col("ts")).withColumn("ts_us", epoch_micros(F.col("__ts"))).drop("__ts")
    numbered.write.mode("errorifexists").option("parquet.block.size", group_bytes).option("parquet.block.size.row.check.min", 100).parquet(path)


def range_scan(spark: SparkSession, path: str, start: str | None = None, end: str | None = None, symbols: list[str] | None = None, holdout_start: str | None = None) -> DataFrame:
    """Bars of a folder of :func:`write_ranged` in the half-open range ``[start, end)``; row groups outside of it are not read.

    With ``holdout_start``, a range that reaches into the holdout is refused before anything is read: an open end is one too.
    """
    at = lambda text: (datetime.fromisoformat(text) - datetime(1970, 1, 1)) // timedelta(microseconds=1)
    if holdout_start is not None and (end is None or at(end) > at(holdout_start)):
        raise ValueError(f"the range ends after the holdout's start {holdout_start}")
    if start is not None and end is not None and at(start) >= at(end):
        raise ValueError("the range is empty")
    df = spark.read.schema(StructType([*BARS.fields, StructField("ts_us", LongType())])).parquet(path)
    if start is not None:
        df = df.where(F.col("ts_us") >= at(start))
    if end is not None:
        df = df.where(F.col("ts_us") < at(end))
    return (df if symbols is None else df.where(F.col("symbol").isin(symbols))).select(*BARS.fieldNames())


def safe_name(symbol: Column) -> Column:
    """A symbol as a file name."""
    return F.translate(symbol, "/:", "--")


def in_sample(df: DataFrame, holdout_start: str) -> DataFrame:
    """Bars before the holdout; raises if a bar lies in it."""
    late = df.where(F.col("ts") >= F.lit(holdout_start).cast("timestamp_ntz")).limit(1).count()
    if late:
        raise ValueError(f"bars at or after the holdout's start {holdout_start}")
    return df


#: The same relations for SQL engines.
TRADE_TICKS_SQL = """trade_ticks AS (
  SELECT l_returnflag || l_linestatus AS symbol, l_shipdate AS ts, floor(l_extendedprice * 100 / l_quantity) AS price, l_quantity AS volume,
    l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem)"""
DAILY_SQL = f"""{TRADE_TICKS_SQL}, bars AS (
  SELECT symbol, date_trunc('day', ts)::TIMESTAMP AS ts,
    first(price ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS open, max(price) AS high, min(price) AS low,
    last(price ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS close, sum(volume) AS volume
  FROM trade_ticks GROUP BY ALL)"""
HOURLY_SQL = """event_ticks AS (SELECT event_type AS symbol, ts, floor(value * 100) AS price, 1.0::DOUBLE AS volume, event_id FROM events),
hours AS (SELECT symbol, date_trunc('hour', ts)::TIMESTAMP AS ts, first(price ORDER BY ts, event_id) AS open, max(price) AS high, min(price) AS low,
    last(price ORDER BY ts, event_id) AS close, sum(volume) AS volume FROM event_ticks GROUP BY symbol, date_trunc('hour', ts)::TIMESTAMP)"""
WIDE_SQL = DAILY_SQL.replace("l_returnflag || l_linestatus AS symbol", "l_returnflag || l_linestatus || l_linenumber AS symbol")
