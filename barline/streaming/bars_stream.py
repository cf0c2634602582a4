"""Closed bars and checked signals from a stream of tick files.

Ticks arrive as Parquet files (a drop folder stands for a paging source; the
checkpoint makes resuming exact). A bar is given out once the watermark has
passed its end, so a bar that may still change never leaves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def read_ticks(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def closed_bars(ticks: DataFrame, width: str, late: str = "10 minutes") -> DataFrame:
    """OHLCV bars by symbol of a stream with symbol, ts (timestamp), price, volume, seq."""
    return (
        ticks.withWatermark("ts", late)
        .groupBy("symbol", F.window("ts", width).alias("w"))
        .agg(F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "seq").alias("close"), F.sum("volume").alias("volume"))
        .select("symbol", F.col("w.end").alias("ts"), "open", "high", "low", "close", "volume")
    )


def write_bars(bars: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends closed bars to a Parquet folder, each once, as far as there is input."""
    return bars.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
