"""Schemas of the market relations."""

from __future__ import annotations

from pyspark.sql import types as T

BARS = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("ts", T.TimestampNTZType()), *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")]])
SIGNALS = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("direction", T.StringType()), T.StructField("strength", T.DoubleType()), T.StructField("stop_distance", T.DoubleType()), T.StructField("take_profit", T.DoubleType())])
MARGIN_TIERS = T.StructType([T.StructField("cap", T.DoubleType()), T.StructField("max_leverage", T.IntegerType()), T.StructField("mmr", T.DoubleType()), T.StructField("amount", T.DoubleType())])
