"""Loading minute bars as a stream that refuses holes, repeats and steps back.

Each series (symbol and kind) keeps its last minute as state. A minute is taken if it is
the next one; others go to a side table with the reason. A hole is never jumped: what
comes after it is refused until the missing minutes have come. Outputs are written by
batch, so a batch that runs again after a failure replaces its own files: resuming is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

MINUTE_MS = 60_000
MINUTES = T.StructType([T.StructField(c, T.StringType()) for c in ("symbol", "kind")] + [T.StructField("ts", T.LongType())] + [T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")])
JUDGED = T.StructType([*MINUTES.fields, T.StructField("refused", T.StringType())])


def judge(rows: pd.DataFrame, last: int | None) -> tuple[pd.DataFrame, int | None]:
    """``rows`` of a series in time order with ``refused`` (None: taken), and the last minute taken. The first minute of a series begins it."""
    rows = rows.sort_values("ts", kind="stable")
    reasons = []
    for ts, *prices in rows[["ts", "open", "high", "low", "close"]].itertuples(index=False):
        o, h, l, c = prices
        if ts != ts or ts is None:
            reasons.append("no time")
        elif ts % MINUTE_MS:
            reasons.append("off the grid")
        elif any(p != p or p is None for p in prices) or not l <= min(o, c) <= max(o, c) <= h:
            reasons.append("no bar")
        elif last is not None and ts == last:
            reasons.append("repeat")
        elif last is not None and ts < last:
            reasons.append("step back")
        elif last is not None and ts > last + MINUTE_MS:
            reasons.append("after a hole")
        else:
            reasons.append(None)
            last = int(ts)
    return rows.assign(refused=pd.Series(reasons, index=rows.index, dtype=object)), last


class _Series(StatefulProcessor):
    """The state of a series: its last minute."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "ts long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = pd.concat(list(rows), ignore_index=True)
        last = self.last.get()[0] if self.last.exists() else None
        out, now = judge(held, last)
        if now != last:
            self.last.update((now,))
        yield out[JUDGED.fieldNames()]

    def close(self) -> None:
        pass


def judged(minutes: DataFrame) -> DataFrame:
    """A stream of minutes with ``refused``, by the state of each series. Needs the RocksDB state store."""
    return minutes.groupBy("symbol", "kind").transformWithStateInPandas(_Series(), JUDGED, "Append", "None")


def load(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Takes minutes from Parquet files of ``source`` as far as there are any: taken ones go to ``target``/minutes, refused ones to ``target``/refused.

    A file of a batch that ran before is replaced, not added to.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(MINUTES).option("maxFilesPerTrigger", 64).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            for name, rows in (("minutes", batch.where("refused IS NULL").drop("refused")), ("refused", batch.where("refused IS NOT NULL"))):
                rows.write.mode("overwrite").parquet(f"{target}/{name}/batch={number}")
        finally:
            batch.unpersist()

    return judged(stream).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def loaded(spark: SparkSession, target: str, name: str = "minutes") -> DataFrame:
    """Minutes (or those "refused") loaded so far."""
    schema = MINUTES if name == "minutes" else JUDGED
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{target}/{name}")


def coverage(minutes: DataFrame) -> DataFrame:
    """symbol, kind, first_ts, last_ts, n, whole (as many minutes as the span has) of loaded minutes."""
    d = minutes.groupBy("symbol", "kind").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))
    return d.withColumn("whole", F.col("n") == (F.col("last_ts") - F.col("first_ts")) / MINUTE_MS + 1)
