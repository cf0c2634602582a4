"""Research data in files: CSV bars and rates, numbered minute parts, bundles, manifests, published datasets."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PRICES = ", ".join(f"{c} DOUBLE" for c in ("open", "high", "low", "close", "volume"))
MINUTES = f"ts BIGINT, {_PRICES}"


def csv_bars(spark: SparkSession, path: str, symbol: str, quote_volume: bool = False) -> DataFrame:
    """Bars of a CSV with a header: timestamp (open time, UTC), prices, volume and perhaps quote_volume; the schema is stated, not inferred."""
    schema = f"timestamp TIMESTAMP_NTZ, {_PRICES}" + ", quote_volume DOUBLE" * quote_volume
    d = spark.read.schema(schema).option("mode", "FAILFAST").csv(path, header=True)
    return d.select(F.lit(symbol).alias("symbol"), F.col("timestamp").alias("ts"), *[c for c in d.columns if c != "timestamp"])


def csv_funding(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """Settlements of a CSV: timestamp, last_funding_rate, funding_interval_hours."""
    d = spark.read.schema("timestamp TIMESTAMP_NTZ, last_funding_rate DOUBLE, funding_interval_hours DOUBLE").option("mode", "FAILFAST").csv(path, header=True)
    return d.select(F.lit(symbol).alias("symbol"), F.col("timestamp").alias("stamp"), F.col("last_funding_rate").alias("rate"), F.col("funding_interval_hours").alias("hours"))


def csv_quotes(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """Ticks of a CSV without a header: timestamp, bid, ask; with a running number that settles the order within a time."""
    d = spark.read.schema("ts TIMESTAMP_NTZ, bid DOUBLE, ask DOUBLE").option("mode", "FAILFAST").csv(path)
    return d.select(F.lit(symbol).alias("symbol"), "ts", F.monotonically_increasing_id().alias("seq"), "bid", "ask")


def pages(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of overlapping pages once each; of repeats the one of the last page (``order``) holds."""
    values = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("v")).select(*keys, *[f"v.{c}" for c in values])


def minute_parts(spark: SparkSession, folder: str, step_ms: int = 60_000) -> DataFrame:
    """Minutes of part files ``part-00000...parquet``; raises where a part is missing, or minutes repeat, go back or have a hole."""
    d = spark.read.schema(MINUTES).parquet(folder).withColumn("part", F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).cast("int"))
    g = d.groupBy("part").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.count_distinct("ts").alias("k"))
    parts = sorted(g.collect(), key=lambda r: r["part"])  # one row a file
    if [r["part"] for r in parts] != list(range(len(parts))):
        raise ValueError("part files are not numbered without a gap")
    for a, b in zip([None, *parts], parts):
        if b["k"] != b["n"] or (b["last"] - b["first"]) // step_ms + 1 != b["n"] or (a is not None and b["first"] != a["last"] + step_ms):
            raise ValueError(f"part {b['part']} has a hole, a repeat or begins at the wrong minute")
    return d


def brackets(spark: SparkSession, path: str) -> DataFrame:
    """Margin tiers (cap, max_leverage, mmr, amount) of a JSON file in order of their caps; raises if there is none."""
    d = spark.read.schema("symbol STRING, cap DOUBLE, max_leverage INT, mmr DOUBLE, amount DOUBLE").json(path, multiLine=True)
    if d.isEmpty():
        raise ValueError(f"no margin tiers in {path}")
    return d


#: Relations of a bundle, each keyed by symbol and bar_ix.
BUNDLE = ("marks", "funding", "paths", "trade_paths", "brackets")


def write_bundle(folder: str, relations: dict[str, DataFrame]) -> None:
    """Writes a bundle's relations, each once."""
    if set(relations) != set(BUNDLE):
        raise ValueError(f"a bundle has {BUNDLE}")
    for name, df in relations.items():
        df.write.mode("errorifexists").parquet(f"{folder}/{name}")


def read_bundle(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in BUNDLE}


def nested_paths(points: DataFrame) -> DataFrame:
    """symbol, bar_ix, segments: a long table of path points (segment_ix, start_minute, side, minute, price) packed by bar; a bar is bounded."""
    inner = points.groupBy("symbol", "bar_ix", "segment_ix", "start_minute").agg(*[F.array_sort(F.collect_list(F.when(F.col("side") == k, F.struct("minute", "price")))).alias(n) for k, n in ((0, "lows"), (1, "highs"))])
    return inner.groupBy("symbol", "bar_ix").agg(F.array_sort(F.collect_list(F.struct("segment_ix", "start_minute", "lows", "highs"))).alias("segments"))


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """file, bytes, sha256 of every file below a folder, hashed where it is read."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return d.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write_manifest(spark: SparkSession, folder: str, path: str) -> None:
    manifest(spark, folder).write.mode("errorifexists").json(path)


def changed_files(spark: SparkSession, folder: str, path: str) -> DataFrame:
    """file, what (missing, added or changed) of the files that differ from a manifest; empty if all is as it was."""
    then, now = spark.read.schema("file STRING, bytes BIGINT, sha256 STRING").json(path), manifest(spark, folder)
    j = then.select("file", F.col("sha256").alias("then")).join(now.select("file", F.col("sha256").alias("now")), "file", "full")
    return j.where(~F.col("then").eqNullSafe(F.col("now"))).select("file", F.when(F.col("now").isNull(), "missing").when(F.col("then").isNull(), "added").otherwise("changed").alias("what"))


def dataset_id(files: Iterable[tuple[str, str]]) -> str:
    """Content address of (file, sha256) pairs: independent of their order and of where they lie."""
    return hashlib.sha256(json.dumps(sorted(files), separators=(",", ":")).encode()).hexdigest()


def publish(spark: SparkSession, df: DataFrame, root: str, partitions: int = 1) -> str:
    """Writes a relation as a dataset named by its contents, once; what is there already stays. Returns its id.

    The id is a digest of the rows, not of the files, so it doesn't depend on how they are laid out.
    """
    columns = sorted(df.columns)
    h = [F.sum(F.xxhash64(*columns, F.lit(k)).cast("decimal(38,0)")) for k in range(2)]
    row = df.agg(F.count("*").alias("n"), *[x.cast("string").alias(f"h{k}") for k, x in enumerate(h)]).first()
    types = [(f.name, f.dataType.simpleString()) for f in sorted(df.schema, key=lambda f: f.name)]
    name = dataset_id([*types, *((k, str(row[k])) for k in ("n", "h0", "h1"))])
    try:
        df.select(*columns).repartition(partitions).write.mode("errorifexists").parquet(f"{root}/{name}")
    except AnalysisException as e:
        if "ALREADY_EXISTS" not in str(e.getCondition()):
            raise
    return name


def resolve(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A published dataset; raises if its rows don't have the id any more."""
    df = spark.read.parquet(f"{root}/{name}")
    columns = sorted(df.columns)
    h = [F.sum(F.xxhash64(*columns, F.lit(k)).cast("decimal(38,0)")) for k in range(2)]
    row = df.agg(F.count("*").alias("n"), *[x.cast("string").alias(f"h{k}") for k, x in enumerate(h)]).first()
    types = [(f.name, f.dataType.simpleString()) for f in sorted(df.schema, key=lambda f: f.name)]
    if dataset_id([*types, *((k, str(row[k])) for k in ("n", "h0", "h1"))]) != name:
        raise ValueError(f"dataset {name} was changed")
    return df


def report(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """keys, report: the other columns of each row as one JSON text, in the order of their names."""
    rest = sorted(c for c in metrics.columns if c not in keys)
    return metrics.select(*keys, F.to_json(F.struct(*rest)).alias("report"))


def write_results(df: DataFrame, path: str, form: str = "csv") -> None:
    """Writes results as CSV (with header) or JSON, once."""
    if form not in ("csv", "json"):
        raise ValueError(f"no such form: {form}")
    w = df.write.mode("errorifexists")
    w.csv(path, header=True) if form == "csv" else w.json(path)


