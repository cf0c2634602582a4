"""Helpers shared by the training-data operators.

Operators take the columns they need by name at their entrance, so columns of
other names (also names that an operator uses for its own results) never clash.
"""

from __future__ import annotations

import atexit
import ctypes
import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Whitespace that separates words: space and the code points 9 to 13.
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
#: The same as a regular expression class for Spark and Python.
SPACE_CLASS = "[\\x20\\x09-\\x0D]"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()
#: Python table for lower-casing A-Z alone, for bytes.
LOWER_BYTES = bytes.maketrans(ASCII_UPPER.encode(), ASCII_LOWER.encode())


#: Spark's setting by which a query's shuffle files are removed when it ends, not when the driver happens to collect its garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (tests) a local one is set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="barline-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Paths of the tables that each owner has written, and the owner of those written now.
_OWNED: dict[str, list[str]] = {}
_OWNER: ContextVar[str | None] = ContextVar("owner", default=None)


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder; it is removed when the driver ends."""
    path = f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}"
    if _OWNER.get() is not None:
        _OWNED.setdefault(_OWNER.get(), []).append(path)
    atexit.register(_remove_quietly, spark, path)
    return path


@contextmanager
def superseding(spark: SparkSession, owner: str) -> Iterator[None]:
    """Tables written inside belong to ``owner``; those that it wrote before are removed first: its last result is written elsewhere by now."""
    for path in _OWNED.pop(owner, []):
        _remove_quietly(spark, path)
    token = _OWNER.set(owner)
    try:
        yield
    finally:
        _OWNER.reset(token)


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _remove_quietly(spark: SparkSession, path: str) -> None:
    try:
        remove_path(spark, path)
    except Exception:  # the session may be gone at exit; the folder is scratch
        pass


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries inside go as soon as each of them ends."""
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)


def materialize(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Cuts the lineage: writes ``df`` as Parquet in the shared folder and rereads it.

    A lost executor costs nothing that was written. Returns the table and its
    path, which the caller may give to :func:`remove_path` once it is superseded.
    Shuffle files go as soon as the table is written, as nothing reads them again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    with shuffles_go(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


class Scratch:
    """Tables that an operator needs on its way: written like :func:`materialize` does, and removed together once its result is."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def table(self, df: DataFrame, tag: str) -> DataFrame:
        out, path = materialize(df, tag)
        self.paths.append(path)
        return out

    def drop(self, *tags: str) -> None:
        """Removes the tables of these tags, or all."""
        gone = [p for p in self.paths if not tags or re.sub(r"-[0-9a-f]{32}$", "", p.rsplit("/", 1)[-1]) in tags]
        for path in gone:
            _remove_quietly(self.spark, path)
        self.paths = [p for p in self.paths if p not in gone]


def words_column(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, A-Z lower-cased; null and blank texts have none."""
    low = F.translate(F.coalesce(text, F.lit("")), ASCII_UPPER, ASCII_LOWER)
    return F.filter(F.split(low, SPACE_CLASS + "+"), lambda w: w != "")


def give_back() -> None:
    """Returns what is free to the system: a Python worker lives on over many tasks, and other stages need its room."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        pass


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType, encodes: bool = False) -> DataFrame:
    """``mapInArrow`` whose workers keep nothing: the tokens that an earlier stage remembered go unless ``run`` encodes."""

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = sys.modules.get("barline.llm.fast_tokens")
        if tokens is not None and not encodes:
            tokens.forget()
        give_back()
        yield from run(batches)
        give_back()

    return df.mapInArrow(lean, schema)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table | dict], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with one output batch for each input batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                yield from (out if isinstance(out, pa.Table) else pa.table(out)).to_batches()

    return in_arrow(df, run, schema)


def by_hash_fraction(df: DataFrame, keys: list[str], limit: int, total: int) -> DataFrame:
    """About ``limit`` of ``total`` rows, chosen by a hash of ``keys``: the same rows every time.

    For fitting models alone: their bound on labelled rows is a parameter.
    """
    if total <= limit:
        return df
    span = 1 << 30
    return df.where(F.pmod(F.xxhash64(*keys, F.lit("sample")), F.lit(span)) < int(span * limit / total))


def labelled(labels: DataFrame, column: str, limit: int | None = None, where: Column | None = None) -> DataFrame:
    """One 0/1 label a document id, at most about ``limit`` of them, by hash; all without a limit.

    Null ids and labels other than 0 and 1 are left out; of labels that
    contradict each other for an id, the larger one holds.
    """
    rows = labels.select(F.col("doc_id"), F.col(column).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
    if where is not None:
        rows = rows.where(where)
    rows = rows.groupBy("doc_id").agg(F.max("label").alias("label"))
    return rows if limit is None else by_hash_fraction(rows, ["doc_id"], limit, rows.count())


def identifier(name: str) -> str:
    if not re.fullmatch(r"\w+", name):
        raise ValueError(f"not a plain column name: {name!r}")
    return name
