"""Token-id files in Simple-8b, written and read by the executors.

A file holds whole documents in ascending order:

    8 bytes   magic ``S8BTOK01``
    4 x u64   documents, ids, blocks, ids in a block (the last has the rest)
    i64 []    document ids; u8 [] 1 where the id is null; u32 [] ids of each document
    u64 []    for each block, the place of its first word (one more: the number of words)
    u64 []    words
    u32       crc32 of all bytes before

All integers are little-endian. Blocks decode by themselves, so a reader can start
at any block. Files are bounded by ids (a longer document has a file of its own),
so a reader holds one file in memory. A file's name tells its place in the order;
it is written under another name and then moved, so a repeated task replaces it
with the same bytes.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barline.llm import simple8b
from barline.llm.common import in_arrow, map_batches, materialize
from barline.llm.fast_tokens import encoder

MAGIC = b"S8BTOK01"
BLOCK_IDS = 1 << 16
FILE_IDS = 4 << 20


def build_file(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, block_ids: int = BLOCK_IDS) -> bytes:
    """The bytes of one file."""
    blocks = [simple8b.encode(ids[i : i + block_ids]) for i in range(0, len(ids), block_ids)]
    places = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<u8")
    out = io.BytesIO()
    out.write(MAGIC + struct.pack("<4Q", len(doc_ids), len(ids), len(blocks), block_ids))
    out.write(np.array([d if d is not None else 0 for d in doc_ids], "<i8").tobytes())
    out.write(np.array([d is None for d in doc_ids], np.uint8).tobytes())
    out.write(np.array(lengths, "<u4").tobytes() + places.tobytes())
    for b in blocks:
        out.write(b.astype("<u8").tobytes())
    return out.getvalue() + struct.pack("<I", zlib.crc32(out.getvalue()))


def open_file(raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, their lengths and all ids of a file; checks its crc32."""
    if raw[: len(MAGIC)] != MAGIC or struct.unpack("<I", raw[-4:])[0] != zlib.crc32(raw[:-4]):
        raise ValueError("not a whole token file")
    docs, n, blocks, block_ids = struct.unpack_from("<4Q", raw, len(MAGIC))
    at = len(MAGIC) + 32
    names = np.frombuffer(raw, "<i8", docs, at)
    null = np.frombuffer(raw, np.uint8, docs, at + 8 * docs)
    lengths = np.frombuffer(raw, "<u4", docs, at + 9 * docs)
    places = np.frombuffer(raw, "<u8", blocks + 1, at + 13 * docs).astype(np.int64)
    words = np.frombuffer(raw, "<u8", int(places[-1]), at + 13 * docs + 8 * (blocks + 1))
    parts = [simple8b.decode(words[places[k] : places[k + 1]], min(block_ids, n - k * block_ids)) for k in range(blocks)]
    ids = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return [None if z else int(d) for d, z in zip(names, null, strict=True)], lengths.astype(np.int64), ids.astype("<u4")


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_column: str = "doc_id", text_column: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """Writes all documents in ascending id order; returns the manifest: part, file, n_docs, n_ids, first.

    Null ids come first, repeated ids in order of their texts' hash. A null text is
    empty: it has the end id alone. ``folder`` is one that all executors share.
    """
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    ordered = source.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    tail = np.array([end_id], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        fs, path = pyarrow.fs.FileSystem.from_uri(folder)
        code = encoder(tokenizer)
        held: list[np.ndarray] = []
        names: list[int | None] = []
        lengths: list[int] = []
        size, count = 0, 0

        def close() -> pa.RecordBatch:
            nonlocal held, names, lengths, size, count
            raw = build_file(names, lengths, np.concatenate(held))
            final, partial = f"{path}/part-{part:08d}-{count:06d}.s8b", f"{path}/_{uuid.uuid4().hex}"
            with fs.open_output_stream(partial) as f:
                f.write(raw)
            fs.move(partial, final)
            row = {"part": [part], "file": [count], "n_docs": [len(names)], "n_ids": [size]}
            held, names, lengths, size, count = [], [], [], 0, count + 1
            return pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in row.items()})

        for batch in batches:
            ids_of = iter(batch.column("doc_id").to_pylist())
            for ids, offsets in code.encode(batch.column("text")):
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    names.append(next(ids_of))
                    held += (ids[a:b], tail)
                    lengths.append(b - a + 1)
                    size += b - a + 1
                    if size >= file_ids:
                        yield close()
        if names:
            yield close()

    spark = docs.sparkSession
    fs, path = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    manifest, _ = materialize(in_arrow(ordered, run, "part bigint, file bigint, n_docs bigint, n_ids bigint", encodes=True), "token-manifest")
    # One row a file, so that this window stays small: 4M ids each.
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("first", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_token_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.s8b").load(folder).select("path", "content")

    def run(batch: pa.RecordBatch) -> pa.Table:
        out = []
        for path, raw in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            name = path.rsplit("/", 1)[1].removesuffix(".s8b").split("-")
            docs, lengths, ids = open_file(memoryview(raw.as_buffer()).tobytes())
            ends = np.cumsum(lengths)
            starts = ends - lengths
            whole = memoryview(ids.tobytes())
            crcs = [zlib.crc32(whole[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            out.append(pa.table({"part": pa.array([int(name[1])] * len(docs), pa.int64()), "file": pa.array([int(name[2])] * len(docs), pa.int64()), "doc_id": pa.array(docs, pa.int64()), "inside": pa.array(starts), "n_tokens": pa.array(lengths), "ids_crc32": pa.array(crcs, pa.int64())}))
        return pa.concat_tables(out) if out else pa.table({k: pa.array([], pa.int64()) for k in ("part", "file", "doc_id", "inside", "n_tokens", "ids_crc32")})

    rows = map_batches(files, run, "part bigint, file bigint, doc_id bigint, inside bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.join(manifest.select("part", "file", "first"), ["part", "file"]).select("doc_id", (F.col("first") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id and ids (array of int) of every document."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.s8b").load(folder).select("content")

    def run(batch: pa.RecordBatch) -> pa.Table:
        out = []
        for raw in batch.column("content"):
            docs, lengths, ids = open_file(memoryview(raw.as_buffer()).tobytes())
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            out.append(pa.table({"doc_id": pa.array(docs, pa.int64()), "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))}))
        return pa.concat_tables(out) if out else pa.table({"doc_id": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int32()))})

    return map_batches(files, run, "doc_id bigint, ids array<int>")
