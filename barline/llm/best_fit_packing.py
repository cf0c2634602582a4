"""Best-two-fit packing of token pieces into sequences of a fixed length.

A bin is filled greedily with the longest pieces that fit. If a gap is left, its
smallest piece is replaced by the two unpacked pieces that fill the gap and that
piece's place more tightly, where such a pair exists. Choices look at lengths
alone, so a packer works on counts by length (bounded by the sequence length)
and then deals out the pieces of each length.

Pieces are dealt to packers by a hash of what they are, so a packer's share is
bounded whatever the ids; each leaves at most one bin poorly filled.

Defined results: null and empty texts are one piece with the end id alone;
an empty table gives no pieces; repeated rows are packed each for itself.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.common import in_arrow, materialize
from barline.llm.fast_tokens import encoder

#: Pieces of one packer, about; a bound on memory, and large, as each packer ends with a bin that may stay open.
PACKER_PIECES = 60_000


def piece_lengths(n: int, size: int) -> list[int]:
    """Lengths of the pieces of ``n`` ids: a shorter first one if ``size`` doesn't divide them."""
    if n <= size:
        return [n]
    return ([n % size] if n % size else []) + [size] * (n // size)


def pack_lengths(counts: np.ndarray, size: int) -> list[list[int]]:
    """Bins of lengths by best-two-fit; ``counts[l]`` pieces of length ``l`` (0 < l <= size)."""
    left = counts.astype(np.int64).copy()
    left[0] = 0
    bins: list[list[int]] = [[size]] * int(left[size])
    left[size] = 0
    there = np.flatnonzero(left)  # lengths that still have pieces, ascending

    def take(length: int) -> None:
        nonlocal there
        left[length] -= 1
        if not left[length]:
            there = there[there != length]

    while len(there):
        gap, current = size, []
        while gap and len(there) and there[0] <= gap:
            best = int(there[np.searchsorted(there, gap, "right") - 1])
            take(best)
            current.append(best)
            gap -= best
        if gap and len(there):
            smallest = current[-1]
            room = gap + smallest
            a = there[: np.searchsorted(there, room, "right")]
            at = np.searchsorted(there, room - a, "right") - 1
            fits = at >= 0
            a, b = a[fits], there[at[fits]]
            # A pair of one length needs two pieces of it; else the next smaller partner.
            same = (a == b) & (left[b] < 2)
            if same.any():
                lower = np.searchsorted(there, b[same]) - 1
                b[same] = np.where(lower >= 0, there[lower], -(2 * size))
            if len(a):
                k = int(np.argmax(a + b))
                if a[k] + b[k] > smallest:
                    left[smallest] += 1
                    if left[smallest] == 1:
                        there = np.insert(there, np.searchsorted(there, smallest), smallest)
                    take(int(a[k]))
                    take(int(b[k]))
                    current = [*current[:-1], int(max(a[k], b[k])), int(min(a[k], b[k]))]
        bins.append(current)
    return bins


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, size: int, id_column: str = "doc_id", text_column: str = "text", keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of each piece of each document."""
    source = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer)
        for batch in batches:
            names, at = batch.column("doc_id"), 0
            for ids, offsets in code.encode(batch.column("text")):
                rows, whole, out_ids = [], memoryview(ids.tobytes()), []
                for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                    begin = 0
                    for j, n in enumerate(piece_lengths(b - a + 1, size)):
                        raw = bytes(whole[4 * (a + begin) : 4 * min(a + begin + n, b)])
                        if a + begin + n > b:
                            raw += int(end_id).to_bytes(4, "little")
                        rows.append((at + k, j, begin, n, zlib.crc32(raw)))
                        if keep_ids:
                            out_ids.append(np.frombuffer(raw, "<u4").astype(np.int32))
                        begin += n
                doc, piece, start, length, crc = zip(*rows, strict=True) if rows else [()] * 5
                at += len(offsets) - 1
                data = {"doc_id": names.take(pa.array(doc, pa.int64())), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
                if keep_ids:
                    data["ids"] = pa.array(out_ids, pa.list_(pa.int32()))
                yield from pa.table(data).to_batches()

    kind = next(f.dataType.simpleString() for f in source.schema if f.name == "doc_id")
    return in_arrow(source, run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * keep_ids, encodes=True)


def pack(pieces: DataFrame, size: int, packer_pieces: int = PACKER_PIECES) -> DataFrame:
    """``pieces`` with sequence_id and offset: all of its columns must be plain ones.

    Full pieces need no packer: each is a sequence. The others are dealt by hash.
    """
    spark = pieces.sparkSession
    kept, _ = materialize(pieces, "pieces")
    packers = max(1, -(-kept.where(F.col("length") < size).count() // packer_pieces))
    short = kept.where(F.col("length") < size).withColumn("packer", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "start", F.monotonically_increasing_id()), F.lit(packers)).cast("int"))
    names = pieces.columns

    def run(table: pa.Table) -> pa.Table:
        order = table.sort_by([("length", "ascending"), ("doc_id", "ascending"), ("piece", "ascending")])
        lengths = order.column("length").to_numpy()
        counts = np.bincount(lengths, minlength=size + 1)
        nexts = (np.cumsum(counts) - counts).tolist()  # the next piece of each length in ``order``
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        base = int(order.column("packer")[0].as_py()) << 36
        for k, content in enumerate(pack_lengths(counts, size)):
            place = 0
            for n in content:
                i = nexts[n]
                nexts[n] += 1
                sequence[i], offset[i] = base + 2 * k, place
                place += n
        return order.select(names).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id bigint, offset bigint"
    packed = short.groupBy("packer").applyInArrow(run, schema)
    full = kept.where(F.col("length") == size).select(*names, (F.monotonically_increasing_id() * 2 + 1).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    return packed.unionByName(full)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids: the token ids of each sequence; needs pieces with ids. A sequence is bounded, so is its group."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
