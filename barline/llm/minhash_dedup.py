"""MinHash near-dedup with tensored banding and full verification.

Two collections of small minhash groups are computed (LEFT groups of LEFT_ROWS
values, RIGHT groups of RIGHT_ROWS); every pair of a left and a right group is the
key of a table. So LEFT x RIGHT tables of keys come from LEFT*LEFT_ROWS +
RIGHT*RIGHT_ROWS minhashes, about the square root of what separate tables need.

Texts with equal sets are one node. In each bucket all nodes are compared with
the least one; what is confirmed on full sets forms components. Then, in
buckets that still hold more than one component, pairs across components are
compared (each pair once, in the first table that both share); a hot bucket is
compared in blocks over many tasks. A sketch rules out pairs that cannot reach
the threshold; the others are confirmed on full sets.

Defined results: null texts, and texts without words, have empty sets and are
linked with nothing; a text of fewer words than a shingle has one shingle.
Repeated rows (also of one id) are documents of their own. Null ids never are a
component's id unless all of its ids are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm import shingles as sh
from barline.llm.common import in_arrow, map_batches, materialize, remove_path
from barline.llm.components import components

LEFT, LEFT_ROWS, RIGHT, RIGHT_ROWS = 13, 3, 9, 2
HASHES = LEFT * LEFT_ROWS + RIGHT * RIGHT_ROWS
BINS = 512
#: Pairs that are compared at once, and rows of buckets that are looked at together.
PAIRS_AT_ONCE, ROWS_AT_ONCE = 60_000, 4096
#: Nodes of a bucket that one task compares with as many others.
BLOCK = 1024
#: Bits of the map of wanted sets (16 MB), and digests that a task remembers to send a set once.
BITMAP, SEEN = 1 << 27, 200_000


def _fixed(values: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    raw = np.ascontiguousarray(values)
    width = raw.shape[1] * raw.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(raw), [None, pa.py_buffer(raw.tobytes())]).cast(pa.binary()) if len(raw) else pa.array([], pa.binary())


def _matrix(column: pa.Array | pa.ChunkedArray, kind: str) -> np.ndarray:
    """The rows of a binary column of equal widths as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1) if len(column) else np.zeros((0, 1), kind)


def _sketched(docs: DataFrame, id_column: str, text_column: str, size: int) -> DataFrame:
    text = F.col(text_column).cast("string")
    source = docs.select(F.col(id_column).alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("doc_key"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in sh.slices(batch.column("text")):
                sets, offsets = sh.shingle_sets(texts, size)
                signature = (sh.minhashes(sets, offsets, HASHES) & np.uint32(0xFFFF)).astype(np.uint16)
                yield pa.RecordBatch.from_pydict({**{c: batch.column(c).slice(at, len(texts)) for c in ("doc_id", "doc_key")}, "n_shingles": pa.array(np.diff(offsets)), "digest": pa.array(sh.digests(sets, offsets), pa.binary()), "signature": _fixed(signature), "sketch": _fixed(sh.bin_sketch(sets, offsets, BINS))})
                at += len(texts)

    kind = next(f.dataType.simpleString() for f in source.schema if f.name == "doc_id")
    return in_arrow(source, run, f"doc_id {kind}, doc_key bigint, n_shingles bigint, digest binary, signature binary, sketch binary")


def group_keys(signature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, LEFT) and (nodes, RIGHT) 64-bit keys of the minhash groups."""
    s = signature.astype(np.uint64)

    def combined(first: int, groups: int, rows: int) -> np.ndarray:
        out = np.zeros((len(s), groups), np.uint64)
        for g in range(groups):
            for j in range(first + g * rows, first + (g + 1) * rows):
                out[:, g] = sh.mix(out[:, g] * np.uint64(31) + s[:, j] + np.uint64(j + 1))
        return out

    return combined(0, LEFT, LEFT_ROWS), combined(LEFT * LEFT_ROWS, RIGHT, RIGHT_ROWS)


def _table_rows(nodes: DataFrame) -> DataFrame:
    def run(batch: pa.RecordBatch) -> dict:
        left, right = group_keys(_matrix(batch.column("signature"), "<u2"))
        keys = sh.mix(left[:, :, None] * np.uint64(3) + right[:, None, :]).reshape(-1) if len(left) else np.zeros(0, np.uint64)
        return {"key": pa.array(keys.view(np.int64)), "node": pa.array(np.repeat(batch.column("node").to_numpy(), LEFT * RIGHT))}

    return map_batches(nodes.select("node", "signature"), run, "key bigint, node bigint")


def _buckets(rows: DataFrame) -> DataFrame:
    """key, node, center (the least node) of buckets of two nodes and more; streams over sorted rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, center, told = None, None, True  # of the open bucket; told: its center has been given out
        for batch in batches:
            k, v = batch.column("key").to_numpy(), batch.column("node").to_numpy()
            if not len(k):
                continue
            new = np.ones(len(k), bool)
            new[1:] = k[1:] != k[:-1]
            new[0] = key is None or k[0] != key
            heads = np.flatnonzero(new)
            group = np.cumsum(new) - 1  # -1: goes on with the open bucket
            centers = np.where(group >= 0, v[heads[np.maximum(group, 0)]] if len(heads) else 0, center if center is not None else 0)
            member = ~new
            out_k, out_v, out_c = k[member], v[member], centers[member]
            with_members = np.unique(group[member])
            own = heads[with_members[with_members >= 0]]
            extra = [(key, center, center)] if len(with_members) and with_members[0] == -1 and not told else []
            late = np.array(extra, np.int64).reshape(-1, 3)  # typed: an empty list would turn keys into floats
            out_k = np.concatenate([out_k, k[own], late[:, 0]])
            out_v = np.concatenate([out_v, v[own], late[:, 1]])
            out_c = np.concatenate([out_c, v[own], late[:, 2]])
            last_known = not len(heads) or (len(with_members) > 0 and with_members[-1] == len(heads) - 1)
            told = (told or bool(extra)) if not len(heads) else last_known
            key = k[-1]
            center = center if not len(heads) else v[heads[-1]]
            yield pa.RecordBatch.from_pydict({"key": pa.array(out_k), "node": pa.array(out_v), "center": pa.array(out_c)})

    return in_arrow(rows.repartition("key").sortWithinPartitions("key", "node"), run, "key bigint, node bigint, center bigint")


def _possible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) that sketches do not rule out."""
    a = nodes.select(F.col("node").alias("u"), F.col("n_shingles").alias("nu"), F.col("sketch").alias("su"))
    b = nodes.select(F.col("node").alias("v"), F.col("n_shingles").alias("nv"), F.col("sketch").alias("sv"))
    joined = pairs.join(a, "u").join(b, "v").select("u", "v", "nu", "nv", "su", "sv")

    def run(batch: pa.RecordBatch) -> dict:
        ok = sh.may_link(_matrix(batch.column("su"), "u1"), batch.column("nu").to_numpy(), _matrix(batch.column("sv"), "u1"), batch.column("nv").to_numpy(), percent) if batch.num_rows else np.zeros(0, bool)
        return {c: batch.column(c).filter(pa.array(ok)) for c in ("u", "v")}

    return map_batches(joined, run, "u bigint, v bigint")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) with 100 * intersection >= percent * union of their full sets."""
    a, b = sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), sets.select(F.col("node").alias("v"), F.col("shingles").alias("b"))

    def run(batch: pa.RecordBatch) -> dict:
        ok = []
        for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(p, q, assume_unique=True))
            ok.append(100 * both >= percent * (len(p) + len(q) - both))
        return {c: batch.column(c).filter(pa.array(ok, pa.bool_())) for c in ("u", "v")}

    return map_batches(pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b"), run, "u bigint, v bigint")


def _across(buckets: DataFrame, parts: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Possible pairs of different components in a bucket, each in the first table that both share."""
    rows = buckets.select("key", "node").join(parts, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    mixed = rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size")).where("low < high").select("key", "size")
    blocks = F.ceil(F.col("size") / F.lit(BLOCK)).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = (
        rows.join(mixed, "key")
        .withColumn("blocks", blocks)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "component")
        .join(nodes.select("node", "n_shingles", "signature", "sketch"), "node")
        .repartition("key", "i", "j")
        .sortWithinPartitions("key", "i", "j", "node")
    )

    columns = ("key", "i", "j", "own", "node", "component", "n_shingles")

    def compare(flat: dict[str, np.ndarray], signature: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Possible pairs of whole groups of (key, i, j), which lie one after the other."""
        key, i, j, own, node, part, n = (flat[c] for c in columns)
        rows = len(key)
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        end = np.append(np.flatnonzero(new)[1:], rows)[np.cumsum(new) - 1]
        left, right = group_keys(signature)
        partners = end - 1 - np.arange(rows)
        before = np.concatenate([[0], np.cumsum(partners)])
        us, vs = [], []
        low = 0
        while low < rows:
            high = max(low + 1, int(np.searchsorted(before, before[low] + PAIRS_AT_ONCE, "right")) - 1)
            count = partners[low:high]
            x = np.repeat(np.arange(low, high), count)
            y = x + 1 + np.arange(len(x)) - np.repeat(before[low:high] - before[low], count)
            low = high
            ok = (part[x] != part[y]) & ((i[x] == j[x]) | (own[x] != own[y])) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
            x, y = x[ok], y[ok]
            # The first table that both share, so that a pair is looked at once.
            l, r = (left[x] == left[y]).argmax(axis=1), (right[x] == right[y]).argmax(axis=1)
            ok = sh.mix(left[x, l] * np.uint64(3) + right[x, r]).view(np.int64) == key[x]
            x, y = x[ok], y[ok]
            ok = sh.may_link(sketch[x], n[x], sketch[y], n[y], percent) if len(x) else np.zeros(0, bool)
            us.append(node[x[ok]])
            vs.append(node[y[ok]])
        u, v = np.concatenate(us), np.concatenate(vs)
        return np.minimum(u, v), np.maximum(u, v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Streams; a group has at most about two blocks, so what is held is bounded."""
        held: list[pa.RecordBatch] = []

        def give(table: pa.Table) -> pa.RecordBatch:
            u, v = compare({c: table.column(c).to_numpy() for c in columns}, _matrix(table.column("signature"), "<u2"), _matrix(table.column("sketch"), "u1"))
            return pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                held.append(batch.slice(at, ROWS_AT_ONCE))
                table = pa.Table.from_batches(held)
                k, i, j = (table.column(c).to_numpy() for c in ("key", "i", "j"))
                cut = int(np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))[-1])
                if cut:
                    yield give(table.slice(0, cut))
                    held = table.slice(cut).combine_chunks().to_batches()
        if held:
            yield give(pa.Table.from_batches(held))

    return in_arrow(dealt, run, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept (doc_id is the component's id) for every row."""
    return grouped(docs, shingle_words, percent, id_column, text_column).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_first(docs: DataFrame, shingle_words: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of each component, of its least id, with all columns of ``docs``; rows equal in id and text count once."""
    firsts = grouped(docs, shingle_words, percent, id_column, text_column).where("first").select(F.col("doc_id").alias("__id"), F.col("doc_key").alias("__key")).distinct()
    keyed = docs.withColumns({"__own": F.col(id_column), "__own_key": F.xxhash64(F.coalesce(F.col(text_column).cast("string"), F.lit("")))})
    return keyed.join(firsts, F.col("__own").eqNullSafe(F.col("__id")) & (F.col("__own_key") == F.col("__key")), "left_semi").dropDuplicates(["__own", "__own_key"]).select(*docs.columns)


def grouped(docs: DataFrame, shingle_words: int, percent: int, id_column: str, text_column: str) -> DataFrame:
    """doc_id, doc_key (hash of the text), n_shingles, component_id, first (its component's row that stays) for every row."""
    spark = docs.sparkSession
    rows, _ = materialize(_sketched(docs, id_column, text_column, shingle_words), "sketches")
    by_digest = rows.where("n_shingles > 0").groupBy("digest").agg(F.min(F.struct(F.coalesce(F.col("doc_id").isNull(), F.lit(True)).alias("null"), "doc_id", "doc_key")).alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"), F.first("sketch").alias("sketch"))
    nodes, _ = materialize(by_digest.select(F.monotonically_increasing_id().alias("node"), "*"), "nodes")
    buckets, _ = materialize(_buckets(_table_rows(nodes)), "buckets")
    stars, stars_path = materialize(_possible(buckets.where("node <> center").select(F.col("center").alias("u"), F.col("node").alias("v")).distinct(), nodes, percent), "stars-possible")
    wanted = buckets.select("node").distinct()
    sets, _ = materialize(_sets(docs, id_column, text_column, shingle_words, nodes.join(wanted, "node", "left_semi").select("node", "digest")), "sets")
    edges, _ = materialize(_confirmed(stars, sets, percent), "edges")
    parts, _ = materialize(components(edges), "parts")
    more, _ = materialize(_confirmed(_across(buckets, parts, nodes, percent).distinct(), sets, percent), "edges")
    if not more.isEmpty():
        parts, _ = materialize(components(edges.union(more)), "parts")
    remove_path(spark, stars_path)
    placed = nodes.select("digest", "node", "rep").join(parts, "node", "left").select("digest", "rep", F.coalesce("component", "node").alias("component"))
    least = placed.groupBy("component").agg(F.min("rep").alias("least"))
    named = placed.join(least, "component").select("digest", "least")
    empty = F.col("n_shingles") == 0
    return (
        rows.select("doc_id", "doc_key", "n_shingles", "digest")
        .join(named, "digest", "left")
        .select(
            "doc_id",
            "doc_key",
            "n_shingles",
            F.when(empty, F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("component_id"),
            (empty | (F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("doc_key") == F.col("least.doc_key")))).alias("first"),
        )
    )


def _bitmap(wanted: DataFrame) -> np.ndarray:
    """A bit for each hash of a wanted digest: BITMAP bits whatever their number, aggregated by the executors."""
    place = F.pmod(F.expr("xxhash64(digest)"), F.lit(BITMAP))
    words = wanted.select(F.floor(place / 64).cast("long").alias("word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(digest), {BITMAP}) % 64 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(BITMAP // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out


def _sets(docs: DataFrame, id_column: str, text_column: str, size: int, wanted: DataFrame) -> DataFrame:
    """node, shingles (64-bit hashes, ascending) of the wanted nodes (node, digest), from the texts.

    A bitmap of bounded size keeps most other sets from being shuffled; the join decides.
    """
    source = docs.select(F.col(text_column).cast("string").alias("text"))
    bits = source.sparkSession.sparkContext.broadcast(_bitmap(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for texts in sh.slices(batch.column("text")):
                sets, offsets = sh.shingle_sets(texts, size)
                digests = sh.digests(sets, offsets)
                place = np.array([spark_xxhash64(d) for d in digests], np.uint64) % np.uint64(BITMAP)
                there = (bits.value[(place >> np.uint64(6)).astype(np.int64)].view(np.uint64) >> (place & np.uint64(63))) & np.uint64(1)
                chosen = []
                for k in np.flatnonzero(there):
                    if digests[k] not in seen:
                        seen.add(digests[k])
                        chosen.append(k)
                if len(seen) > SEEN:
                    seen.clear()
                raw = memoryview(np.ascontiguousarray(sets).tobytes())
                yield pa.RecordBatch.from_pydict({"digest": pa.array([digests[k] for k in chosen], pa.binary()), "shingles": pa.array([bytes(raw[8 * offsets[k] : 8 * offsets[k + 1]]) for k in chosen], pa.binary())})

    every = in_arrow(source, run, "digest binary, shingles binary").groupBy("digest").agg(F.first("shingles").alias("shingles"))
    return every.join(wanted, "digest").select("node", "shingles")


def spark_xxhash64(value: bytes) -> int:
    """What Spark's xxhash64 says of one binary value, modulo 2**64 (its seed is 42)."""
    return xxhash.xxh64_intdigest(value, seed=42)
