"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint has 64 bits: bit i is 1 if it is set in over half of the hashes
(XXH64, seed 42) of a text's word shingles, repeats included. Texts link where
their fingerprints differ in at most ``reach`` bits.

Equal fingerprints are one node. The 64 bits fall into partitions of correlated
bits. Thresholds t_i of the partitions with sum(t_i + 1) = reach + 1 are enough: two
fingerprints within ``reach`` differ in at most t_i bits of some partition i, or
they'd differ in more than ``reach`` altogether. A threshold of -1 leaves a partition
out. Each fingerprint gets its own thresholds, by dynamic programming on the
candidates that each partition is estimated to give; it looks its own values (and those
within the threshold) up among all values of all fingerprints, and what is met is
verified on whole fingerprints.

A value that very many fingerprints share would compare all of them with each other.
Fingerprints that meet such a value are instead dealt to all fingerprints within half the reach
of them: those that meet at one are within ``reach``, those within ``reach`` meet at one,
and at most 65 meet at any (for a reach of 2).

Defined results: null and blank texts have fingerprint zero and are linked like any other;
texts with fewer words than a shingle have one shingle, the whole sequence; documents without an
id get their component's least id, null if no member has one; repeated rows are nodes of one
fingerprint; no rows give no rows. Other columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.llm.common import Scratch, in_arrow
from barline.llm.components import components
from barline.llm.shingles import slices
from barline.llm.words import word_runs

BITS = 64
#: Hashes whose bits are counted at once.
AT_ONCE = 1 << 18
#: Bits of a partition that the estimate takes together; parts of a partition count as independent.
BLOCK_BITS = 11
#: Fingerprints that a value may have before it is met through neighbours: about 2,000 a partition's value.
HOT = 2000
#: A looked-up value costs as much as so many candidates.
PROBE_COST = 4.0

#: For each byte a word of 64 bits with one counter of 8 bits for each of its bits.
_SPREAD = np.array([sum(((v >> j) & 1) << (8 * j) for j in range(8)) for v in range(256)], np.uint64)


def _add_bits(counts: np.ndarray, hashes: np.ndarray, sizes: np.ndarray) -> None:
    """Adds to ``counts`` (texts, 64) how often each bit is set in the texts' hashes, which follow each other."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    # Counters of 8 bits hold 255 hashes: longer texts are cut.
    cuts = np.unique(np.concatenate([starts[sizes > 0], *[np.arange(s, e, 255) for s, e in zip(starts[sizes > 255], ends[sizes > 255], strict=True)]])).astype(np.int64)
    packed = np.add.reduceat(_SPREAD[hashes.view(np.uint8).reshape(-1, 8)], cuts, axis=0)
    owner = np.searchsorted(ends, cuts, "right")
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    counts[owner[first]] += np.add.reduceat(packed.view(np.uint8).reshape(-1, BITS).astype(np.int64), first, axis=0)


def text_hashes(text: bytes, size: int) -> Iterator[np.ndarray]:
    """XXH64 of a text's shingles, a bounded number at a time."""
    tail: list[bytes] = []
    seen = False
    for words in word_runs(text.lower()):  # on bytes: A-Z alone
        words = tail + words
        if len(words) >= size:
            seen = True
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            starts = np.concatenate([[0], ends[:-1]])
            spans = zip(starts[: len(words) - size + 1].tolist(), (ends[size - 1 :] - 1).tolist(), strict=True)
            yield np.fromiter((xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in spans), np.uint64, len(words) - size + 1)
        tail = words[-(size - 1) :] if size > 1 else []
    if tail and not seen:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(tail), 42)], np.uint64)


def fingerprints(texts: pa.Array, size: int = 3) -> np.ndarray:
    """Unsigned 64-bit fingerprints of texts."""
    out = []
    for part in slices(texts):
        counts, totals = np.zeros((len(part), BITS), np.int64), np.zeros(len(part), np.int64)
        held, owners, waiting = [], [], 0

        def settle() -> None:
            if held:
                _add_bits(counts, np.concatenate(held), np.bincount(owners, [len(h) for h in held], len(part)).astype(np.int64))  # noqa: B023

        for i, text in enumerate(part):
            for hashes in text_hashes(text.as_buffer().to_pybytes() if text.is_valid else b"", size):
                totals[i] += len(hashes)
                held.append(hashes)
                owners.append(i)
                waiting += len(hashes)
                if waiting > AT_ONCE:
                    settle()
                    held, owners, waiting = [], [], 0
        settle()
        out.append(np.packbits(2 * counts > totals[:, None], axis=1, bitorder="little").view(np.uint64).ravel())
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def with_fingerprints(docs: DataFrame, text: str, id_column: str, size: int) -> DataFrame:
    """id, fp (a signed long) of each document."""
    asked = docs.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("text"))
    kind = asked.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints(batch.column(1), size).view(np.int64))], ["id", "fp"])

    return in_arrow(asked, run, f"id {kind}, fp bigint")


def _unpacked(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _tallied(nodes: DataFrame, cells: int, count) -> tuple[np.ndarray, int]:
    """Sums over all fingerprints of ``count(fps)``, a vector of ``cells`` numbers; the last cell is their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells + 1, np.int64)
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for low in range(0, len(fps), AT_ONCE):
                total[:-1] += count(fps[low : low + AT_ONCE])
            total[-1] += len(fps)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["cell", "n"])

    rows = in_arrow(nodes.select("fp"), run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(cells + 1, np.int64)
    out[rows["cell"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out[:-1], int(out[-1])


def correlations(nodes: DataFrame) -> tuple[np.ndarray, int]:
    """Correlation of each pair of bits over all fingerprints, and their number."""

    def count(fps: np.ndarray) -> np.ndarray:
        bits = _unpacked(fps).astype(np.float32)  # sums below 2^24 are exact
        return (bits.T @ bits).astype(np.int64).ravel()

    both, n = _tallied(nodes, BITS * BITS, count)
    both = both.reshape(BITS, BITS) / max(n, 1)
    share = np.diag(both)
    spread = np.sqrt(share * (1 - share))
    scale = np.outer(spread, spread)
    return np.where(scale > 0, (both - np.outer(share, share)) / np.where(scale > 0, scale, 1), 0.0), n


def partition_count(n: int, reach: int) -> int:
    """As many partitions (at most reach + 2, so that one can be left out) as leave some eight fingerprints a value, were values even."""
    wide = np.log2(max(n, 1) / 8)
    return next((m for m in range(reach + 2, 1, -1) if BITS // m >= wide), 1)


def group_bits(correlation: np.ndarray, m: int) -> list[list[int]]:
    """``m`` groups of bits: each begins with the most correlated pair left and takes the bit most correlated with it."""
    strength = np.abs(correlation)
    np.fill_diagonal(strength, 0.0)
    left, out = list(range(BITS)), []
    for k in range(m):
        width = BITS // m + (k < BITS % m)
        among = strength[np.ix_(left, left)]
        group = [left[np.unravel_index(int(np.argmax(among)), among.shape)[0]]]
        left.remove(group[0])
        while len(group) < width:
            best = left[int(np.argmax(strength[np.ix_(left, group)].sum(axis=1)))]
            group.append(best)
            left.remove(best)
        out.append(group)
    return out


def values_of(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    """The fingerprints' bits ``bits`` as numbers."""
    out = np.zeros(len(fps), np.uint64)
    for j, b in enumerate(bits):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)) << np.uint64(j)
    return out


class Estimate:
    """How many fingerprints lie within 0 .. reach bits of a value of a partition.

    Blocks of a partition's bits are counted over all fingerprints (at most 2^11
    counts a block); a block's counts at distance 1 and on are sums over its values, and blocks
    of a partition count as independent.
    """

    def __init__(self, nodes: DataFrame, groups: list[list[int]], n: int, reach: int) -> None:
        self.groups, self.n, self.reach = groups, n, reach
        self.blocks = [[list(b) for b in np.array_split(g, -(-len(g) // BLOCK_BITS))] for g in groups]
        flat = [b for bs in self.blocks for b in bs]
        begins = np.concatenate([[0], np.cumsum([1 << len(b) for b in flat])]).astype(np.int64)

        def count(fps: np.ndarray) -> np.ndarray:
            return np.concatenate([np.bincount(values_of(fps, b).astype(np.int64), minlength=1 << len(b)) for b in flat])

        told, _ = _tallied(nodes, int(begins[-1]), count)
        shares = iter([self._by_distance(told[a:b] / max(n, 1)) for a, b in zip(begins[:-1], begins[1:], strict=True)])
        self.shares = [[next(shares) for _ in bs] for bs in self.blocks]

    def _by_distance(self, share: np.ndarray) -> np.ndarray:
        values, bits = np.arange(len(share)), int(len(share)).bit_length() - 1
        return np.stack([sum((share[values ^ sum(1 << b for b in flips)] for flips in combinations(range(bits), d)), np.zeros(len(share))) for d in range(self.reach + 1)], axis=1)

    def within(self, fps: np.ndarray, partition: int) -> np.ndarray:
        """(fingerprints, reach + 1): estimated candidates within 0 .. reach bits."""
        told = None
        for bits, share in zip(self.blocks[partition], self.shares[partition], strict=True):
            one = share[values_of(fps, bits).astype(np.int64)]
            told = one if told is None else np.stack([sum(told[:, k] * one[:, d - k] for k in range(d + 1)) for d in range(self.reach + 1)], axis=1)
        return self.n * np.cumsum(told, axis=1)


def looked_up(width: int, threshold: int) -> int:
    """Values within ``threshold`` bits of a value."""
    return sum(len(list(combinations(range(width), d))) for d in range(threshold + 1))


def thresholds(fps: np.ndarray, estimate: Estimate) -> np.ndarray:
    """(fingerprints, partitions): the thresholds of least estimated cost whose sum of t + 1 is reach + 1."""
    units = estimate.reach + 1
    best, chosen = np.full((len(fps), units + 1), np.inf), []
    best[:, 0] = 0.0
    for i, group in enumerate(estimate.groups):
        cost = np.concatenate([np.zeros((len(fps), 1)), estimate.within(fps, i) + PROBE_COST * np.array([looked_up(len(group), t) for t in range(units)])], axis=1)
        ways = np.stack([np.stack([best[:, total - take] + cost[:, take] if take <= total else np.full(len(fps), np.inf) for take in range(units + 1)], axis=1) for total in range(units + 1)], axis=1)
        chosen.append(np.argmin(ways, axis=2))
        best = np.take_along_axis(ways, chosen[-1][:, :, None], axis=2)[:, :, 0]
    out, left, rows = np.zeros((len(fps), len(chosen)), np.int64), np.full(len(fps), units), np.arange(len(fps))
    for i in range(len(chosen) - 1, -1, -1):
        out[:, i] = chosen[i][rows, left] - 1
        left = left - out[:, i] - 1
    return out


def _values(nodes: DataFrame, estimate: Estimate, probes: bool) -> DataFrame:
    """part, value, fp: each fingerprint under its value in each partition, or (``probes``) under what it looks up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            chosen = thresholds(fps, estimate) if probes else np.zeros((len(fps), len(estimate.groups)), np.int64)
            for i, group in enumerate(estimate.groups):
                value = values_of(fps, group)
                for d in range(int(chosen[:, i].max(initial=-1)) + 1):
                    near = chosen[:, i] >= d
                    mine = pa.array(fps[near].view(np.int64))
                    for flips in combinations(range(len(group)), d):
                        mask = np.uint64(sum(1 << b for b in flips))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(mine), i, np.int32)), pa.array((value[near] ^ mask).view(np.int64)), mine], ["part", "value", "fp"])

    return in_arrow(nodes.select("fp"), run, "part int, value bigint, fp bigint")


def _neighbours(fps: DataFrame, reach: int) -> DataFrame:
    """u, v: links of all of ``fps`` within ``reach`` bits, through fingerprints within half the reach of both.

    For an even reach. Those that meet at one are each within half the reach of it, so
    at most (of 64 bits, for a reach of 2) 65 of them, and link to the least of them.
    """
    flips = [sum(1 << b for b in bits) for d in range(reach // 2 + 1) for bits in combinations(range(BITS), d)]
    masks = F.array(*[F.lit(x - (1 << BITS) if x >> 63 else x).cast("bigint") for x in flips])
    met = fps.select("fp", F.explode(F.transform(masks, lambda x: F.col("fp").bitwiseXOR(x))).alias("at"))
    return met.select("fp", F.min("fp").over(Window.partitionBy("at")).alias("v")).where("fp <> v").select(F.col("fp").alias("u"), "v")


def links(nodes: DataFrame, scratch: Scratch, reach: int = 2, hot: int = HOT, partitions: int | None = None) -> DataFrame:
    """u, v: fingerprints of ``nodes`` (fp, distinct) within ``reach`` bits, enough to join what is joined by all such links.

    For a reach of 2, or another even one.
    """
    if reach < 2 or reach % 2:
        raise ValueError("the reach must be an even number of bits")
    correlation, n = correlations(nodes)
    estimate = Estimate(nodes, group_bits(correlation, partitions or partition_count(n, reach)), n, reach)
    index, probes = scratch.table(_values(nodes, estimate, False), "values"), scratch.table(_values(nodes, estimate, True), "probes")
    shared = scratch.table(index.groupBy("part", "value").count().where(F.col("count") > hot).select("part", "value"), "shared")
    met = index.join(shared, ["part", "value"], "left_semi").select("fp").union(probes.join(shared, ["part", "value"], "left_semi").select("fp")).distinct()
    apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("other")))
    pairs = index.withColumnRenamed("fp", "other").join(shared, ["part", "value"], "left_anti").join(probes, ["part", "value"]).where((F.col("fp") > F.col("other")) & (apart <= reach))
    return pairs.select(F.col("fp").alias("u"), F.col("other").alias("v")).union(_neighbours(met, reach))


def near_duplicates(docs: DataFrame, text: str = "text", id_column: str = "doc_id", size: int = 3, reach: int = 2, hot: int = HOT, partitions: int | None = None) -> DataFrame:
    """id, fingerprint (16 hexadecimal digits), component_id (the least id reachable), kept (it is that one) of each document."""
    scratch = Scratch(docs.sparkSession)
    found = scratch.table(with_fingerprints(docs, text, id_column, size), "fingerprints")
    nodes = scratch.table(found.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    joined = components(links(nodes, scratch, reach, hot, partitions))
    named = nodes.join(joined, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    told = named.select("fp", "component").join(least, "component").select("fp", "component_id")
    out = found.join(told, "fp").select(F.col("id").alias(id_column), hexadecimal("fp").alias("fingerprint"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
    return scratch.table(out, "near-duplicates")


def hexadecimal(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
