"""Vectors as short codes: a codebook a part, nearest entries found by a VA-file.

A component x counts as the integer floor(1024 x). A vector is cut into equal consecutive
parts; each part's position has a codebook. It starts as that part of the vectors of
the least ids; a round assigns each part to its nearest entry (squared Euclidean
distance, ties to the lower index) and moves each entry to the floor of its parts'
means; entries without parts stay.

Entries are held as a VA-file: each coordinate by the cell of a few bits it falls in.
A part's lookup tables give, for each coordinate and cell, the least and the greatest
squared difference; summed over the coordinates they bound the distance to each
entry. Entries whose lower bound lies above the least upper bound are out; the others are
refined with integer distances. Sums are integers throughout, so results do not depend
on how rows are dealt.

Defined results: vectors that are null or hold null or non-finite components are left out, and so are those
of another length than the kept vector of the least id (a positive multiple of the parts);
fewer vectors than entries make smaller codebooks; rows without an id come last in order; equal ids are
ordered by their vectors; null labels are one label; no vectors give no rows. A component so large that squared
distances could pass 63 bits raises an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.llm.common import Scratch, in_arrow

#: Bits of a coordinate's cell.
CELL_BITS = 4
#: Parts whose bounds are taken at once.
AT_ONCE = 512
#: Labels whose sums are broadcast (a number and a label each); more of them are joined by salted shuffles.
BROADCAST_LABELS = 100_000
SALTS = 32
SCALE = 1024


class VaFile:
    """The entries of a codebook (entries x coordinates, integers) by their cells."""

    def __init__(self, entries: np.ndarray, bits: int = CELL_BITS) -> None:
        self.entries = entries
        k, d = entries.shape
        cells = min(1 << bits, max(k, 1))
        # Cells of about equal numbers of entries; each is as wide as the entries in it.
        place = np.empty((k, d), np.int64)
        np.put_along_axis(place, np.argsort(entries, axis=0, kind="stable"), np.arange(k)[:, None].repeat(d, axis=1), axis=0)
        self.cell = place * cells // max(k, 1)
        self.low = np.full((d, cells), np.iinfo(np.int64).max)
        self.high = np.full((d, cells), np.iinfo(np.int64).min)
        for j in range(d):
            np.minimum.at(self.low[j], self.cell[:, j], entries[:, j])
            np.maximum.at(self.high[j], self.cell[:, j], entries[:, j])

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each part's nearest entry (the lower one of equals), and the squared distance."""
        code, error = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64)
        for begin in range(0, len(parts), AT_ONCE):
            some = slice(begin, begin + AT_ONCE)
            code[some], error[some] = self._nearest(parts[some])
        return code, error

    def _bounds(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entries, parts): lower and upper bounds of the squared distances, summed from each part's lookup tables."""
        widest = int(max(np.abs(parts).max(), np.abs(self.entries).max())) if parts.size else 0
        kind = np.int32 if self.entries.shape[1] * (2 * widest) ** 2 < 1 << 31 else np.int64
        lower, upper = None, None
        for j in range(parts.shape[1]):
            x = parts[:, j].astype(kind)
            below, above = self.low[j][:, None].astype(kind) - x, x - self.high[j][:, None].astype(kind)  # (cells, parts)
            near = np.maximum(np.maximum(below, above), 0)
            far = np.maximum(-below, -above)  # the farther end of the cell
            near, far = near * near, far * far
            rows = self.cell[:, j]
            if lower is None:
                lower, upper = near[rows], far[rows]
            else:
                lower += near[rows]
                upper += far[rows]
        return lower, upper

    def _nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lower, upper = self._bounds(parts)
        row, entry = np.nonzero(np.ascontiguousarray((lower <= upper.min(axis=0)).T))
        apart = parts[row] - self.entries[entry]
        squared = (apart * apart).sum(axis=1)
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))  # each part has a candidate
        least = np.minimum.reduceat(squared, first)
        return np.minimum.reduceat(np.where(squared == least[row], entry, len(self.entries)), first), least


@dataclass(frozen=True)
class Codebooks:
    """(parts, entries, coordinates) integers."""

    entries: np.ndarray

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def kept_vectors(vectors: DataFrame, id_column: str, vector: str, also: tuple[str, ...] = ()) -> DataFrame:
    """id, vector and other columns of the rows whose vectors are there and finite."""
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.select(F.col(id_column).alias("id"), F.col(vector).alias("vector"), *[F.col(c).alias(f"with_{c}") for c in also]).where(F.col("vector").isNotNull() & finite)


def _integers(column: pa.Array, dims: int, scale: int) -> np.ndarray:
    """(rows, dims) integers floor(scale x) of a column of vectors."""
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dims) * scale)
    if x.size and dims * (2 * np.abs(x).max()) ** 2 >= 2.0**63:
        raise ValueError("a vector's components are too large: squared distances do not fit 63 bits")
    return x.astype(np.int64)


def _first(kept: DataFrame, parts: int, entries: int, scale: int) -> np.ndarray | None:
    """(entries, dims) integers of the vectors of the least ids; None without vectors."""
    order = [F.col("id").asc_nulls_last(), F.col("vector")]
    fits = (F.size("vector") > 0) & (F.size("vector") % parts == 0)
    least = kept.where(fits).orderBy(*order).select("vector").head()
    if least is None:
        return None
    rows = kept.where(F.size("vector") == len(least[0])).orderBy(*order).select("vector").limit(entries).toArrow().column(0).combine_chunks()
    return _integers(rows, len(least[0]), scale)


def _moved(kept: DataFrame, codebooks: np.ndarray, scale: int) -> np.ndarray:
    """The codebooks after one round: sums by part and entry, added up in each task first."""
    parts, entries, width = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = [VaFile(c) for c in codebooks]
        sums, counts = np.zeros(codebooks.shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            x = _integers(batch.column(0), parts * width, scale)
            for p, file in enumerate(files):
                part = x[:, p * width : (p + 1) * width]
                code, _ = file.nearest(part)
                order = np.argsort(code, kind="stable")
                used, first = np.unique(code[order], return_index=True)
                if len(used):
                    sums[p, used] += np.add.reduceat(part[order], first, axis=0)
                counts[p] += np.bincount(code, minlength=entries)
        p, e = np.nonzero(counts)
        cell = (p * entries + e).astype(np.int64)
        # A row a sum, and one of the number of parts in place -1.
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(cell, width + 1)), pa.array(np.tile(np.arange(-1, width), len(cell))), pa.array(np.concatenate([counts[p, e][:, None], sums[p, e]], axis=1).ravel())], ["cell", "place", "n"])

    told = in_arrow(kept.select("vector"), run, "cell bigint, place bigint, n bigint").groupBy("cell", "place").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect()
    counts = {r.cell: int(r.n) for r in told if r.place < 0}
    out = codebooks.copy()
    for r in told:
        if r.place >= 0:
            out[r.cell // entries, r.cell % entries, r.place] = int(r.n) // counts[r.cell]
    return out


def fit_codebooks(kept: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = SCALE) -> Codebooks | None:
    """Codebooks of ``kept`` (see :func:`kept_vectors`) after so many rounds over all of its vectors."""
    first = _first(kept, parts, entries, scale)
    if first is None:
        return None
    codebooks = np.ascontiguousarray(first.reshape(len(first), parts, -1).transpose(1, 0, 2))
    fitting = kept.where(F.size("vector") == first.shape[1])
    for _ in range(rounds):
        codebooks = _moved(fitting, codebooks, scale)
    return Codebooks(codebooks)


def encode(kept: DataFrame, codebooks: Codebooks, scale: int = SCALE) -> DataFrame:
    """The columns of ``kept`` but the vector, with code (two hexadecimal digits a part, four where there are more than 256 entries) and error."""
    parts, entries, width = codebooks.entries.shape
    digits = 2 if entries <= 256 else 4
    names = [c for c in kept.columns if c != "vector"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = [VaFile(c) for c in codebooks.entries]
        word = [format(e, f"0{digits}x") for e in range(entries)]
        for batch in batches:
            x = _integers(batch.column(batch.schema.get_field_index("vector")), parts * width, scale)
            found = [f.nearest(x[:, p * width : (p + 1) * width]) for p, f in enumerate(files)]
            code = ["".join(map(word.__getitem__, row)) for row in np.stack([c for c, _ in found], axis=1).tolist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in names], pa.array(code, pa.string()), pa.array(sum(e for _, e in found))], [*names, "code", "error"])

    kinds = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in names)
    return in_arrow(kept.where(F.size("vector") == parts * width), run, f"{kinds}, code string, error bigint")


def summed_over(rows: DataFrame, by: str, value: str, out: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over equal ``by`` (nulls are equal): sums are joined on, so no group of rows comes together."""
    sums = rows.groupBy(by).agg(F.sum(value).alias(out)).withColumnRenamed(by, "__by")
    if sums.count() <= BROADCAST_LABELS:
        return rows.join(F.broadcast(sums), F.col(by).eqNullSafe(F.col("__by")), "left").drop("__by")
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)))
    spread = sums.withColumn("__other", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(spread, F.col(by).eqNullSafe(F.col("__by")) & (F.col("__salt") == F.col("__other")), "left").drop("__by", "__salt", "__other")


def compress(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4) -> DataFrame:
    """id, code, error, label_error (the error over all vectors of the label), codebooks_sha256 of each vector kept."""
    spark = vectors.sparkSession
    kept = kept_vectors(vectors, id_column, vector, (label,))
    codebooks = fit_codebooks(kept, parts, entries, rounds)
    if codebooks is None:
        kind = vectors.schema[id_column].dataType.simpleString()
        return spark.createDataFrame([], f"`{id_column}` {kind}, code string, error bigint, label_error bigint, codebooks_sha256 string")
    coded = Scratch(spark).table(encode(kept, codebooks), "codes")
    return summed_over(coded, f"with_{label}", "error", "label_error").select(F.col("id").alias(id_column), "code", "error", "label_error", digest_column(codebooks))


def digest_column(codebooks: Codebooks) -> Column:
    return F.lit(codebooks.digest()).alias("codebooks_sha256")
