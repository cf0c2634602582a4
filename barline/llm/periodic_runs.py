"""Periodic runs of words: all lags of a text, vectorised.

A run is a longest stretch of consecutive words with smallest period q (words q apart are
identical) of at least max(6, 4 q) words. Words are ids; the ids are compared with themselves
shifted by each lag q up to a quarter of the words, and stretches of equality of at least
max(6 - q, 3 q) words are runs. A stretch as long as that covers three neighbouring multiples of
q, so a lag's comparison looks at each q-th word first and at the words around
only where three of them in a row are equal. All texts of a batch are compared at once, the longest first,
so that the texts that a lag still concerns are the first ones.

A stretch of lag q with a smaller period d has one that divides q and is then the very same
stretch (of at least 4 q words), so it's a run of d and none of q; what is known to have
period d isn't looked at again for the multiples of d.

Texts beyond ``LONG`` bytes are dealt as pairs of a document and a range of lags, so that
one text's lags are compared by many tasks; its runs come together afterwards.

Defined results: null, empty and blank texts have no words, no runs, and digests of nothing; rows may repeat, an
id may be null (then no tail is rewritten); no rows give no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.common import in_arrow
from barline.llm.words import word_runs

LEAST_WORDS, LEAST_TIMES = 6, 4
#: Bytes of texts whose words are compared at once.
AT_ONCE = 1 << 20
#: Bytes of a text from which on ranges of its lags are dealt out; a text of b bytes is dealt as sqrt(b / RANGE_BYTES) ranges.
LONG = 1 << 16
RANGE_BYTES = 1 << 13
#: Lags whose looks are few are taken together, about so many looks at once.
LOOKS = 1 << 16

Run = tuple[int, int, int]  # start, length, period


def word_ids(text: bytes) -> tuple[list[bytes], np.ndarray]:
    """Different words of a text by their ids, and the ids in order."""
    known: dict[bytes, int] = {}
    runs = [np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)) for words in word_runs(text)]
    return list(known), np.concatenate(runs) if runs else np.zeros(0, np.int64)


def smallest_period(x: np.ndarray, q: int) -> int:
    """The smallest period of ``x``, which has period ``q`` at least twice over: a divisor of it."""
    rest, f = q, 2
    while rest > 1:
        if f * f > rest:
            f = rest
        while rest % f == 0:
            rest //= f
            d = q // f
            if np.array_equal(x[d:], x[:-d]):
                q = d
        f += 1
    return q


def longest_lag(n: int) -> int:
    return n // LEAST_TIMES if n >= LEAST_WORDS else 0


class LagScan:
    """The runs of many texts, whose ids follow each other in ``ids`` and differ between texts.

    ``sizes`` (words of each text) fall. :meth:`runs` gives start (in ``ids``),
    length and period of runs whose period lies in a range of lags.
    """

    def __init__(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.ids, self.sizes = ids, sizes
        self.ends = np.cumsum(sizes)
        self.found: list[Run] = []
        self.known: dict[int, list[tuple[int, int, int]]] = {}  # of each text: begin, end, period

    def _concerned(self, q: int) -> int:
        """Words of the texts that are long enough for the lag."""
        texts = int(np.searchsorted(-self.sizes, -max(LEAST_WORDS, LEAST_TIMES * q), "right"))
        return int(self.ends[texts - 1]) if texts else 0

    def runs(self, low: int, high: int) -> list[Run]:
        q = low
        while q <= high and (m := self._concerned(q)):
            if m // q > LOOKS // 64:
                self._look(q, self.ids[0:m:q])
                q += 1
            else:  # few looks a lag: many lags as one ragged gather
                lags = np.arange(q, min(high, q + max(1, LOOKS * q // m), longest_lag(int(self.sizes[0]))) + 1)
                self._look_at_many(lags, m)
                q = int(lags[-1]) + 1
        return self.found

    def _look(self, q: int, seen: np.ndarray) -> None:
        equal = seen[1:] == seen[:-1]
        if q > 1:
            self._stretches(q, np.flatnonzero(equal[2:] & equal[1:-1] & equal[:-2]))
        else:  # each word is looked at
            ends = np.flatnonzero(np.diff(np.concatenate([[False], equal, [False]]).view(np.int8)))
            for a, b in zip(ends[::2].tolist(), ends[1::2].tolist(), strict=True):
                if b - a + 1 >= LEAST_WORDS:
                    self._add(a, b - a + 1, 1)

    def _look_at_many(self, lags: np.ndarray, m: int) -> None:
        counts = m // lags + (m % lags > 0)
        ends = np.cumsum(counts)
        lag = np.repeat(lags, counts)
        place = (np.arange(ends[-1]) - np.repeat(ends - counts, counts)) * lag
        seen = self.ids[place]
        equal = (seen[1:] == seen[:-1]) & (lag[1:] == lag[:-1])
        triple = np.flatnonzero(equal[2:] & equal[1:-1] & equal[:-2] & (lag[3:] == lag[:-3]))
        for q in np.unique(lag[triple]).tolist():
            if q == 1:
                self._look(1, self.ids[:m])
            else:
                self._stretches(q, place[triple[lag[triple] == q]] // q)

    def _stretches(self, q: int, triples: np.ndarray) -> None:
        """Verifies looks (numbers of multiples of q) from which on three in a row are equal."""
        if not len(triples):
            return
        cut = np.flatnonzero(np.diff(triples) > 1)
        for first, last in zip(triples[np.concatenate([[0], cut + 1])].tolist(), triples[np.concatenate([cut, [len(triples) - 1]])].tolist(), strict=True):
            text = int(np.searchsorted(self.ends, first * q, "right"))
            begin, end = int(self.ends[text] - self.sizes[text]), int(self.ends[text])
            a, b = first * q, (last + 3) * q  # equal at each multiple from a on, up to b
            if any(lo <= a and b <= hi and q % d == 0 for lo, hi, d in self.known.get(text, ())):
                continue
            low, high = max(begin, a - q + 1), min(end, b + q)
            equal = self.ids[low : high - q] == self.ids[low + q : high]
            edges = np.flatnonzero(np.diff(np.concatenate([[False], equal, [False]]).view(np.int8)))
            for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                length = e - s + q
                if length >= max(LEAST_WORDS, LEAST_TIMES * q):
                    start = low + s
                    d = smallest_period(self.ids[start : start + length], q)
                    if d == q:
                        self._add(start, length, q)
                    else:
                        self.known.setdefault(text, []).append((start, start + length, d))

    def _add(self, start: int, length: int, q: int) -> None:
        self.found.append((start, length, q))
        self.known.setdefault(int(np.searchsorted(self.ends, start, "right")), []).append((start, start + length, q))


def runs_of(ids: np.ndarray, low: int = 1, high: int | None = None) -> list[Run]:
    """Runs of one text by start, then period; ``low`` to ``high``: of these periods alone."""
    scan = LagScan(ids, np.array([len(ids)], np.int64))
    return sorted(scan.runs(low, longest_lag(len(ids)) if high is None else high), key=lambda r: (r[0], r[2]))


def runs_of_many(texts: list[np.ndarray]) -> list[list[Run]]:
    """Runs of each of many texts."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    sizes = np.array([len(texts[i]) for i in order], np.int64)
    begins = np.cumsum(sizes) - sizes
    above = np.cumsum([0, *[int(texts[i].max()) + 1 if len(texts[i]) else 0 for i in order]])
    ids = np.concatenate([texts[i] + above[k] for k, i in enumerate(order)]) if order else np.zeros(0, np.int64)
    out: list[list[Run]] = [[] for _ in texts]
    if len(ids):
        scan = LagScan(ids, sizes)
        for start, length, q in scan.runs(1, longest_lag(int(sizes[0]))):
            k = int(np.searchsorted(begins + sizes, start, "right"))
            out[order[k]].append((start - int(begins[k]), length, q))
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def with_tail(ids: np.ndarray, doc_id) -> np.ndarray:
    """The ids with the tail that the document's number asks for: repeats of a stretch, for one in ten."""
    n = len(ids)
    if doc_id is None or not n:
        return ids
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return ids
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    out = ids.copy()
    out[a:] = ids[a + np.arange(n - a) % p]
    return out


def collapsed(ids: np.ndarray, runs: list[Run]) -> np.ndarray:
    """Places of the words kept: a run keeps its first period."""
    dropped = np.zeros(len(ids) + 1, np.int64)
    for start, length, q in runs:
        dropped[start + q] += 1
        dropped[start + length] -= 1
    return np.flatnonzero(np.cumsum(dropped[:-1]) == 0)


def highest(runs: list[Run]) -> Run | None:
    """The run of the greatest length / period; ties: the smallest start, then period."""
    best = None
    for r in runs:
        if best is None or (r[1] * best[2], -r[0], -r[2]) > (best[1] * r[2], -best[0], -best[2]):
            best = r
    return best


def collapsed_text(words: list[bytes], ids: np.ndarray, runs: list[Run]) -> bytes:
    return b" ".join([words[i] for i in ids[collapsed(ids, runs)].tolist()]) if runs else b" ".join([words[i] for i in ids.tolist()])


SCHEMA = "n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"


def _digest(words: list[bytes], ids: np.ndarray, runs: list[Run]) -> tuple:
    best = highest(runs)
    told = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
    kept = hashlib.sha256(collapsed_text(words, ids, runs)).hexdigest()
    return (len(runs), *(best if best else (None, None, None)), 1000 * best[1] // best[2] if best else None, told, kept)


def _table(ids: list, rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(ids, kind), *[pa.array(c, pa.int64()) for c in columns[:5]], *[pa.array(c, pa.string()) for c in columns[5:]]], ["id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])


def _bytes(value: pa.Scalar) -> bytes:
    return value.as_buffer().to_pybytes() if value.is_valid else b""


def lag_ranges(n: int, parts: int) -> list[tuple[int, int]]:
    """Ranges of all lags of a text of ``n`` words with about equal numbers of looks, n / q for lag q; some may be empty."""
    last = longest_lag(n)
    cuts = [0, *[round((last + 1) ** (k / parts)) - 1 for k in range(1, parts)], last]
    return [(a + 1, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def periodic_runs(docs: DataFrame, text: str = "text", id_column: str = "doc_id", tails: bool = False, long: int = LONG) -> DataFrame:
    """id, n_runs, the run of greatest exponent, digests of all runs and of the text with each run cut to its first period.

    ``tails``: rewrite the tails of one document in ten first (see :func:`with_tail`).
    """
    asked = docs.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("text"))
    kind = asked.schema["id"].dataType.simpleString()
    shape = with_tail if tails else lambda ids, _: ids
    size = F.coalesce(F.octet_length("text"), F.lit(0))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, read = [], 0
            for at in range(batch.num_rows):
                value = _bytes(batch.column(1)[at])
                doc = batch.column(0)[at].as_py()
                words, ids = word_ids(value)
                held.append((doc, words, shape(ids, doc)))
                read += len(value)
                if read > AT_ONCE or at + 1 == batch.num_rows:
                    runs = runs_of_many([h[2] for h in held])
                    yield _table([h[0] for h in held], [_digest(w, ids, r) for (_, w, ids), r in zip(held, runs, strict=True)], batch.column(0).type)
                    held, read = [], 0

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                _, ids = word_ids(_bytes(batch.column("text")[at]))
                ids = shape(ids, batch.column("id")[at].as_py())
                low, high = lag_ranges(len(ids), batch.column("parts")[at].as_py())[batch.column("part")[at].as_py()]
                runs = runs_of(ids, low, high) if low <= high else []
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("key")[at].as_py()], pa.string()), pa.array([[{"start": s, "length": n, "period": q} for s, n, q in runs]], pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])))], ["key", "runs"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                doc = batch.column("id")[at].as_py()
                words, ids = word_ids(_bytes(batch.column("text")[at]))
                ids = shape(ids, doc)
                runs = sorted({(r["start"], r["length"], r["period"]) for r in batch.column("runs")[at].as_py() or ()}, key=lambda r: (r[0], r[2]))
                yield _table([doc], [_digest(words, ids, runs)], batch.column("id").type)

    schema = f"id {kind}, {SCHEMA}"
    few = in_arrow(asked.where(size < long), short, schema)
    many = asked.where(size >= long).withColumn("key", F.concat(F.sha2("text", 256), F.coalesce(F.concat(F.lit("/"), F.col("id").cast("string")), F.lit(""))))
    # Repeated rows are compared once: a document and a range of lags is a row.
    dealt = many.dropDuplicates(["key"]).withColumn("parts", F.ceil(F.sqrt(F.octet_length("text") / RANGE_BYTES)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    found = in_arrow(dealt.repartition("key", "part"), ranged, "key string, runs array<struct<start:bigint,length:bigint,period:bigint>>")
    together = found.groupBy("key").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    told = in_arrow(many.join(together, "key", "left").select("id", "text", "runs"), joined, schema)
    return few.union(told).withColumnRenamed("id", id_column)
