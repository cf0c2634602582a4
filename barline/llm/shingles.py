"""Word-shingle sets and minhash signatures of whole texts, vectorised over Arrow batches.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. A set holds 64-bit hashes
of a text's shingles of ``size`` words; a text of fewer words has its whole
sequence as its one shingle, a text without words an empty set.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are hashed at once.
AT_ONCE = 2_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Mixes the bits of 64-bit values (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    texts = pc.fill_null(texts, "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + AT_ONCE, "right")))
        yield texts.slice(low, high - low)
        low = high


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and where each text's words begin (one more)."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    units = parts.flatten().dictionary_encode()
    table = pd.util.hash_array(units.dictionary.to_numpy(zero_copy_only=False), categorize=False) if len(units.dictionary) else np.zeros(0, np.uint64)
    codes = units.indices.to_numpy()
    offsets = parts.offsets.to_numpy().astype(np.int64)
    codes = codes[: offsets[-1] - offsets[0]]
    offsets = offsets - offsets[0]
    blank = pc.equal(units.dictionary, "").to_numpy(zero_copy_only=False) if len(units.dictionary) else np.zeros(0, bool)
    if blank.any():  # what a split leaves at the ends of a text
        word = ~blank[codes]
        offsets = np.concatenate([[0], np.cumsum(word)])[offsets]
        codes = codes[word]
    return table[codes], offsets


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and where each text's begin (one more)."""
    words, offsets = word_hashes(texts)
    counts = np.diff(offsets)
    n = np.where(counts == 0, 0, np.maximum(counts - size + 1, 1))
    ends = np.cumsum(n)
    owner = np.repeat(np.arange(len(n)), n)
    first = np.repeat(offsets[:-1] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    h = np.full(len(first), np.uint64(size))
    for k in range(size):
        h = mix(h + padded[first + k]) * _ODD
    for i in np.flatnonzero((counts > 0) & (counts < size)):
        short = np.array([1], np.uint64)
        for w in words[offsets[i] : offsets[i + 1]]:
            short = mix(short + w) * _ODD
        h[ends[i] - 1] = short[0]
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    return h, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(n)))]).astype(np.int64)


def minhashes(sets: np.ndarray, offsets: np.ndarray, count: int, seed: int = 1) -> np.ndarray:
    """(texts, count) 32-bit minhashes; rows of empty sets are zero."""
    out = np.zeros((len(offsets) - 1, count), np.uint32)
    full = np.flatnonzero(np.diff(offsets))
    if not len(full):
        return out
    random = np.random.default_rng(seed)
    factor = random.integers(1 << 62, (1 << 63) - 1, count, dtype=np.uint64) | np.uint64(1)
    add = random.integers(0, (1 << 63) - 1, count, dtype=np.uint64)
    starts = offsets[:-1][full]
    # Sets follow each other; those of some texts at a time stay in the cache.
    step = np.searchsorted(starts, np.arange(0, len(sets), 1 << 15))
    cuts = np.unique(np.concatenate([step, [len(starts)]]))
    for low, high in zip(np.concatenate([[0], cuts[:-1]]), cuts, strict=True):
        if low == high:
            continue
        a, b = starts[low], starts[high] if high < len(starts) else len(sets)
        part, begin = sets[a:b], starts[low:high] - a
        for k in range(count):
            values = ((part * factor[k] + add[k]) >> np.uint64(32)).astype(np.uint32)
            out[full[low:high], k] = np.minimum.reduceat(values, begin)
    return out


def digests(sets: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """16 bytes that tell equal sets."""
    raw = memoryview(np.ascontiguousarray(sets).tobytes())
    return [hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def bin_sketch(sets: np.ndarray, offsets: np.ndarray, bins: int = 256) -> np.ndarray:
    """(texts, bins) bytes: of the smallest hash in each bin a byte from 1 to 255; 0 where a bin is empty.

    One-permutation hashing: one more hash a shingle. Small sets are held almost whole.
    """
    n = len(offsets) - 1
    out = np.zeros((n, bins), np.uint8)
    h = mix(sets + np.uint64(0x5BD1E995))
    cell = np.repeat(np.arange(n), np.diff(offsets)) * bins + (h & np.uint64(bins - 1)).astype(np.int64)
    order = np.lexsort((h, cell))
    cell, h = cell[order], h[order]
    first = np.ones(len(cell), bool)
    first[1:] = cell[1:] != cell[:-1]
    out.reshape(-1)[cell[first]] = ((h[first] >> np.uint64(40)) % np.uint64(255) + np.uint64(1)).astype(np.uint8)
    return out


def may_link(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, percent: int, deviations: float = 4.5) -> np.ndarray:
    """False where sketches (rows) of sets of ``na`` and ``nb`` members tell that their similarity is below ``percent``.

    The bound lies so many standard deviations (of a sample without replacement)
    below the threshold; sizes alone decide where they are too unlike.
    """
    t = percent / 100
    both = ((a == b) & (a > 0)).sum(axis=1)
    used = np.maximum(((a > 0) | (b > 0)).sum(axis=1), 1)
    union = np.maximum((na + nb) / (1 + t), used)
    spread = np.sqrt(t * (1 - t) / used * np.maximum(1 - used / union, 0.02))
    return (both / used >= t - deviations * spread - 1 / used) & (np.minimum(na, nb) >= t * np.maximum(na, nb) - 1e-9)
