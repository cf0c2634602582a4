"""Simple-8b word-aligned integer coding, vectorised both ways.

A 64-bit word holds a selector in its top four bits and a fixed number of
values of equal width below. A value of more than 60 bits is escaped: a word
with the escape selector, then the value as a raw word.
"""

from __future__ import annotations

import numpy as np

#: Fixed values: (values in a word, bits of each) by selector; selector 0 escapes.
LAYOUT = [(1, 64), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
ESCAPE = 0
COUNT = np.array([c for c, _ in LAYOUT] + [0], np.int64)


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits of each value, at least 1."""
    if len(values) and values.max() < 1 << 52:
        width = np.frexp(values.astype(np.float64))[1]
    else:
        width = np.searchsorted(np.array([1 << b for b in range(1, 64)], np.uint64), values, side="right") + 1
    return np.maximum(width, 1).astype(np.uint8)


def encode(values: np.ndarray) -> np.ndarray:
    """Words of ``values`` (unsigned), greedily: each word takes as many values as fit."""
    v = np.ascontiguousarray(values, np.uint64)
    n = len(v)
    if not n:
        return np.zeros(0, np.uint64)
    width = _widths(v)
    choice = np.full(n, ESCAPE, np.uint8)
    powers = {1: width}  # sliding maximum over windows of a power of two
    size = 1
    while 2 * size <= max(c for c, _ in LAYOUT):
        w = powers[size].copy()
        w[:-size] = np.maximum(w[:-size], powers[size][size:])
        powers[2 * size] = w
        size *= 2
    for selector in range(len(LAYOUT) - 1, 0, -1):  # the widest first: narrower ones, which hold more, overwrite
        count, bits = LAYOUT[selector]
        if count > n:
            continue
        p = 1 << (count.bit_length() - 1)
        most = powers[p].copy()
        if count > p:
            most[: n - (count - p)] = np.maximum(most[: n - (count - p)], powers[p][count - p :])
        fits = most <= bits
        fits[n - count + 1 :] = False
        choice[fits] = selector
    step = COUNT[choice].tolist()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += step[i]
    at = np.array(starts)
    selectors = choice[at]
    escaped = selectors == ESCAPE
    place = np.arange(len(at)) + np.concatenate([[0], np.cumsum(escaped)[:-1]])
    words = np.zeros(len(at) + int(escaped.sum()), np.uint64)
    words[place[escaped] + 1] = v[at[escaped]]
    for selector in np.unique(selectors):
        if selector == ESCAPE:
            continue
        count, bits = LAYOUT[selector]
        mine = np.flatnonzero(selectors == selector)
        word = np.full(len(mine), int(selector) << 60, np.uint64)
        for k in range(count):
            word |= v[at[mine] + k] << np.uint64(k * bits)
        words[place[mine]] = word
    return words


def decode(words: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values of ``words``."""
    w = np.ascontiguousarray(words, np.uint64)
    selectors = (w >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(w), bool)
    if (selectors == ESCAPE).any():  # a raw word may look like a selector, so escapes are followed in order
        i, flat = 0, np.flatnonzero(selectors == ESCAPE).tolist()
        for i_escape in flat:
            if i_escape >= i:
                raw[i_escape + 1] = True
                i = i_escape + 2
    heads = np.flatnonzero(~raw)
    kinds = selectors[heads]
    ends = np.cumsum(COUNT[kinds])
    if (ends[-1] if len(ends) else 0) != n:
        raise ValueError(f"{ends[-1] if len(ends) else 0} values where {n} are said to be")
    begins = ends - COUNT[kinds]
    out = np.zeros(n, np.uint64)
    for kind in np.unique(kinds):
        mine = kinds == kind
        if kind == ESCAPE:
            out[begins[mine]] = w[heads[mine] + 1]
            continue
        count, bits = LAYOUT[kind]
        mask, source, target = np.uint64((1 << bits) - 1), w[heads[mine]], begins[mine]
        for k in range(count):
            out[target + k] = (source >> np.uint64(k * bits)) & mask
    return out
