"""Toxicity: classifier chains of linear models over hashed text features.

Categories are predicted one after the other; the model of a category also sees
the probabilities of all earlier ones. For training, those come from models that
did not see the row (out-of-fold), so later models learn from inputs as noisy
as they will meet. Features are the distinct words of the whole text, lower-cased
(A-Z) with ASCII punctuation as space, and the first four letters of longer words.

Defined results: null and empty texts have no features, so the biases alone
score them; categories without positive (or without negative) rows predict the
share of positives in training; no rows at all predict 0 everywhere.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from barline.llm.common import ASCII_LOWER, ASCII_UPPER, map_batches

_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_TABLE = bytes.maketrans(ASCII_UPPER.encode() + _PUNCTUATION, ASCII_LOWER.encode() + b" " * len(_PUNCTUATION))
#: Marks a feature that is the start of a word.
STEM = b"^"
STEM_LENGTH = 4


def features(text: str | None) -> set[bytes]:
    words = set((text or "").encode().translate(_TABLE).split())
    return words | {STEM + w[:STEM_LENGTH] for w in words if len(w) > STEM_LENGTH}


@dataclass
class IndexedFeatures:
    """Features of texts as numbers: ``columns[i]`` is set in text ``owner[i]``; names are in order."""

    names: list[bytes]
    owner: np.ndarray
    columns: np.ndarray
    rows: int


def index_features(texts: list[str | None]) -> IndexedFeatures:
    """Text by text, so that the words of one text alone are held as objects beside the vocabulary."""
    number: dict[bytes, int] = {}
    parts = []
    for t in texts:
        found = features(t)
        parts.append(np.fromiter((number.setdefault(f, len(number)) for f in found), np.int32, len(found)))
    names = sorted(number)
    place = np.empty(len(names), np.int32)
    place[np.fromiter((number[f] for f in names), np.int64, len(names))] = np.arange(len(names), dtype=np.int32)
    columns = np.concatenate([np.sort(place[p]) for p in parts]) if parts else np.zeros(0, np.int32)
    return IndexedFeatures(names, np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts]), columns, len(parts))


def sparse_logistic(owner: np.ndarray, columns: np.ndarray, dense: np.ndarray, y: np.ndarray, width: int, most: int, epochs: int = 120, rate: float = 0.3, l2: float = 1e-4) -> np.ndarray:
    """Logistic regression on binary sparse rows, dense columns and a bias.

    ``owner`` and ``columns`` list the set features. Features enter by their
    chi-squared with the label (``most`` at most), scaled by their log-odds ratio;
    full-batch Adagrad from zero, so the result is deterministic. Returns
    width + dense columns + 1 weights.
    """
    n, positives = len(y), y.sum()
    count = np.bincount(columns, minlength=width).astype(float)
    both = np.bincount(columns, y[owner], minlength=width)
    expected = count * positives / n
    chi = (both - expected) ** 2 / np.maximum(expected, 1e-9) + (both - expected) ** 2 / np.maximum(count - expected, 1e-9)
    chosen = np.lexsort((np.arange(width), -chi))[:most]
    ratio = np.log((both + 0.5) / (positives + 1)) - np.log((count - both + 0.5) / (n - positives + 1))
    place = np.full(width, -1)
    place[chosen] = np.arange(len(chosen))
    inside = place[columns] >= 0
    owner, at = owner[inside], place[columns[inside]]
    scale = ratio[chosen]
    w, b = np.zeros(len(chosen)), np.zeros(dense.shape[1] + 1)
    gw, gb = np.full(len(w), 1e-10), np.full(len(b), 1e-10)
    ones = np.hstack([dense, np.ones((n, 1))])
    for _ in range(epochs):
        z = np.bincount(owner, (w * scale)[at], n) + ones @ b
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        dw = np.bincount(at, e[owner], len(w)) * scale + l2 * w
        db = ones.T @ e
        gw += dw * dw
        gb += db * db
        w -= rate * dw / np.sqrt(gw)
        b -= rate * db / np.sqrt(gb)
    out = np.zeros(width)
    out[chosen] = w * scale
    return np.concatenate([out, b])


@dataclass
class ToxicityChain:
    """Weights by feature for each category in order, its weights of earlier probabilities, its bias."""

    categories: list[str]
    weights: dict[bytes, list[float]] = field(default_factory=dict)
    links: list[list[float]] = field(default_factory=list)
    biases: list[float] = field(default_factory=list)

    def probabilities(self, text: str | None) -> list[float]:
        total = list(self.biases)
        for f in features(text) & self.weights.keys():
            for k, v in enumerate(self.weights[f]):
                total[k] += v
        out: list[float] = []
        for k, z in enumerate(total):
            z += sum(a * p for a, p in zip(self.links[k], out, strict=False))
            out.append(float(1 / (1 + np.exp(-min(30.0, max(-30.0, z))))))
        return out


def fit_chain(texts: list[str | None] | IndexedFeatures, labels: dict[str, list[int]], folds: int = 3, min_rows: int = 3, max_features: int = 2000, keys: list[object] | None = None) -> ToxicityChain:
    """Trains the categories in the order of ``labels``.

    ``max_features`` bounds the features of each model, chosen on its own
    training rows; ``keys`` deal rows to folds.
    """
    data = texts if isinstance(texts, IndexedFeatures) else index_features(texts)
    targets = {k: np.asarray(v, float) for k, v in labels.items()}
    n = data.rows
    often = np.bincount(data.columns, minlength=len(data.names)) >= min_rows
    names = [f for f, k in zip(data.names, often.tolist(), strict=True) if k]
    inside = often[data.columns]
    owner, columns = data.owner[inside].astype(np.int64), (np.cumsum(often) - 1)[data.columns[inside]]
    fold = np.array([zlib.crc32(repr(k).encode()) % folds for k in (keys if keys is not None else range(n))], dtype=np.int64)
    chain, before, matrix = ToxicityChain(list(targets)), np.zeros((n, 0)), []
    for y in targets.values():
        if not n or not 0 < y.sum() < n:
            share = float(y.mean()) if n else 0.0
            matrix.append(np.zeros(len(names)))
            chain.links.append([0.0] * before.shape[1])
            chain.biases.append(float(np.log((share + 1e-9) / (1 - share + 1e-9))))
            before = np.hstack([before, np.full((n, 1), share)])
            continue
        out_of_fold = np.zeros(n)
        for k in range(folds):
            train, test = fold != k, fold == k
            if not test.any() or not 0 < y[train].sum() < train.sum():
                out_of_fold[test] = y.mean()
                continue
            seen = train[owner]
            w = sparse_logistic((np.cumsum(train) - 1)[owner[seen]], columns[seen], before[train], y[train], len(names), max_features)
            z = np.bincount(owner, w[columns], n) + before @ w[len(names) : -1] + w[-1]
            out_of_fold[test] = 1 / (1 + np.exp(-np.clip(z[test], -30, 30)))
        w = sparse_logistic(owner, columns, before, y, len(names), max_features)
        matrix.append(w[: len(names)])
        chain.links.append([float(v) for v in w[len(names) : -1]])
        chain.biases.append(float(w[-1]))
        before = np.hstack([before, out_of_fold[:, None]])
    stacked = np.array(matrix).T if matrix else np.zeros((0, 0))
    chain.weights = {f: [float(v) for v in stacked[i]] for i, f in enumerate(names) if np.abs(stacked[i]).max() > 1e-4}
    return chain


def mine_categories(texts: list[str | None] | IndexedFeatures, toxic: list[int], most: int = 4, min_rows: int = 3, purity: float = 0.9) -> dict[str, list[int]]:
    """Splits one toxic label into categories by the vocabulary of its rows.

    Features that occur (almost) in toxic rows alone join the first group with
    which they share rows, largest first; each of the ``most`` groups that cover
    most rows is a category: toxic rows that hold one of its features. The
    label itself comes last, as the chain's verdict.
    """
    data = texts if isinstance(texts, IndexedFeatures) else index_features(texts)
    y = np.asarray(toxic, bool)
    everywhere = np.bincount(data.columns, minlength=len(data.names))
    among = np.bincount(data.columns[y[data.owner]], minlength=len(data.names)) if data.rows else everywhere
    pure = np.flatnonzero((among >= min_rows) & (among >= purity * everywhere))
    pure = pure[np.lexsort((pure, -among[pure]))][:2000].tolist()
    where: dict[int, set[int]] = {f: set() for f in pure}
    mine = np.isin(data.columns, pure) & y[data.owner] if data.rows else np.zeros(0, bool)
    for i, f in zip(data.owner[mine].tolist(), data.columns[mine].tolist(), strict=True):
        where[f].add(i)
    groups: list[set[int]] = []
    for f in pure:
        best = max(groups, key=lambda g: len(g & where[f]), default=None)
        if best is not None and 2 * len(best & where[f]) >= len(where[f]):
            best |= where[f]
        else:
            groups.append(set(where[f]))
    groups = sorted(groups, key=lambda g: (-len(g), min(g)))[:most]
    return {f"category_{k + 1}": [int(i in g) for i in range(data.rows)] for k, g in enumerate(groups)} | {"toxic": [int(y) for y in toxic]}


def score(df: DataFrame, chain: ToxicityChain, text_column: str, keep: list[str]) -> DataFrame:
    """``keep`` columns and, for each row's whole text, ``p_<category>`` in chain order."""
    source = df.select(*keep, df[text_column].cast("string").alias("__text"))
    broadcast = df.sparkSession.sparkContext.broadcast(chain)  # bounded by max_features

    def run(batch: pa.RecordBatch) -> dict:
        c = broadcast.value
        p = np.array([c.probabilities(t) for t in batch.column("__text").to_pylist()], dtype=float).reshape(-1, len(c.categories))
        return {k: batch.column(k) for k in keep} | {f"p_{name}": pa.array(p[:, k]) for k, name in enumerate(c.categories)}

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "__text")
    return map_batches(source, run, schema + "".join(f", `p_{c}` double" for c in chain.categories))


def keep_clean(df: DataFrame, chain: ToxicityChain, below: float, text_column: str = "text") -> DataFrame:
    """The rows of ``df``, with all columns, whose last category's probability is less than ``below``."""
    broadcast = df.sparkSession.sparkContext.broadcast(chain)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(text_column).cast(pa.string()).to_pylist()
        return batch.filter(pa.array([broadcast.value.probabilities(t)[-1] < below for t in texts], pa.bool_()))

    return map_batches(df, run, df.schema)
