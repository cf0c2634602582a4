"""Compression classifier: zstandard dictionaries of good and bad labelled text.

A text is compressed with a dictionary of good and one of bad text, in short
blocks, so that the dictionary and not the text before it explains each block;
the difference of both sizes over their sum, calibrated by logistic regression
on other labelled rows, is the score. Two channels are compared: the text, and its
outline, in which runs of letters shrink to one mark and an immediately repeated
word to a mark that counts the run, so that the dictionaries also see layout.

Defined results: null and empty texts score as the calibration's value at zero
differences; without rows of both labels the score is 0.5 everywhere.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from barline.llm.common import map_batches

_OUTLINE = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + b"abcdefghijklmnopqrstuvwxyz" + b"0123456789" + bytes(range(0x80, 0x100)),
    b"A" * 26 + b"a" * 26 + b"0" * 10 + b"a" * 128,
)
_RUNS = [(re.compile(rb"aa+"), b"a"), (re.compile(rb"AA+"), b"AA"), (re.compile(rb"00+"), b"0")]
#: Marks for the first, second ... immediate repeat of a word; letters and digits of words never look so.
_REPEATS = [b"", *(bytes([0x01 + i % 8, 0x0E + i % 16]) for i in range(31))]


def outline(raw: bytes) -> bytes:
    """The layout of a text: letter runs as marks, immediate repeats of a word as counting marks."""
    lines = []
    for line in raw.split(b"\n"):
        words, run = line.split(), 0
        for i in range(1, len(words)):
            if words[i] == last if run else words[i] == words[i - 1]:
                last = words[i] if not run else last
                words[i] = _REPEATS[run := min(run + 1, len(_REPEATS) - 1)]
            else:
                run = 0
        lines.append(b" ".join(words))
    out = b"\n".join(lines).translate(_OUTLINE)
    for run, mark in _RUNS:
        out = run.sub(mark, out)
    return out


CHANNELS = (bytes, outline)
#: Bytes of a block that is compressed by itself, for each channel, and of a frame.
BLOCKS, FRAME = (1024, 48), 8


@dataclass
class CompressionModel:
    dictionaries: list[tuple[bytes, bytes]]  # for each channel, of good and of bad text
    weights: list[float]  # bias, then one for each channel
    level: int = 3

    def compressors(self) -> list[tuple]:
        def make(content: bytes) -> zstandard.ZstdCompressor:
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=self.level)
            return zstandard.ZstdCompressor(level=self.level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)

        return [tuple(map(make, pair)) for pair in self.dictionaries]


def differences(raw: bytes, compressors: list[tuple]) -> list[float]:
    """Positive where good text's dictionary makes a text smaller."""
    out = []
    for channel, size, (good, bad) in zip(CHANNELS, BLOCKS, compressors, strict=True):
        data = channel(raw)
        if not data:
            out.append(0.0)
            continue
        blocks = [data[i : i + size] for i in range(0, len(data), size)]
        g, b = sum(map(len, map(good.compress, blocks))), sum(map(len, map(bad.compress, blocks)))
        g, b = g - FRAME * len(blocks), b - FRAME * len(blocks)
        out.append((b - g) / (b + g))
    return out


def build_dictionary(texts: list[bytes], size: int) -> bytes:
    """Pieces of all the texts in equal parts, as raw dictionary content of at most ``size`` bytes."""
    if not texts:
        return b" "
    share = max(64, size // len(texts))
    return b"\n".join(t[:share] if len(t) <= share else t[(len(t) - share) // 2 :][:share] for t in texts)[-size:] or b" "


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Newton's method; x without the bias column, which comes first in the result."""
    a = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(a.shape[1])
    ridge = np.diag([1e-9, *[l2] * x.shape[1]])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge + 1e-9 * np.eye(len(w)), a.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(texts: list[str | None], good: list[int], dictionary_bytes: int = 110_000, level: int = 3) -> CompressionModel:
    """Every second text of a class feeds its dictionary, the others the calibration."""
    raws = [(t or "").encode() for t in texts]
    g, b = [r for r, y in zip(raws, good, strict=True) if y == 1], [r for r, y in zip(raws, good, strict=True) if y == 0]
    if len(g) < 2 or len(b) < 2:
        return CompressionModel([(b" ", b" ")] * len(CHANNELS), [0.0] * (1 + len(CHANNELS)), level)
    pairs = [(build_dictionary([c(r) for r in g[::2]], dictionary_bytes), build_dictionary([c(r) for r in b[::2]], dictionary_bytes)) for c in CHANNELS]
    model = CompressionModel(pairs, [0.0] * (1 + len(CHANNELS)), level)
    compressors = model.compressors()
    x = np.array([differences(r, compressors) for r in g[1::2] + b[1::2]])
    y = np.array([1.0] * len(g[1::2]) + [0.0] * len(b[1::2]))
    model.weights = list(map(float, logistic(x, y)))
    return model


def score(df: DataFrame, model: CompressionModel, text_column: str, keep: list[str]) -> DataFrame:
    """``keep`` columns, the two differences and ``score`` for each row's whole text."""
    source = df.select(*keep, df[text_column].cast("string").alias("__text"))
    held: dict = {}

    def run(batch: pa.RecordBatch) -> dict:
        compressors = held.get("c") or held.setdefault("c", model.compressors())
        d = np.array([differences((t or "").encode(), compressors) for t in batch.column("__text").to_pylist()]).reshape(-1, len(CHANNELS))
        p = 1 / (1 + np.exp(-np.clip(model.weights[0] + d @ np.array(model.weights[1:]), -30, 30)))
        return {c: batch.column(c) for c in keep} | {"text_difference": pa.array(d[:, 0]), "outline_difference": pa.array(d[:, 1]), "score": pa.array(p)}

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "__text")
    return map_batches(source, run, schema + ", text_difference double, outline_difference double, score double")
