"""Exact text statistics of whole documents, one pass, Arrow batches.

Words are ``[^\\x20\\x09-\\x0D]+``. A null or empty text has no words and zeros
everywhere. Every row of the input gives one row, repeated ids included.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from barline.llm.common import map_batches

#: Characters that count as symbols (fixed values).
SYMBOLS = b"#*$%&|<>"
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SPACE = b" \t\n\r\x0b\x0c"
#: Deletes continuation bytes, so that len() counts code points.
_CONTINUATION = bytes(range(0x80, 0xC0))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATIOS = ("symbols_per_word", "upper_share", "bang_share", "dup_line_share", "repeat_share", "mean_word", "distinct_share", "echo_share")
STATISTICS_SCHEMA = "".join(f", {c} bigint" for c in COUNTS) + "".join(f", {c} double" for c in RATIOS)


def repeated_window_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more, first ones included."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    distinct = set(windows)
    if len(distinct) == len(windows):
        return 0
    seen: set = set()
    twice: set = set()
    for w in windows:
        if w in seen:
            twice.add(w)
        else:
            seen.add(w)
    marked, end = 0, 0  # end: the first word not yet counted
    for i, w in enumerate(windows):
        if w in twice:
            marked += i + 3 - max(i, end)
            end = i + 3
    return marked


def statistics(text: str | None) -> tuple:
    """The values of COUNTS and RATIOS for one text."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    if not n:
        return (0, 0, sum(map(raw.count, [SYMBOLS[i : i + 1] for i in range(len(SYMBOLS))])), 0, 0) + (0.0,) * len(RATIOS)
    points = len(raw.translate(None, _CONTINUATION + _SPACE))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x and x.strip()]
    dup_lines = len(lines) - len(set(lines))
    repeat = repeated_window_words(words)
    upper = len(raw) - len(raw.translate(None, _UPPER))
    echo = sum(map(bytes.__eq__, words, words[1:]))
    return (n, points, symbols, dup_lines, repeat, symbols / n, upper / points, raw.count(b"!") / n, dup_lines / len(lines), repeat / n, points / n, len(set(words)) / n, echo / n)


def with_statistics(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """id, columns of ``also`` and the statistics of each row's whole text."""
    keep = [id_column, *also]
    source = df.select(*keep, df[text_column].cast("string").alias("__text"))
    names = [*COUNTS, *RATIOS]
    types = [pa.int64()] * len(COUNTS) + [pa.float64()] * len(RATIOS)

    def run(batch: pa.RecordBatch) -> dict:
        rows = [statistics(x) for x in batch.column("__text").to_pylist()]
        columns = zip(*rows, strict=True) if rows else [[] for _ in names]
        return {c: batch.column(c) for c in keep} | {k: pa.array(v, t) for k, v, t in zip(names, columns, types, strict=True)}

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "__text")
    return map_batches(source, run, schema + STATISTICS_SCHEMA)
