"""Chat formatting with a grammar round trip.

A turn is rendered ``<|im_start|>role\\ntext<|im_end|>\\n``. A deterministic
parser reads the rendered turn back; where role and text do not come back
identical, the conflicting content is escaped and the turn is rendered again
until they do. Escaping adds one backslash inside control strings
(``<|im_`` becomes ``<\\|im_``, ``<\\|im_`` becomes ``<\\\\|im_`` and so on), so
removing one backslash restores them; roles also escape line ends.

Turns render independently of each other, so this runs without a shuffle. The
digest of a conversation is sequential by nature (a hash over turns in order): it
streams over rows sorted by conversation and turn and holds one hash state, so a
conversation of any length needs constant memory.

Defined results: null texts and roles are empty; turns order by turn (null
first), then role, text; repeated rows are turns of their own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.common import in_arrow, map_batches

START, END = "<|im_start|>", "<|im_end|>"
_CONTROL = re.compile(r"<(\\*)\|im_")
_ESCAPED = re.compile(r"<\\(\\*)\|im_")


class GrammarError(ValueError):
    """Text that the chat grammar does not produce."""


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\\\1|im_", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|im_", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(\\|n)", lambda m: "\n" if m[1] == "n" else "\\", unescape(role))


def parse(rendered: str) -> list[tuple[str, str, int, int]]:
    """Turns of rendered text: role, text, and where the (escaped) text begins and ends."""
    turns, at = [], 0
    while at < len(rendered):
        if not rendered.startswith(START, at):
            raise GrammarError(f"no start of a turn at {at}")
        line = rendered.find("\n", at)
        stop = rendered.find(END, line + 1) if line >= 0 else -1
        if stop < 0 or rendered[stop + len(END) : stop + len(END) + 1] != "\n":
            raise GrammarError(f"no end of the turn at {at}")
        role, text = rendered[at + len(START) : line], rendered[line + 1 : stop]
        if START in role or END in role or START in text:
            raise GrammarError(f"control string inside the turn at {at}")
        turns.append((unescape_role(role), unescape(text), line + 1, stop))
        at = stop + len(END) + 1
    return turns


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """The rendered turn and where its text lies in it; escapes only what fails to come back."""
    attempts = [(role, text), (role, escape(text)), (escape_role(role), text), (escape_role(role), escape(text))]
    for r, t in attempts:
        rendered = f"{START}{r}\n{t}{END}\n"
        try:
            if [(a, b) for a, b, _, _ in parse(rendered)] == [(role, text)]:
                return rendered, len(START) + len(r) + 1, len(rendered) - len(END) - 1
        except GrammarError:
            pass
    raise GrammarError(f"the turn can't be rendered: {role!r}")


def format_turns(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, turn, role, text (as source) and formatted, loss_start, loss_end (code points
    in ``formatted``; null where the role has no loss). The turns of a conversation in
    order, put one after the other, are its training text."""
    source = conversations.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batch: pa.RecordBatch) -> dict:
        roles, texts = batch.column("role").to_pylist(), batch.column("text").to_pylist()
        done = [render_turn(r, t) for r, t in zip(roles, texts, strict=True)]
        loss = [r == loss_role for r in roles]
        return {
            **{c: batch.column(c) for c in ("conv_id", "turn", "role", "text")},
            "formatted": pa.array([d[0] for d in done], pa.string()),
            "loss_start": pa.array([d[1] if k else None for d, k in zip(done, loss, strict=True)], pa.int64()),
            "loss_end": pa.array([d[2] if k else None for d, k in zip(done, loss, strict=True)], pa.int64()),
        }

    kinds = {f.name: f.dataType.simpleString() for f in source.schema}
    return map_batches(source, run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, text string, formatted string, loss_start bigint, loss_end bigint")


def read_back(formatted: DataFrame) -> DataFrame:
    """One row a conversation, recovered from the formatted turns alone (see module)."""
    ordered = (
        formatted.select("conv_id", "turn", "role", "text", "formatted", "loss_start", "loss_end")
        .repartition("conv_id")
        .sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")
        .select("conv_id", "formatted", "loss_start", "loss_end")
    )
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None  # conv_id, turns, hash of turns, loss chars, hash of loss, chars
        out: list[tuple] = []
        kinds = None

        def close() -> None:
            if state:
                out.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [[] for _ in names]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            kinds = [batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            for conv, rendered, low, high in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end")), strict=True):
                if state is None or state[0] != conv:
                    close()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, _, _ in parse(rendered):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                state[5] += len(rendered)
                if low is not None:
                    loss = unescape(rendered[low:high])
                    state[3] += len(loss)
                    state[4].update(loss.encode())
            if out:
                yield flush()
        close()
        if out:
            yield flush()

    kind = next(f.dataType.simpleString() for f in formatted.schema if f.name == "conv_id")
    return in_arrow(ordered, run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def assemble(formatted: DataFrame) -> DataFrame:
    """conv_id and the whole training text of each conversation, for conversations that fit in memory."""
    turns = F.array_sort(F.collect_list(F.struct(F.coalesce(F.col("turn"), F.lit(-(2**62))).alias("turn"), "role", "text", "formatted")))
    return formatted.groupBy("conv_id").agg(F.concat_ws("", F.transform(turns, lambda t: t["formatted"])).alias("text"))
