"""As-of joins on irregular times, with or without keys.

Both sides become one series by time. It is numbered and cut into blocks, and each left
row takes the last right row before it: within its block by a window, over block borders by
a table of each block's last right row. So neither a grid of times nor a range
join is needed, one hot key spreads over many tasks, and there is one shuffle of both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.operators import chunks as ck

#: Rows of both sides in a block.
BLOCK = 4096


def asof_joins(left: DataFrame, rights: list[tuple[DataFrame, str, list[str]]], keys: tuple[str, ...], ts: str, direction: str = "backward", block: int = BLOCK, strict: bool = False, days: int = ck.SPAN_DAYS) -> DataFrame:
    """``left`` with the time and values of the last row at or before its time of each of ``rights`` (relation, time column, values): all in one series.

    ``direction``: "backward", or "forward" for the first right row at or after it (a point's
    interval, where right rows are the ends of intervals). ``strict``: not at the same time. Of right rows of
    one time, the one with the greatest values counts. Left rows without a match have NULLs; left rows
    whose time is NULL have no match, and so have rows whose keys are NULL. Right rows without a time match nothing.
    """
    if direction not in ("backward", "forward"):
        raise ValueError(f"no such direction: {direction}")
    new = [c for _, t, values in rights for c in (t, *values)]
    clash = set(new) & set(left.columns) or {c for c in new if new.count(c) > 1}
    if clash:
        raise ValueError(f"both sides have {sorted(clash)}")
    named = F.col(ts).isNotNull()
    for k in keys:
        named = named & F.col(k).isNotNull()
    both = left.where(named).select(*keys, F.col(ts).alias("__ts"), F.lit(0 if strict else len(rights)).alias("__side"), F.struct(*left.columns).alias("__left"))
    held = [f"__right{i}" for i in range(len(rights))]
    for i, (right, at, values) in enumerate(rights):
        other = right.where(F.col(at).isNotNull()).select(*keys, F.col(at).alias("__ts"), F.lit(i + 1 if strict else i).alias("__side"), F.struct(F.col(at).alias("t"), *values).alias(held[i]))
        for k in keys:
            other = other.where(F.col(k).isNotNull())
        both = both.unionByName(other, allowMissingColumns=True)
    numbered = ck.numbered(both, keys, "__ts", days, ties=("__side", *held), descending=direction == "forward")
    joined = ck.filled(ck.blocks(numbered, 0, block, keys), held, keys).where("__left IS NOT NULL")
    found = [e for (_, at, values), h in zip(rights, held, strict=True) for e in (F.col(f"{h}.t").alias(at), *[F.col(f"{h}.{v}").alias(v) for v in values])]
    out = joined.select("__left.*", *found)
    kinds = {c: right.schema[c].dataType for right, at, values in rights for c in (at, *values)}
    rest = left.where(~F.coalesce(named, F.lit(False))).select("*", *[F.lit(None).cast(kinds[c]).alias(c) for c in new])
    return out.unionByName(rest)


def asof_join(left: DataFrame, right: DataFrame, keys: tuple[str, ...], ts: str, right_ts: str, values: list[str], direction: str = "backward", block: int = BLOCK, strict: bool = False, days: int = ck.SPAN_DAYS) -> DataFrame:
    """:func:`asof_joins` with one relation."""
    return asof_joins(left, [(right, right_ts, values)], keys, ts, direction, block, strict, days)
