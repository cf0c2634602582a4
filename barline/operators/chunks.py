"""Long series cut over many tasks: row numbers, blocks with a halo, and recursions as prefix scans.

A window over one symbol runs in one task, however long the symbol's history is.
Here rows get their number within the series from counts by spans of time (a small
table whose sums tell where each span begins), are cut into blocks of equally many
rows, and each block also gets the rows that its windows look back on. A feature is then a window over
(symbol, block), computed by as many tasks as there are blocks, and the rows looked back on are trimmed.

A recursion v = a v' + b over the whole history composes: two steps (a, b) and then (c, d)
are one step (c a, c b + d). A block folds to one step, and so do many blocks; a walk over those few steps
gives each block the value that it starts from, and then all blocks are walked at once, each row once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.functions import features as ft

#: Rows of a block, days of the spans in which rows are counted first, and blocks whose totals are taken together.
BLOCK, SPAN_DAYS, FAN = 256, 365, 256


def span_of(ts: Column, days: int) -> Column:
    """Number of the span of ``days`` that a time lies in."""
    return F.floor(F.datediff(ts, F.lit("1970-01-01").cast("date")) / days).cast("bigint")


def numbered(rows: DataFrame, keys: tuple[str, ...] = ("symbol",), ts: str = "ts", days: int = SPAN_DAYS, total: str | None = None, ties: tuple[str, ...] = (), descending: bool = False) -> DataFrame:
    """``rows`` with row_ix, the row's number in its series from 0, without a task that holds a whole series.

    Rows of a series are ordered by time and, at equal times, by ``ties``; ``descending``: from the latest time on (ties
    in their own order). ``total``: a column for the number of rows of the series.
    """
    turn = (lambda c: c.desc()) if descending else (lambda c: c)
    spanned = rows.withColumn("__span", span_of(F.col(ts), days))
    counts = spanned.groupBy(*keys, "__span").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy(turn(F.col("__span"))).rowsBetween(Window.unboundedPreceding, -1))
    also = [F.sum("__n").over(Window.partitionBy(*keys)).alias(total)] if total else []
    starts = counts.select(*keys, "__span", F.coalesce(before, F.lit(0)).alias("__before"), *also)
    # Rows already dealt by series would satisfy a window over series and span: deal them by both.
    within = spanned.repartition(*keys, "__span").withColumn("__within", F.row_number().over(Window.partitionBy(*keys, "__span").orderBy(turn(F.col(ts)), *ties)))
    return within.join(starts, [*keys, "__span"]).withColumn("row_ix", (F.col("__before") + F.col("__within") - 1).cast("bigint")).drop("__span", "__before", "__within")


def blocks(numbered_rows: DataFrame, lookback: int, block: int = BLOCK, keys: tuple[str, ...] = ("symbol",), ahead: int = 0) -> DataFrame:
    """Rows of :func:`numbered` in their own block, in later ones that look back on them (up to ``lookback`` rows) and in earlier ones that look ahead to them: block, own."""
    of = lambda ix: F.floor(ix / block).cast("bigint")
    ix = F.col("row_ix")
    cut = numbered_rows.withColumn("block", F.explode(F.sequence(of(F.greatest(ix - ahead, F.lit(0))), of(ix + lookback))))
    # A stated number of tasks: rows are few bytes for the work that windows do on them, so tasks by size would be too few.
    return cut.withColumn("own", F.col("block") == of(ix)).repartition(int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "block")


def in_blocks(rows: DataFrame, lookback: int, feature: Callable[[DataFrame], DataFrame], block: int = BLOCK, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """``feature`` (a projection of rows by windows that look at most ``lookback`` rows back) computed block by block.

    Features of :mod:`barline.functions.features` are windows over (symbol, block) meanwhile. The
    projection keeps its rows, and gives them in any columns.
    """
    cut = blocks(numbered(rows, keys), lookback, block, keys)
    with ft.partitioned(*keys, "block"):
        done = feature(cut.withColumn("__own", F.col("own")))
    if "__own" not in done.columns:
        raise ValueError("the projection must keep the column __own")
    return done.where("__own").drop("__own", "own", "block", "row_ix")


def filled(cut: DataFrame, columns: list[str], keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """``cut`` (rows of one block each, with block and row_ix) with NULLs of ``columns`` replaced by the last value before them in the series.

    Within a block by a window; the last values of each block, one row a block, are carried over the borders.
    """
    over = Window.partitionBy(*keys, "block").orderBy("row_ix").rowsBetween(Window.unboundedPreceding, 0)
    local = cut.withColumns({c: F.last(c, ignorenulls=True).over(over) for c in columns})
    ends = cut.groupBy(*keys, "block").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("row_ix"))).alias(f"__{c}") for c in columns])
    earlier = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, "block", *[F.last(f"__{c}", ignorenulls=True).over(earlier).alias(f"__{c}") for c in columns])
    return local.join(carried, [*keys, "block"]).withColumns({c: F.coalesce(c, f"__{c}") for c in columns}).drop(*[f"__{c}" for c in columns])


def _held(steps: DataFrame, by: list[str], order: str, others: list[str]) -> DataFrame:
    """``by`` and rows: the rows of a group in order, as an array."""
    return steps.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(order, *others))).alias("rows"))


def _total(names: list[str]) -> Column:
    """All steps of ``rows`` as one step."""
    none = F.struct(*[F.lit(v).alias(f"{c}_{x}") for c in names for x, v in (("a", 1.0), ("b", 0.0))])
    return F.aggregate("rows", none, lambda v, r: F.struct(*[e.alias(f"{c}_{x}") for c in names for x, e in (("a", r[f"{c}_a"] * v[f"{c}_a"]), ("b", r[f"{c}_a"] * v[f"{c}_b"] + r[f"{c}_b"]))]))


def _walked(names: list[str], start: Column, before: bool) -> Column:
    """The values after each step of ``rows`` (or ``before`` it) from ``start``, as an array of structs."""
    kind = "array<struct<" + ",".join(f"{c}:double" for c in names) + ">>"

    def step(v: Column, r: Column) -> Column:
        now = F.struct(*[(r[f"{c}_a"] * v["now"][c] + r[f"{c}_b"]).alias(c) for c in names])
        return F.struct(now.alias("now"), F.array_append(v["all"], v["now"] if before else now).alias("all"))

    return F.aggregate("rows", F.struct(start.alias("now"), F.expr(f"CAST(array() AS {kind})").alias("all")), step, lambda v: v["all"])


def scanned(cut: DataFrame, recursions: dict[str, tuple[Column, Column]], fan: int = FAN, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """``cut`` (rows of one block each, with block and row_ix) with a column for each of ``recursions``: v = a v' + b over all rows of the series, from v' = 0.

    ``a`` and ``b`` must not be NULL. Blocks fold to a step each, ``fan`` blocks to one again, and a series'
    few remaining steps are walked in order; then each level's starts let the one below be walked.
    """
    names, k = list(recursions), list(keys)
    ab, zero = [f"{c}_{x}" for c in names for x in "ab"], F.struct(*[F.lit(0.0).alias(c) for c in names])
    steps = cut.withColumns({f"{c}_{x}": y.cast("double") for c, (a, b) in recursions.items() for x, y in (("a", a), ("b", b))})
    low = _held(steps, [*k, "block"], "row_ix", [c for c in steps.columns if c not in {*k, "block", "row_ix"}])
    middle = _held(low.select(*k, "block", F.floor(F.col("block") / fan).alias("super"), _total(names).alias("t")).select(*k, "super", "block", "t.*"), [*k, "super"], "block", ab)
    top = _held(middle.select(*k, "super", _total(names).alias("t")).select(*k, "super", "t.*"), k, "super", ab)

    def opened(rows: DataFrame, start: Column, by: list[str], before: bool) -> DataFrame:
        return rows.select(*by, F.explode(F.arrays_zip("rows", _walked(names, start, before).alias("v"))).alias("z")).select(*by, "z.rows.*", "z.v.*")

    starts = lambda opened_rows, by: opened_rows.select(*by, F.struct(*names).alias("start"))
    supers = starts(opened(top, zero, k, True), [*k, "super"])
    blocks_ = starts(opened(middle.join(supers, [*k, "super"]), F.col("start"), k, True), [*k, "block"])
    return opened(low.join(blocks_, [*k, "block"]), F.col("start"), [*k, "block"], False).drop(*ab)


def seeded(x: Column, place: Column, n: int, alpha: float) -> tuple[Column, Column]:
    """Steps of a mean that begins as the mean of the first ``n`` values and then moves by ``alpha``: until then a running sum.

    ``place``: number of the value from 0; below 0 there is none yet.
    """
    a = F.when(place < n - 1, 1.0).when(place == n - 1, 1.0 / n).otherwise(1 - alpha)
    b = F.when(place < 0, 0.0).when(place < n - 1, x).when(place == n - 1, x / n).otherwise(alpha * x)
    return a, b


def full_history(bars: DataFrame, ema: tuple[int, ...] = (), atr: tuple[int, ...] = (), rsi: tuple[int, ...] = (), block: int = BLOCK) -> DataFrame:
    """symbol, ts, ema_n, atr_n, rsi_n: recursive features over each symbol's whole history, seeded with the mean of their first n values."""

    def looked_back(d: DataFrame) -> DataFrame:
        step = F.col("close") - ft.ago(F.col("close"), 1)
        return d.withColumns({"range": ft.true_range(), "up": F.coalesce(F.greatest(step, F.lit(0.0)), F.lit(0.0)), "down": F.coalesce(F.greatest(-step, F.lit(0.0)), F.lit(0.0))})

    with ft.partitioned("symbol", "block"):
        cut = looked_back(blocks(numbered(bars.select("symbol", "ts", "high", "low", "close")), 1, block)).where("own")
    place = F.col("row_ix")
    steps = {f"ema_{n}": seeded(F.col("close"), place, n, 2 / (n + 1)) for n in ema} | {f"atr_{n}": seeded(F.col("range"), place, n, 1 / n) for n in atr}
    for n in rsi:  # the first bar has no move
        steps |= {f"up_{n}": seeded(F.col("up"), place - 1, n, 1 / n), f"down_{n}": seeded(F.col("down"), place - 1, n, 1 / n)}
    v = scanned(cut, steps)
    full = lambda n, x: F.when(place >= n - 1, x)
    index = lambda n: F.when(F.col(f"down_{n}") == 0, F.lit(100.0)).otherwise(100 - 100 / (1 + F.col(f"up_{n}") / F.col(f"down_{n}")))
    return v.select("symbol", "ts", *[full(n, F.col(f"ema_{n}")).alias(f"ema_{n}") for n in ema], *[full(n, F.col(f"atr_{n}")).alias(f"atr_{n}") for n in atr], *[full(n + 1, index(n)).alias(f"rsi_{n}") for n in rsi])
