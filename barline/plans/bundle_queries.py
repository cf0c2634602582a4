"""Queries on bundles: events as trades inside of four-hour bars, marks as their whole units, settlements every two hours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barline.operators.lineage import cut
from barline.registry import Registry
from barline.sources import bundles as bd
from barline.sources import market as m

R = Registry()
STEP, PER = 240, 64


def _records_sql(name: str, price: str) -> str:
    before = "OVER (PARTITION BY symbol, slot, segment_ix ORDER BY minute ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""{name}_min AS (SELECT symbol, slot, minute // 60 AS segment_ix, minute % 60 AS minute, min({price}) AS low, max({price}) AS high FROM ticks GROUP BY ALL),
{name}_rec AS (SELECT *, min(low) {before} AS low_before, max(high) {before} AS high_before FROM {name}_min),
{name} AS (SELECT symbol, bar_ix, segment_ix, side, minute, price FROM (SELECT symbol, slot, segment_ix, 0 AS side, minute, low AS price FROM {name}_rec WHERE low_before IS NULL OR low < low_before UNION ALL SELECT symbol, slot, segment_ix, 1, minute, high FROM {name}_rec WHERE high_before IS NULL OR high > high_before) JOIN marks USING (symbol, slot))"""


_BUNDLE = f"""ticks AS (SELECT event_type AS symbol, event_id, ts, epoch_us(ts) // {STEP * 60_000_000} AS slot, (epoch_us(ts) % {STEP * 60_000_000}) // 60000000 AS minute, floor(value * 100) AS price, floor(value) * 100 AS mark FROM events),
marks AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY slot) - 1 AS bar_ix FROM (SELECT symbol, slot, last(mark ORDER BY ts, event_id) AS close FROM ticks GROUP BY symbol, slot)), {_records_sql('paths', 'mark')}, {_records_sql('trade_paths', 'price')}"""


def bundle(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Marks, settlements, paths of marks and trades, and tiers."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    width = STEP * 60_000_000
    t = m.read(spark, sf, "events").select(F.col("event_type").alias("symbol"), F.struct("ts", "event_id").alias("seq"), F.floor(micros / width).alias("slot"), F.floor(micros % width / 60_000_000).cast("int").alias("minute"), F.floor(F.col("value") * 100).cast("double").alias("price"), (F.floor("value") * 100).cast("double").alias("mark"))
    closes = t.groupBy("symbol", "slot").agg(F.max_by("mark", "seq").alias("close"))
    numbered = cut(closes.withColumn("bar_ix", (F.row_number().over(Window.partitionBy("symbol").orderBy("slot")) - 1).cast("bigint")))
    stamp = lambda minutes: F.timestamp_micros(F.col("slot") * width + minutes * 60_000_000).cast("timestamp_ntz")
    due = numbered.withColumn("minute", F.explode(F.array(F.lit(0), F.lit(120))))

    def records(price: str) -> DataFrame:
        d = t.groupBy("symbol", "slot", F.floor(F.col("minute") / 60).cast("int").alias("segment_ix"), (F.col("minute") % 60).alias("minute")).agg(F.min(price).alias("low"), F.max(price).alias("high"))
        before = Window.partitionBy("symbol", "slot", "segment_ix").orderBy("minute").rowsBetween(Window.unboundedPreceding, -1)
        x = d.withColumns({"low_before": F.min("low").over(before), "high_before": F.max("high").over(before)})
        side = lambda k, c, new: F.when(F.col(f"{c}_before").isNull() | new, F.struct(F.lit(k).alias("side"), F.col(c).alias("price")))
        both = F.array_compact(F.array(side(0, "low", F.col("low") < F.col("low_before")), side(1, "high", F.col("high") > F.col("high_before"))))
        x = x.withColumn("v", F.explode(both)).join(numbered.select("symbol", "slot", "bar_ix"), ["symbol", "slot"])
        return x.select("symbol", "bar_ix", "segment_ix", (F.col("segment_ix") * 60).alias("start_minute"), "v.side", "minute", "v.price")

    return {
        "marks": numbered.select("symbol", "bar_ix", stamp(F.lit(STEP).cast("bigint")).alias("ts"), "close"),
        "funding": due.select("symbol", "bar_ix", stamp(F.col("minute").cast("bigint")).alias("ts"), ((F.col("bar_ix") % 5 - 2) / 10_000).alias("rate"), F.col("close").alias("mark")),
        "paths": cut(records("mark")),
        "trade_paths": cut(records("price")),
        "brackets": numbered.select("symbol").distinct().select("symbol", F.lit(1e18).alias("cap"), F.lit(10).alias("max_leverage"), F.lit(0.05).alias("mmr"), F.lit(0.0).alias("amount")),
    }


def _digest(c: Column) -> Column:
    return F.sha2(F.array_join(F.transform(c, lambda x: x.cast("bigint").cast("string")), ","), 256)


_FLAT = lambda name, t: f"""{name}_s AS (SELECT symbol, bar_ix // {PER} AS block, bar_ix, segment_ix, count(*) FILTER (side = 0) AS n_low, count(*) FILTER (side = 1) AS n_high FROM {name} GROUP BY ALL),
{name}_f AS (SELECT symbol, block, count(*) AS {t}n_segments, sha256(string_agg(segment_ix * 60, ',' ORDER BY bar_ix, segment_ix)) AS {t}seg_start, sha256('0,' || string_agg(low_end, ',' ORDER BY bar_ix, segment_ix)) AS {t}low_ptr, sha256('0,' || string_agg(high_end, ',' ORDER BY bar_ix, segment_ix)) AS {t}high_ptr FROM (SELECT *, (sum(n_low) OVER w)::BIGINT AS low_end, (sum(n_high) OVER w)::BIGINT AS high_end FROM {name}_s WINDOW w AS (PARTITION BY symbol, block ORDER BY bar_ix, segment_ix ROWS UNBOUNDED PRECEDING)) GROUP BY ALL),
{name}_p AS (SELECT symbol, bar_ix // {PER} AS block, {', '.join(f"sha256(string_agg(minute, ',' ORDER BY bar_ix, segment_ix, minute) FILTER (side = {k})) AS {t}{n}_ix, sha256(string_agg(price::BIGINT, ',' ORDER BY bar_ix, segment_ix, minute) FILTER (side = {k})) AS {t}{n}_px" for k, n in ((0, 'low'), (1, 'high')))} FROM {name} GROUP BY ALL),
{name}_b AS (SELECT symbol, block, sha256('0,' || string_agg(e, ',' ORDER BY bar_ix)) AS {t}bar_ptr FROM (SELECT symbol, bar_ix // {PER} AS block, bar_ix, (sum(coalesce(n, 0)) OVER (PARTITION BY symbol, bar_ix // {PER} ORDER BY bar_ix ROWS UNBOUNDED PRECEDING))::BIGINT AS e FROM marks LEFT JOIN (SELECT symbol, bar_ix, count(DISTINCT segment_ix) AS n FROM {name} GROUP BY ALL) USING (symbol, bar_ix)) GROUP BY ALL)"""  # noqa: E731
_ARRAYS = ("bar_ptr", "seg_start", "low_ptr", "low_ix", "low_px", "high_ptr", "high_ix", "high_px")


@R.query(f"""WITH {_BUNDLE}, {_FLAT('paths', '')}, {_FLAT('trade_paths', 't_')},
fl AS (SELECT symbol, bar_ix // {PER} AS block, count(*) AS n_bars, sum((NOT (has0 AND has2))::BIGINT)::BIGINT AS n_bad, sha256('0,' || string_agg(2 * (bar_ix % {PER} + 1), ',' ORDER BY bar_ix)) AS fund_ptr FROM (SELECT symbol, bar_ix, bool_or(segment_ix = 0) AS has0, bool_or(segment_ix = 2) AS has2 FROM paths GROUP BY ALL) GROUP BY ALL)
SELECT symbol, block, n_bars, n_bad, fund_ptr, n_segments, {', '.join(t + c for t in ('', 't_') for c in _ARRAYS)} FROM fl JOIN paths_f USING (symbol, block) JOIN paths_p USING (symbol, block) JOIN paths_b USING (symbol, block) JOIN trade_paths_f USING (symbol, block) JOIN trade_paths_p USING (symbol, block) JOIN trade_paths_b USING (symbol, block)""")
def bundle_packed(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of a bundle's flat arrays, block by block; a bar is bad if no trade opened an hour in which it settles."""
    d = bd.packed(bundle(spark, sf), STEP, PER)
    digests = [_digest(F.col(t + c)).alias(t + c) for t in ("", "t_") for c in _ARRAYS]
    n_bad = F.size(F.filter("bad", lambda b: b)).cast("bigint")
    return d.select("symbol", F.col("block").cast("bigint").alias("block"), F.size("bad").cast("bigint").alias("n_bars"), n_bad.alias("n_bad"), _digest(F.col("fund_ptr")).alias("fund_ptr"), F.size("seg_start").cast("bigint").alias("n_segments"), *digests)


_CUT = "2024-01-16"


@R.query(f"""WITH {_BUNDLE}, b AS (SELECT symbol, bar_ix, close, make_timestamp((slot + 1) * {STEP * 60_000_000}) AS ts FROM marks), s AS (SELECT symbol, min(bar_ix) AS start FROM b WHERE ts >= TIMESTAMP '{_CUT}' GROUP BY symbol),
p AS (SELECT symbol, bar_ix, count(*) AS n_points, min(price) AS low FROM trade_paths GROUP BY ALL)
SELECT b.symbol, b.bar_ix - start AS bar_ix, ts, close, n_points, low, 2::BIGINT AS n_settled FROM b JOIN s USING (symbol) JOIN p ON p.symbol = b.symbol AND p.bar_ix = b.bar_ix WHERE b.bar_ix >= start""")
def bundle_from_time(spark: SparkSession, sf: str) -> DataFrame:
    """A bundle from a day on: bars, settlements and paths cut together and numbered anew."""
    b = bd.from_time(bundle(spark, sf), F.lit(_CUT).cast("timestamp_ntz"))
    p = b["trade_paths"].groupBy("symbol", "bar_ix").agg(F.count("*").alias("n_points"), F.min("price").alias("low"))
    f = b["funding"].groupBy("symbol", "bar_ix").agg(F.count("*").alias("n_settled"))
    return b["marks"].join(p, ["symbol", "bar_ix"]).join(f, ["symbol", "bar_ix"]).select("symbol", "bar_ix", "ts", "close", "n_points", "low", "n_settled")
