"""Medians and means over trailing ranges of time, at stated points, in time that grows with the rows.

A window over a range of time looks at all rows of the range for each row: the square of the rows that a range
holds. Here rows are dealt by key and value, so a bucket holds a stretch of a key's values. In each bucket running counts and
sums by time tell, at both ends of a point's ranges, how many of the range's rows lie in it. The counts of all buckets
tell which one holds the median, and at which place; that bucket's rows alone are looked at again, by spans of time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.operators.lineage import cut

#: Rows of a bucket, about, and buckets at most.
BUCKET_ROWS, BUCKETS = 20_000, 1024
DAY = 86_400_000_000
#: Sums are taken over these numbers, exactly, so that a range's sum is a difference of running sums.
EXACT = "decimal(38,22)"


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def trailing(rows: DataFrame, points: DataFrame, ts: str, value: str, median_days: int, mean_days: int, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """``keys``, ``ts``, median, mean: of the values of ``rows`` in the days up to each of ``points`` (keys and ``ts``), both ends included.

    NULL values don't count; a range without values has NULLs. Medians of an even number are the mean of the middle two. Values are
    below 1e16; a mean over one that isn't finite is NaN.
    """
    k = list(keys)
    known = rows.where(F.col(value).isNotNull() & F.col(ts).isNotNull()).select(*k, micros(F.col(ts)).alias("t"), F.col(value).cast("double").alias("v"))
    points = points.select(*k, ts).where(F.col(ts).isNotNull()).distinct().withColumn("at", micros(F.col(ts)))
    # Equal values fall in one bucket, and a key's buckets are in the order of its values.
    tasks = max(1, min(BUCKETS, -(-known.count() // BUCKET_ROWS)))
    dealt = cut(known.repartitionByRange(tasks, *k, "v").withColumn("bucket", F.spark_partition_id()))

    edge = lambda at, side, median, mean: F.struct(at.alias("t"), F.lit(side).alias("side"), F.lit(median).alias("median"), F.lit(mean).alias("mean"))
    ends = F.explode(F.array(edge(F.col("at"), 2, 1, 1), edge(F.col("at") - median_days * DAY, 0, -1, 0), edge(F.col("at") - mean_days * DAY, 0, 0, -1)))
    edges = points.join(dealt.select(*k, "bucket").distinct(), k).select(*k, "bucket", "at", ends.alias("e")).select(*k, "bucket", "at", "e.*")
    exact = F.col("v").try_cast(EXACT)
    counted = dealt.select(*k, "bucket", "t", F.lit(1).alias("side"), F.lit(1).alias("n"), F.coalesce(exact, F.lit(0).cast(EXACT)).alias("s"), exact.isNull().cast("int").alias("odd"))
    over = Window.partitionBy(*k, "bucket").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
    run = counted.unionByName(edges, allowMissingColumns=True).withColumns({c: F.coalesce(F.sum(c).over(over), F.lit(0)) for c in ("n", "s", "odd")}).where("at IS NOT NULL")
    parts = run.groupBy(*k, "at", "bucket").agg(F.sum(F.col("n") * F.col("median")).alias("n"), *[F.sum(F.when(F.col("mean") == 1, F.col(c)).when(F.col("mean") == -1, -F.col(c))).alias(f"mean_{c}") for c in ("n", "s", "odd")])

    mean = F.when(F.sum("mean_odd") > 0, F.lit(float("nan"))).otherwise(F.try_divide(F.sum("mean_s").cast("double"), F.sum("mean_n").cast("double")))
    means = parts.groupBy(*k, "at").agg(mean.alias("mean"))

    all_, up_to = Window.partitionBy(*k, "at"), Window.partitionBy(*k, "at").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumns({"total": F.sum("n").over(all_), "before": F.coalesce(F.sum("n").over(up_to), F.lit(0))})
    place = lambda middle: F.when((middle >= F.col("before")) & (middle < F.col("before") + F.col("n")), middle - F.col("before"))
    wanted = placed.where("n > 0").select(*k, "at", "bucket", place(F.floor((F.col("total") - 1) / 2)).alias("low"), place(F.floor(F.col("total") / 2)).alias("high")).where("low IS NOT NULL OR high IS NOT NULL")

    span = lambda t: F.floor(t / (median_days * DAY))
    asked = wanted.withColumn("span", F.explode(F.sequence(span(F.col("at") - median_days * DAY), span(F.col("at")))))
    spanned = dealt.withColumn("span", span(F.col("t")))
    near = spanned.join(asked, [*k, "bucket", "span"]).where((F.col("t") <= F.col("at")) & (F.col("t") >= F.col("at") - median_days * DAY))
    values = near.groupBy(*k, "at", "bucket", "low", "high", "v").agg(F.count("*").alias("n"))
    through = values.withColumn("through", F.sum("n").over(Window.partitionBy(*k, "at", "bucket").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    at_place = lambda c: F.max(F.when((F.col(c) < F.col("through")) & (F.col(c) >= F.col("through") - F.col("n")), F.col("v")))
    medians = through.groupBy(*k, "at").agg(at_place("low").alias("low"), at_place("high").alias("high"))
    median = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(0.5 * F.col("low") + 0.5 * F.col("high"))
    return points.join(means, [*k, "at"], "left").join(medians, [*k, "at"], "left").select(*k, ts, median.alias("median"), "mean")
