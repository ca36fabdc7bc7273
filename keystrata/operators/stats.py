"""Latency histograms, bucket percentiles, counters, clamped gauges and snapshot reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Upper bounds of the latency buckets in microseconds.
BOUNDS = (
    10, 50, 100, 150, 200, 250, 300, 400, 500, 1000, 1500, 2000, 2500, 3000, 4000, 5000,
    10000, 50000, 100000, 500000, 1000000, 5000000,
)
PERCENTILES = (50, 95, 99)


def bucket(value: Column, bounds: Sequence[int] = BOUNDS) -> Column:
    """Index of the first bound that value doesn't exceed; len(bounds) for the overflow bucket."""
    out = F.when(value <= bounds[0], 0)
    for i, bound in enumerate(bounds[1:], 1):
        out = out.when(value <= bound, i)
    return out.otherwise(len(bounds))


def histogram(rows: DataFrame, by: Sequence[str], value: Column, bounds: Sequence[int] = BOUNDS) -> DataFrame:
    return rows.withColumn("bucket", bucket(value, bounds)).groupBy(*by, "bucket").agg(F.count("*").alias("n"))


def percentiles(rows: DataFrame, by: Sequence[str], value: Column, bounds: Sequence[int] = BOUNDS, sums: bool = False) -> DataFrame:
    """p50, p95 and p99 of each group as bucket upper bounds.

    The threshold is (total div 100) * p and the first bucket that reaches it counts, so a group of
    fewer than 100 values reports the first bound; the overflow bucket reports the last one. Counts
    of all buckets are conditional sums of one aggregate: no cumulative window, one shuffled row for
    each group and task. With `sums` the values' sum is a column too.
    """
    # Through a generator, so that the bucket is computed once and not in each of the sums.
    rows = rows.select(*by, value.alias("_value"), F.explode(F.array(bucket(value, bounds))).alias("_bucket"))
    counted = [F.count(F.when(F.col("_bucket") == i, 1)).alias(f"c{i}") for i in range(len(bounds) + 1)]
    total = [F.count("*").alias("total"), *([F.sum("_value").alias("sum")] if sums else [])]
    wide = rows.groupBy(*by).agg(*total, *counted)
    out = []
    for p in PERCENTILES:
        need = F.call_function("div", F.col("total"), F.lit(100)) * p
        pick, reach = F.when(need <= F.col("c0"), bounds[0]), F.col("c0")
        for i in range(1, len(bounds)):
            reach = reach + F.col(f"c{i}")
            pick = pick.when(need <= reach, bounds[i])
        out.append(pick.otherwise(bounds[-1]).cast("bigint").alias(f"p{p}"))
    return wide.select(*by, "total", *(["sum"] if sums else []), *out)


def gauge(rows: DataFrame, by: Sequence[str], order: Sequence[str], change: Column) -> DataFrame:
    """Running sum that never falls below zero: the plain sum less its lowest point so far, if negative."""
    frame = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("_s", F.sum(change).over(frame))
    return summed.withColumn("gauge", F.col("_s") - F.least(F.lit(0), F.min("_s").over(frame))).drop("_s")


def read_until(snapshots: DataFrame, since: Column, *, most: int = 32, skip: int = 1, ts: str = "ts") -> DataFrame:
    """Newest first, without the newest `skip`, up to the first snapshot at or before since, `most` at most.

    The bound makes one partition enough: only skip + most rows are ordered globally.
    """
    newest = snapshots.orderBy(F.col(ts).desc()).limit(skip + most)
    order = Window.orderBy(F.col(ts).desc())
    numbered = newest.withColumn("nth", F.row_number().over(order)).where(F.col("nth") > skip)
    before = F.lag(ts).over(order)
    return numbered.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_before") > since)).drop("_before")


def scale_out(p95_wait: Column, workers: Column, threshold: int, most: int) -> Column:
    return (p95_wait >= threshold) & (workers < most)
