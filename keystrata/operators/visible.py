"""Version resolution and visibility: the core contract of the store.

Resolve first, filter afterwards. The newest version of a key wins, where a version is (ts_us, seq);
a winning tombstone or expired value hides its key. Only key predicates may be applied before: both
the aggregate and the window let Catalyst push those down to the scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keystrata.functions.codec import expired

VERSION = ("ts_us", "seq")


def resolve(log: DataFrame, key: Sequence[str] = ("key",), version: Sequence[str] = VERSION) -> DataFrame:
    """The winning row of each key, in the log's columns.

    One map-side combined aggregate: each task sends at most one row for each of its keys, so a hot
    key costs a row for each task and no task sorts all of its versions.
    """
    rest = [c for c in log.columns if c not in key]
    won = log.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("w"))
    return won.select(*key, *(F.col(f"w.{c}").alias(c) for c in rest)).select(log.columns)


def resolve_window(log: DataFrame, key: Sequence[str] = ("key",), version: Sequence[str] = VERSION) -> DataFrame:
    """The same by row number; right for logs that are already partitioned and sorted by key."""
    order = Window.partitionBy(*key).orderBy(*(F.col(c).desc() for c in version))
    return log.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")


def live(value: Column, ts_us: Column, ttl_ms: Column, as_of_ms: int) -> Column:
    """Whether a winning version shows: no tombstone, not expired at as_of_ms."""
    return value.isNotNull() & ~expired(ts_us, ttl_ms, as_of_ms)


def visible(log: DataFrame, as_of_ms: int, value: str = "value", key: Sequence[str] = ("key",)) -> DataFrame:
    """Winning rows that show at as_of_ms."""
    return resolve(log, key).where(live(F.col(value), F.col("ts_us"), F.col("ttl_ms"), as_of_ms))


def union_sources(*sources: DataFrame) -> DataFrame:
    """Delta rows and runs as one log; order doesn't matter, versions decide."""
    first, *rest = sources
    for s in rest:
        first = first.unionByName(s)
    return first
