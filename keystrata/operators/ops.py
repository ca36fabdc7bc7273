"""Point, multi-key and range reads, writes and deletes over a log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.operators.visible import visible

#: Rows up to which a key list is broadcast; beyond, the join shuffles both sides.
MOST_BROADCAST_KEYS = 100_000


def get(log: DataFrame, key: Column, as_of_ms: int, value: str = "value") -> DataFrame:
    """The visible row of one key; the predicate reaches the scan."""
    return visible(log.where(F.col("key") == key), as_of_ms, value)


def range_scan(log: DataFrame, low: Column, high: Column, as_of_ms: int, value: str = "value") -> DataFrame:
    """Visible rows with low <= key <= high, in key order."""
    return visible(log.where(F.col("key").between(low, high)), as_of_ms, value).orderBy("key")


def multi_get(log: DataFrame, keys: DataFrame, as_of_ms: int, value: str = "value") -> DataFrame:
    """One row for each asked key, with nulls where nothing shows. keys: one column `key`, distinct.

    The log is cut to asked keys before it is resolved. A short key list is broadcast, after its
    length is checked; a longer one is left to adaptive execution, which can filter by Bloom filter.
    """
    few = keys.limit(MOST_BROADCAST_KEYS + 1).count() <= MOST_BROADCAST_KEYS
    asked = log.join(F.broadcast(keys) if few else keys, "key", "left_semi")
    return keys.join(visible(asked, as_of_ms, value), "key", "left")


def put(log: DataFrame, rows: DataFrame) -> DataFrame:
    """The log with further versions."""
    return log.unionByName(rows.select(log.columns))


def delete(log: DataFrame, keys: DataFrame, ts_us: Column, seq: Column, value: str = "value") -> DataFrame:
    """The log with a tombstone for each key, present or not."""
    fields = {f.name: f.dataType for f in log.schema}
    given = {"key": F.col("key"), "ts_us": ts_us, "seq": seq}
    tombs = keys.select(*(given.get(c, F.lit(None)).cast(t).alias(c) for c, t in fields.items()))
    return log.unionByName(tombs)
