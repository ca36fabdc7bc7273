"""Storage maintenance as plans: run statistics, pruning, compaction, manifest replay, cleanup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keystrata.functions.codec import expired
from keystrata.operators.visible import resolve

# Kinds of manifest entries.
ADD, REMOVE, CHECKPOINT = 0, 1, 2


def run_stats(rows: DataFrame, run: str, key: str) -> DataFrame:
    """Record count and smallest and largest key of each run."""
    return rows.groupBy(run).agg(F.count("*").alias("records"), F.min(key).alias("min_key"), F.max(key).alias("max_key"))


def overlapping(stats: DataFrame, low: Column, high: Column) -> DataFrame:
    """Runs whose key interval meets [low, high]."""
    return stats.where((F.col("min_key") <= high) & (F.col("max_key") >= low))


def block_capacity(block_bytes: int, record_bytes: int) -> int:
    """Records of equal size in a block that also holds an offset for each and their count."""
    return (block_bytes - 4) // (record_bytes + 4)


def block_index(rows: DataFrame, key: str, per_block: int, run: str) -> DataFrame:
    """Sparse index: the smallest key of each block of a run whose records are in key order."""
    number = F.row_number().over(Window.partitionBy(run).orderBy(key))
    block = F.call_function("div", number - 1, F.lit(per_block))
    return rows.withColumn("block", block).groupBy(run, "block").agg(F.min(key).alias("min_key"), F.count("*").alias("records"))


def live_runs(manifest: DataFrame) -> DataFrame:
    """Runs whose last add or remove entry is an add; a run's entries are few, and the last one wins."""
    last = manifest.where(F.col("entry_type") != CHECKPOINT).groupBy("level", "run_id").agg(F.max_by("entry_type", "pos").alias("last"))
    return last.where(F.col("last") == ADD).select("level", "run_id")


def last_checkpoint(manifest: DataFrame) -> DataFrame:
    """One row with the newest checkpoint's offset, 0 without any."""
    return manifest.where(F.col("entry_type") == CHECKPOINT).agg(F.coalesce(F.max_by("ckpt_pos", "pos"), F.lit(0)).alias("ckpt_pos"))


def cleanup_candidates(manifest: DataFrame) -> DataFrame:
    """Removals since the last checkpoint, in manifest order."""
    since = last_checkpoint(manifest).first()["ckpt_pos"]  # one number
    return manifest.where((F.col("entry_type") == REMOVE) & (F.col("pos") >= since)).select("pos", "level", "run_id")


def level_counts(runs: DataFrame) -> DataFrame:
    return runs.groupBy("level").agg(F.count("*").alias("files"))


def next_run_id(manifest: DataFrame) -> DataFrame:
    """Per level, one more than the largest id ever used: ids are never used again."""
    return manifest.where(F.col("entry_type") != CHECKPOINT).groupBy("level").agg((F.max("run_id") + 1).alias("next_run_id"))


def compaction_plan(runs: DataFrame, threshold: int, fan_in: int, max_level: int) -> DataFrame:
    """The oldest fan_in runs of each level that holds at least threshold runs and has a level below."""
    order = Window.partitionBy("level").orderBy("run_id")
    counted = runs.withColumn("files", F.count("*").over(Window.partitionBy("level"))).withColumn("nth", F.row_number().over(order))
    return counted.where((F.col("files") >= threshold) & (F.col("nth") <= fan_in) & (F.col("level") + 1 < max_level)).select("level", "run_id")


def compact(rows: DataFrame, as_of_ms: int, covers_oldest: bool = False, value: str = "value") -> DataFrame:
    """One version for each key of the merged runs; tombstones stay.

    An expired winner becomes a tombstone, since an older version may wait in a run that isn't
    merged; if the merge covers every older run it is dropped.
    """
    won = resolve(rows)
    gone = expired(F.col("ts_us"), F.col("ttl_ms"), as_of_ms)
    if covers_oldest:
        return won.where(~gone)
    kept = lambda c: F.when(gone, F.lit(None)).otherwise(F.col(c)).alias(c)
    return won.select(*(kept(c) if c in (value, "ttl_ms") else F.col(c) for c in won.columns))


def cleanup_due(now_us: Column, last_us: Column, removed: Column, interval_us: int, threshold: int) -> Column:
    return (now_us - last_us >= interval_us) & (removed >= threshold)
