"""What several operators share: durable intermediate results and graph components."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only where none is configured."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="keystrata-"))
    return sc._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The same as durable(), as Parquet: smaller on disk, and later reads prune columns."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def worker_cache() -> dict:
    """A dictionary that lives as long as this Python worker, over all tasks that reuse it."""
    return vars(sys.modules.setdefault("_keystrata_worker", types.ModuleType("_keystrata_worker")))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id reachable from each id that has an edge.

    edges: columns a and b, any orientation, repeats allowed. Alternates the large-star and
    small-star steps; each keeps connectivity, and the edge set shrinks to stars around the
    smallest id. A hub's own neighbours are never gathered: each step is a map-side combined
    minimum and a join of the edges with it. Every round is cut in the shared folder.
    """
    now = durable(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    for _ in range(most_rounds):
        # Large star: each larger neighbour of x links to the smallest of x and its neighbours.
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(
            now.select(F.col("v").alias("x"), F.col("u").alias("y"))
        )
        least = both.groupBy("x").agg(F.least("x", F.min("y")).alias("m"))
        large = (
            _join_split(both.where("y > x"), least)
            .select(F.col("y").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        # Small star: each smaller-or-equal neighbour of x links to the smallest of them.
        low = large.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
        small = (
            _join_split(large.select(F.col("u").alias("x"), F.col("v").alias("y")), low)
            .select(F.col("y").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .unionByName(low.select(F.col("x").alias("u"), F.col("m").alias("v")))
            .distinct()
        )
        after = durable(small)
        # Stars only: no id is both a centre and a leaf, and no leaf has two centres.
        leaves = after.groupBy("u").agg(F.count("*").alias("n"))
        loose = after.select(F.col("v").alias("u")).distinct().join(leaves, "u", "left_semi")
        if leaves.where("n > 1").isEmpty() and loose.isEmpty():
            return after.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
                after.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            )
        now = after
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def _join_split(many: DataFrame, one: DataFrame) -> DataFrame:
    """Join on x so that adaptive execution may split a hot x: both sides get their own exchange."""
    return many.withColumn("h", F.xxhash64("x")).join(one.withColumn("h", F.xxhash64("x")), ["h", "x"])
