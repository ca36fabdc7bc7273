"""Streams that end: upsert ingest, one-second snapshots, keyed state with a time to live."""

from pyspark.sql import functions as F

from keystrata.operators.visible import resolve
from keystrata.streaming import ingest

LOG = "key long, value double, ts_us long, seq long"


def folder(spark, path, *parts):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, LOG).coalesce(1).write.parquet(f"{path}/in/part={i}")
    return f"{path}/in"


def source(spark, path):
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(f"{path}/part=*")


def test_ingest_keeps_the_newest_of_all_batches(spark, tmp_path):
    data = folder(spark, tmp_path, [(1, 1.0, 10, 0), (2, 5.0, 10, 1)], [(1, 2.0, 30, 2), (1, 3.0, 20, 3)], [(2, 6.0, 5, 4)])
    sink = lambda rows, n: rows.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}")
    ingest.ingest(source(spark, data), sink, f"{tmp_path}/checkpoint", timeout_s=120)
    got = {r.key: r.value for r in resolve(spark.read.parquet(f"{tmp_path}/out").drop("batch")).collect()}
    assert got == {1: 2.0, 2: 5.0}


def test_snapshots_in_windows(spark):
    rows = [(f"2024-01-01 00:00:0{i % 2}", "latency", 700) for i in range(400)]
    df = spark.createDataFrame(rows, "ts string, kind string, value bigint").withColumn("ts", F.col("ts").cast("timestamp"))
    got = ingest.snapshots(df).collect()
    assert [(r.total, r.p50, r.p99) for r in got] == [(200, 1000, 1000)] * 2


def test_latest_with_ttl_ends(spark, tmp_path):
    data = folder(spark, tmp_path, [(1, 1.0, 10, 0), (2, 5.0, 10, 1)], [(1, 2.0, 30, 2)])
    out = ingest.latest_with_ttl(spark, source(spark, data), 3_600_000)
    query = out.writeStream.format("memory").queryName("ttl_latest").outputMode("update").option("checkpointLocation", f"{tmp_path}/ttl").trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(120)
        rows = spark.table("ttl_latest").collect()
    finally:
        query.stop()
    assert {r.key: r.value for r in sorted(rows, key=lambda r: r.ts_us)} == {1: 2.0, 2: 5.0}
