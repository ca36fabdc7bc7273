"""Structured Streaming: upsert ingest, one-second metric snapshots, and keyed state with a TTL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.operators.stats import percentiles
from keystrata.operators.visible import resolve


def ingest(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, timeout_s: int = 600) -> None:
    """Run all available micro-batches of a log stream, each resolved before sink(rows, batch id).

    Resolving within a batch keeps what is written small; versions decide between batches, so a batch
    that is written again after a failure changes nothing.
    """
    writer = stream.writeStream.foreachBatch(lambda rows, n: sink(resolve(rows), n)).option("checkpointLocation", checkpoint)
    query = writer.trigger(availableNow=True).start()
    try:
        if not query.awaitTermination(timeout_s):
            raise TimeoutError(f"the stream did not end in {timeout_s} s")
    finally:
        query.stop()


def files(spark: SparkSession, folder: str, name: str, schema, per_trigger: int = 1000) -> DataFrame:
    """A stream of the Parquet files called name in a folder."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", name)
    return reader.parquet(folder)


def snapshots(metrics: DataFrame, ts: str = "ts", value: str = "value", kind: str = "kind", late: str = "10 seconds", sums: bool = False) -> DataFrame:
    """Percentiles and counts of each kind in one-second windows; works on streams and tables."""
    rows = metrics.withWatermark(ts, late) if metrics.isStreaming else metrics
    rows = rows.withColumn("tick", F.window(ts, "1 second"))
    return percentiles(rows, ["tick", kind], F.col(value), sums=sums)


def latest_with_ttl(spark: SparkSession, log: DataFrame, ttl_ms: int) -> DataFrame:
    """The newest value of each key as a stream of changes, in state that expires by processing time.

    Needs the RocksDB state store. Where a stream of this is to end (availableNow), batches without
    data must be off, or expiry keeps producing them.
    """
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")

    class Latest(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.state = handle.getValueState("latest", "value double, ts_us long, seq long", ttl_ms)

        def handleInputRows(self, key, rows, timerValues):
            best = tuple(self.state.get()) if self.state.exists() else None
            for frame in rows:
                top = frame.sort_values(["ts_us", "seq"]).iloc[-1]
                if best is None or (top["ts_us"], top["seq"]) > best[1:]:
                    best = (float(top["value"]), int(top["ts_us"]), int(top["seq"]))
            self.state.update(best)
            yield pd.DataFrame({"key": [key[0]], "value": [best[0]], "ts_us": [best[1]]})

        def close(self) -> None:
            pass

    return log.groupBy("key").transformWithStateInPandas(
        statefulProcessor=Latest(), outputStructType="key long, value double, ts_us long", outputMode="Update", timeMode="ProcessingTime"
    )
