"""The newest snapshots of a stream of metrics, kept as a short table that metrics requests read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keystrata.operators.stats import read_until
from keystrata.streaming.ingest import snapshots

# Fixed values of the protocol: kinds of metrics, those with percentiles, the counter and the two gauges.
TIMED = ("request_latency", "task_latency", "queue_wait")
COUNTED = "request_count"
GAUGES = {"memtable": "memtable_count", "worker": "worker_count"}
FIELDS = [f"{k}_percentiles" for k in TIMED] + [COUNTED, *GAUGES.values()]
SCHEMA = "timestamp bigint, " + ", ".join(f"{k}_percentiles array<bigint>" for k in TIMED) + f", {COUNTED} bigint, memtable_change bigint, worker_change bigint"

BASE = "memtable_count bigint, worker_count bigint, upto bigint"


class Ring:
    """Snapshots of one second each, the newest `size` of them, in one folder for each micro-batch.

    A batch that is run again replaces its own folder. After each batch, folders go whose snapshots are
    all older than the newest `size`. Before that the gauges' values at their end are written as a base; batches
    up to the newest base don't count any more, so a crash in between changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, size: int = 64):
        self.spark, self.path, self.size = spark, path.rstrip("/"), size

    def run(self, metrics: DataFrame, checkpoint: str, *, late: str = "10 seconds", every: str | None = "1 second", **names: str):
        """Start the stream of (ts, kind, value) rows; without `every` it takes what there is and ends."""
        ticks = snapshots(metrics, late=late, sums=True, **names)
        kind = names.get("kind", "kind")
        out = ticks.select("tick", F.col(kind).alias("kind"), "total", "sum", "p50", "p95", "p99")
        writer = out.writeStream.outputMode("append").foreachBatch(self.push).option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()

    def push(self, ticks: DataFrame, batch: int) -> None:
        """Add the snapshots of a batch: (tick, kind, total, sum, p50, p95, p99), all kinds of a tick in one batch."""
        of = lambda k, c: F.max(F.when(F.col("kind") == k, c))
        zero = F.array(*[F.lit(0).cast("bigint")] * 3)
        fields = [F.coalesce(of(k, F.array("p50", "p95", "p99")), zero).alias(f"{k}_percentiles") for k in TIMED]
        fields.append(F.coalesce(of(COUNTED, F.col("total")), F.lit(0)).alias(COUNTED))
        fields += [F.coalesce(of(k, F.col("sum").cast("bigint")), F.lit(0)).alias(f"{k}_change") for k in GAUGES]
        wide = ticks.groupBy(F.unix_micros("tick.end").alias("timestamp")).agg(*fields)
        wide.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/ticks/batch={batch}")
        self._prune()

    def _rows(self) -> DataFrame:
        """Snapshots behind the newest base, with gauges as running sums that never fall below zero at a tick."""
        fs, where = self._folder("bases")
        base = self.spark.read.schema(BASE).parquet(f"{self.path}/bases").orderBy(F.col("upto").desc()).first() if fs.exists(where) else None
        out = self.spark.read.schema(f"{SCHEMA}, batch bigint").parquet(f"{self.path}/ticks")
        if base is not None:
            out = out.where(F.col("batch") > base["upto"])
        over = Window.orderBy("timestamp").rowsBetween(Window.unboundedPreceding, 0)  # some more rows than `size`
        for k, name in GAUGES.items():
            out = out.withColumn("_s", F.sum(f"{k}_change").over(over) + F.lit(0 if base is None else base[name]))
            out = out.withColumn(name, F.col("_s") - F.least(F.lit(0), F.min("_s").over(over))).drop("_s")
        return out

    def _folder(self, name: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _prune(self) -> None:
        rows = self._rows()
        newest = rows.orderBy(F.col("timestamp").desc()).limit(self.size).agg(F.count("*"), F.min("timestamp")).first()
        if newest[0] < self.size:
            return
        ends = rows.groupBy("batch").agg(F.max(F.struct("timestamp", *GAUGES.values())).alias("end")).select("batch", "end.*")
        gone = ends.where(F.col("timestamp") < newest[1]).orderBy("batch").collect()  # the batches since the last base
        if not gone:
            return
        last = gone[-1]
        row = self.spark.createDataFrame([tuple(last[g] for g in GAUGES.values())], BASE.split(", upto")[0])
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/bases/upto={last['batch']}")
        for kind, name in (("ticks", "batch"), ("bases", "upto")):
            fs, where = self._folder(kind)
            for f in fs.listStatus(where):
                number = f.getPath().getName().removeprefix(f"{name}=")
                if number.isdigit() and int(number) < last["batch"] + (kind == "ticks"):
                    fs.delete(f.getPath(), True)

    def read(self) -> DataFrame:
        """The newest snapshots."""
        return self._rows().select("timestamp", *FIELDS).orderBy(F.col("timestamp").desc()).limit(self.size)

    def since(self, timestamp: int) -> DataFrame:
        """Answer of a metrics request, for a Connection: half the ring at most, newest first, without the newest."""
        return read_until(self.read(), F.lit(timestamp), most=self.size // 2, ts="timestamp").select("timestamp", *FIELDS)
