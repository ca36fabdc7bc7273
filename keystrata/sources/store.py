"""A versioned key-value store in Parquet: range-clustered runs and an append-only manifest.

A run is a folder of Parquet files, sorted by key, with a Bloom filter on it, so point and range
predicates prune files and row groups. Commit order: the run's files first, then one manifest entry;
readers list runs from the manifest only. Removal is logged before any file goes.

Statements go to the delta: one small file each, a log that survives the process. Once the delta is as
large as `delta_bytes`, its newest versions become a level-0 run, and after its entry the delta's files
go; files that a crash leaves hold versions that the run has too, which changes no result. Numbers of
runs and delta files are claimed by creating a file that must not exist, so two writers never share one.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.operators import maintain
from keystrata.operators.visible import resolve

LOG_SCHEMA = "key binary, value binary, ts_us bigint, seq bigint, ttl_ms bigint"
MANIFEST_SCHEMA = "pos bigint, entry_type int, level int, run_id bigint, ckpt_pos bigint, ts_us bigint, records bigint, min_key binary, max_key binary"


class Store:
    """One keyspace under a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, *, fan_in: int = 4, threshold: int = 4, max_level: int = 4, files_per_run: int = 4, delta_bytes: int = 2_621_440):
        self.spark, self.path = spark, path.rstrip("/")
        self.fan_in, self.threshold, self.max_level, self.files_per_run, self.delta_bytes = fan_in, threshold, max_level, files_per_run, delta_bytes
        self.readers: Counter[str] = Counter()  # paths that open cursors of this process read

    def manifest(self) -> DataFrame:
        if not self._exists(f"{self.path}/manifest"):
            return self.spark.createDataFrame([], MANIFEST_SCHEMA)
        return self.spark.read.schema(MANIFEST_SCHEMA).parquet(f"{self.path}/manifest")

    def _fs(self, path: str):
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        where, fs = self._fs(path)
        return fs.exists(where)

    def _append(self, entries: list[tuple]) -> None:
        """Log entries (type, level, run, checkpoint, ts, records, min, max) after the last one."""
        start = self.manifest().agg(F.coalesce(F.max("pos") + 1, F.lit(0))).first()[0]
        rows = [(start + i, *e) for i, e in enumerate(entries)]
        self.spark.createDataFrame(rows, MANIFEST_SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def _claim(self, kind: str, number: int) -> int:
        """The first number from the given one on that nobody has taken; taken for good."""
        while True:
            where, fs = self._fs(f"{self.path}/claims/{kind}.{number}")
            if not fs.exists(where) and fs.createNewFile(where):
                return number
            number += 1

    def _delta(self) -> list[str]:
        """Paths of the delta's files, oldest first."""
        where, fs = self._fs(f"{self.path}/delta")
        return sorted(str(f.getPath()) for f in fs.listStatus(where)) if fs.exists(where) else []

    def put(self, rows: DataFrame, ts_us: int) -> None:
        """Append a statement's versions to the delta, numbered over the whole store; a full delta becomes a run."""
        paths = self._delta()
        number = self._claim("delta", int(paths[-1].rsplit("/", 1)[1]) + 1 if paths else self._next_delta())
        path = f"{self.path}/delta/{number:018d}"
        rows.withColumn("seq", F.col("seq") + F.lit(number << 20)).coalesce(1).write.parquet(path)
        where, fs = self._fs(f"{self.path}/delta")
        if fs.getContentSummary(where).getLength() >= self.delta_bytes:
            self.rotate(ts_us)

    def _next_delta(self) -> int:
        """Behind all numbers ever claimed: the delta may have been emptied."""
        where, fs = self._fs(f"{self.path}/claims")
        names = [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []
        return max((int(n.split(".")[1]) + 1 for n in names if n.startswith("delta.")), default=0)

    def rotate(self, ts_us: int) -> None:
        """The delta's versions become a level-0 run; then its files go."""
        if paths := self._delta():
            self.flush(self.spark.read.schema(LOG_SCHEMA).parquet(*paths), ts_us)
            for path in paths:
                where, fs = self._fs(path)
                if not self.readers[path]:  # else it goes with a later rotation
                    fs.delete(where, True)

    def _run_path(self, level: int, run: int) -> str:
        return f"{self.path}/runs/{level}.{run}"

    def _write_run(self, rows: DataFrame, level: int, ts_us: int) -> list[tuple]:
        """Write a sorted run; the manifest entry that makes it visible is returned, not yet logged."""
        last = self.manifest().where((F.col("level") == level) & (F.col("entry_type") != maintain.CHECKPOINT)).agg(F.max("run_id")).first()[0]
        run = self._claim(f"run-{level}", 0 if last is None else last + 1)
        path = self._run_path(level, run)
        out = rows.repartitionByRange(self.files_per_run, "key").sortWithinPartitions("key")
        out.write.mode("overwrite").option("parquet.bloom.filter.enabled#key", "true").parquet(path)
        s = self.spark.read.schema(LOG_SCHEMA).parquet(path).agg(F.count("*"), F.min("key"), F.max("key")).first()
        return [(maintain.ADD, level, run, None, ts_us, s[0], s[1], s[2])] if s[0] else []

    def flush(self, rows: DataFrame, ts_us: int) -> None:
        """A batch of versions becomes a level-0 run: newest version of each key, tombstones kept."""
        entries = self._write_run(resolve(rows), 0, ts_us)
        if entries:
            self._append(entries)

    def live(self, low: bytes | None = None, high: bytes | None = None) -> DataFrame:
        """Live runs, only those whose keys meet [low, high] if given."""
        stats = self.manifest().where(F.col("entry_type") == maintain.ADD)
        runs = maintain.live_runs(self.manifest()).join(stats, ["level", "run_id"])
        if low is not None:
            runs = maintain.overlapping(runs, F.lit(low), F.lit(high if high is not None else low))
        return runs

    def paths(self, low: bytes | None = None, high: bytes | None = None) -> list[str]:
        """The delta's files, and the folders of the live runs that can hold keys of [low, high]."""
        return self._delta() + [self._run_path(r["level"], r["run_id"]) for r in self.live(low, high).select("level", "run_id").collect()]  # one row for each live run

    def log(self, low: bytes | None = None, high: bytes | None = None) -> DataFrame:
        """All versions, from the delta and the runs that can hold keys of [low, high] (a point without high); unresolved."""
        paths = self.paths(low, high)
        if not paths:
            return self.spark.createDataFrame([], LOG_SCHEMA)
        rows, key = self.spark.read.schema(LOG_SCHEMA).parquet(*paths), F.col("key")
        if low is None:
            return rows
        # Equality, where it is one, so that the scan can ask the Bloom filters.
        return rows.where(key == F.lit(low) if high is None or high == low else key.between(F.lit(low), F.lit(high)))

    def sum_records(self) -> int:
        """Versions in all live runs, as the manifest counts them."""
        return self.live().agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]

    def compact(self, as_of_ms: int, ts_us: int) -> int:
        """Merge the oldest runs of each full level into one run below, top down; the number of merges."""
        merges = 0
        for level in range(self.max_level - 1):
            runs = maintain.live_runs(self.manifest())
            plan = maintain.compaction_plan(runs, self.threshold, self.fan_in, self.max_level).where(F.col("level") == level)
            chosen = [r["run_id"] for r in plan.collect()]  # fan_in rows
            if not chosen:
                continue
            rows = self.spark.read.schema(LOG_SCHEMA).parquet(*(self._run_path(level, r) for r in chosen))
            # If nothing else is there, expired versions hide nothing more.
            oldest = runs.count() == len(chosen) and not self._delta()
            added = self._write_run(maintain.compact(rows, as_of_ms, covers_oldest=oldest), level + 1, ts_us)
            self._append(added + [(maintain.REMOVE, level, r, None, ts_us, None, None, None) for r in chosen])
            merges += 1
        return merges

    def cleanup(self, ts_us: int) -> int:
        """Delete removed runs' files, in manifest order up to the first that is read or can't be deleted, and log a checkpoint."""
        done, upto = 0, None
        for r in maintain.cleanup_candidates(self.manifest()).orderBy("pos").collect():  # one row for each removed run
            path = self._run_path(r["level"], r["run_id"])
            where, fs = self._fs(path)
            if self.readers[path] > 0:
                break
            if fs.exists(where) and not fs.delete(where, True):
                break
            done, upto = done + 1, r["pos"] + 1
        if upto is not None:
            self._append([(maintain.CHECKPOINT, 0, 0, upto, ts_us, None, None, None)])
        return done
