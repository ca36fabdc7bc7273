"""The raw record format: lengths, key, timestamp, and for a value its flags, bytes and time to live.

A record is `key length (2), key, timestamp (8), value length (2)` and, unless the value is empty (a
tombstone), `flags (1), value` and with the flag for it `time to live (8)`; all numbers are big-endian.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value of the format: the flag of a record with a time to live.
FLAG_TTL = 1
RECORD = "key binary, value binary, ts_us bigint, ttl_ms bigint"


def _number(value: Column, width: int) -> Column:
    return F.unhex(F.lpad(F.hex(value.cast("bigint")), 2 * width, "0"))


def to_record(key: Column, ts_us: Column, value: Column, ttl_ms: Column) -> Column:
    """The bytes of a record. An empty value is a tombstone, as a null one is. Null if the key or time is null, or a
    length needs more than two bytes."""
    present = F.coalesce(F.octet_length(value), F.lit(0)) > 0
    flags = F.when(ttl_ms.isNotNull(), FLAG_TTL).otherwise(0)
    ttl = F.when(ttl_ms.isNotNull(), _number(ttl_ms, 8)).otherwise(F.unhex(F.lit("")))
    body = F.when(present, F.concat(_number(F.octet_length(value), 2), _number(flags, 1), value, ttl)).otherwise(_number(F.lit(0), 2))
    fits = (F.octet_length(key) < 1 << 16) & (F.coalesce(F.octet_length(value), F.lit(0)) < 1 << 16)
    return F.when(fits, F.concat(_number(F.octet_length(key), 2), key, _number(ts_us, 8), body))


def parse(data: bytes) -> Iterator[tuple[bytes, bytes | None, int, int | None]]:
    """(key, value, ts_us, ttl_ms) of records one after another; a record that is cut off raises ValueError."""
    at = 0
    try:
        while at < len(data):
            (n,) = struct.unpack_from(">H", data, at)
            ts, m = struct.unpack_from(">qH", data, at + 2 + n)
            key, at = data[at + 2 : at + 2 + n], at + 12 + n
            if not m:
                yield key, None, ts, None
                continue
            flags, value = data[at], data[at + 1 : at + 1 + m]
            at += 1 + m
            if at > len(data):
                raise IndexError
            ttl = None
            if flags & FLAG_TTL:
                (ttl,) = struct.unpack_from(">q", data, at)
                at += 8
            yield key, value, ts, ttl
    except (struct.error, IndexError):
        raise ValueError(f"the record near byte {at} is cut off") from None


def from_records(data: DataFrame, column: str) -> DataFrame:
    """One row for each record in each row's bytes; null and empty bytes hold none.

    Records have no index, so one value of `column` is read in order by one task; values are spread.
    """

    def run(batches):
        import pyarrow as pa

        types = (pa.binary(), pa.binary(), pa.int64(), pa.int64())
        for batch in batches:
            for one in batch.column(0).to_pylist():
                part = []
                for record in parse(one or b""):
                    part.append(record)
                    if len(part) == 10_000:
                        yield _batch(pa, types, part)
                        part = []
                if part:
                    yield _batch(pa, types, part)

    def _batch(pa, types, rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["key", "value", "ts_us", "ttl_ms"])

    return data.select(F.col(column).cast("binary")).mapInArrow(run, RECORD)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of all files of a folder or pattern, a file (below 2 GB) for each task."""
    return from_records(spark.read.format("binaryFile").load(path), "content")
