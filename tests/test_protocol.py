"""Raw records, settings, rendering by type, bulk requests, and metrics from a stream to a request."""

import json
import math

import pytest
from pyspark.sql import functions as F

from keystrata import settings
from keystrata.functions import records, render
from keystrata.functions.codec import WIDTHS
from keystrata.plans import lang, requests
from keystrata.plans.session import METRICS, Connection
from keystrata.sources.store import LOG_SCHEMA, Store
from keystrata.streaming.ring import Ring

VALUES = [
    ("boolean", True), ("boolean", False), ("smallint", -128), ("int", -70_000), ("bigint", -(1 << 63)),
    ("smallserial", 255), ("serial", (1 << 32) - 1), ("bigserial", (1 << 63) - 1), ("bigserial", (1 << 64) - 1),
    ("float", 1.5), ("bigfloat", -0.1), ("bigfloat", math.nan), ("bigfloat", math.inf), ("string", 'a"b\\\n\u00e9'), ("string", ""),
]


def test_values_render_by_their_type_as_the_connection_does(spark):
    rows = [(i, bytearray(lang.typed(k, v).data)) for i, (k, v) in enumerate(VALUES)] + [(99, None), (100, bytearray(b"\xff1")), (101, bytearray())]
    df = spark.createDataFrame(rows, "i int, data binary").repartition(4)
    got = {r.i: (json.loads(r.p), json.loads(r.q)) for r in df.select("i", render.point_json(F.col("data")).alias("p"), render.range_json(F.col("data")).alias("q")).collect()}
    for i, (kind, value) in enumerate(VALUES):
        if kind == "bigfloat" and not math.isfinite(value):
            assert got[i] == (None, None)
        else:
            assert got[i] == (render.point_value(kind, value), render.range_value(kind, value)), (kind, value)
    assert got[0] == ("true", True) and got[8] == ((1 << 64) - 1, str((1 << 64) - 1))
    assert got[99] == got[100] == got[101] == (None, None) and "boolean" in WIDTHS


def test_raw_records_round_trip(spark, tmp_path):
    rows = [(b"k1", b"value", 7, None), (b"k2", b"v" * 300, -8, 10_000), (b"k3", None, 9, None), (b"", b"x", 1 << 60, 0), (b"k" * 65_535, b"w" * 65_535, 2, None)]
    df = spark.createDataFrame([(i, bytearray(k), None if v is None else bytearray(v), t, e) for i, (k, v, t, e) in enumerate(rows)], "i int, key binary, value binary, ts_us bigint, ttl_ms bigint")
    made = {r.i: bytes(r.b) for r in df.select("i", records.to_record(F.col("key"), F.col("ts_us"), F.col("value"), F.col("ttl_ms")).alias("b")).collect()}
    assert made[0] == b"\x00\x02k1" + (7).to_bytes(8, "big") + b"\x00\x05\x00value"
    assert made[1][-8:] == (10_000).to_bytes(8, "big") and made[1][2 + 2 + 8 + 2] == records.FLAG_TTL
    assert made[2] == b"\x00\x02k3" + (9).to_bytes(8, "big") + b"\x00\x00"
    data = b"".join(made[i] for i in range(5))
    assert list(records.parse(data)) == rows
    for cut in (1, 5, 15, len(data) - 1):
        with pytest.raises(ValueError):
            list(records.parse(data[:cut]))
    (tmp_path / "a.bin").write_bytes(data)
    (tmp_path / "b.bin").write_bytes(made[0] * 25_000)
    (tmp_path / "c.bin").write_bytes(b"")
    back = records.read_records(spark, str(tmp_path))
    assert back.count() == 25_005 and back.where("ttl_ms = 10000").count() == 1
    long = df.limit(1).select(records.to_record(F.col("key"), F.col("ts_us"), F.expr("cast(repeat('x', 65536) as binary)"), F.col("ttl_ms")))
    assert long.first()[0] is None


def test_settings():
    got = settings.parse('{"memtable": {"max_size": 1000}, "compaction": {"tiered": {"level_threshold": 3}}, "data_folder": "/x"}')
    assert got.data_folder == "/x" and got.store() == {"fan_in": 2, "threshold": 3, "max_level": 6, "delta_bytes": 1000}
    assert settings.parse("{}") == settings.Settings()
    for bad in ('{"memtable": {"size": 1}}', '{"max_connections": -1}', '{"max_connections": true}', '{"cleanup": 5}', "[]", "{", '{"data_folder": 1}', '{"data_folder": "' + "x" * 1100 + '"}'):
        with pytest.raises(ValueError):
            settings.parse(bad)


def test_bulk_point_reads_answer_as_a_connection(spark, tmp_path):
    client = Connection(Store(spark, str(tmp_path / "kv")))
    client.execute("set 'a' 1, 'b' true, -5 2.5, 'late' 'x' expire '1s', 18446744073709551615 'big', true 'yes'", 1_000_000)
    client.execute("delete 'b'", 2_000_000)
    client.execute("set 'b' false", 3_000_000)
    queries = ["get 'a'", "get 'b'", "get -5", "get 'late'", "get 18446744073709551615", "get true", "get 'none'", "  get  'a' more", "get 7.25", "get 'a'"]
    lines = [json.dumps({"kind": 1, "query": q}) for q in queries]
    other = [json.dumps({"kind": 1, "query": q}) for q in ("set 'a' 2", "get range 'a' 'b'", "get", "GET 'a'", "get 12abc", "get truex")]
    bad = ["no json", '{"query": "get 1"}', '{"kind": 9}', "", None]
    df = spark.createDataFrame([(i, x, "kept") for i, x in enumerate(lines + other + bad)], "key int, line string, value string")
    got = {r["key"]: r for r in requests.answer_gets(df, client.store.log(), 60_000).collect()}
    assert len(got) == len(df.collect()) and all(r["value"] == "kept" for r in got.values())
    for i, line in enumerate(lines):
        assert json.loads(got[i].response) == json.loads(client.request(line, 60_000_000)), line
    assert [got[i].response for i in range(len(lines), len(lines + other))] == [None] * len(other)
    assert all(json.loads(got[i].response)["errors"] == "QueryMalformed" for i in range(len(lines + other), len(got)))
    assert requests.answer_gets(df.limit(0), client.store.log(), 0).count() == 0
    assert requests.answer_gets(df, spark.createDataFrame([], LOG_SCHEMA), 0).where("response is not null").count() == len(lines + bad)


def test_metrics_from_a_stream_reach_a_request(spark, tmp_path):
    schema = "ts timestamp, kind string, value bigint"
    for part in range(6):  # 20 seconds each
        rows = [(part * 20 + s, k, v) for s in range(20) for k, v in [("request_latency", 700)] * 100 + [("request_count", 1)] * 3 + [("memtable", 10), ("worker", 1 if s % 2 == 0 else -1)]]
        df = spark.createDataFrame(rows, "s bigint, kind string, value bigint").select(F.timestamp_seconds("s").alias("ts"), "kind", "value")
        df.coalesce(1).write.parquet(f"{tmp_path}/in/part={part}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/part=*")
    ring = Ring(spark, f"{tmp_path}/ring", size=64)
    query = ring.run(stream, f"{tmp_path}/checkpoint", late="1 second", every=None)
    try:
        assert query.awaitTermination(300)
    finally:
        query.stop()
    rows = ring.read().collect()
    assert len(rows) == 64 and [r.timestamp for r in rows] == sorted({r.timestamp for r in rows}, reverse=True)
    newest = rows[0].timestamp // 1_000_000
    for r in rows:
        second = r.timestamp // 1_000_000
        assert r.request_latency_percentiles == [1000] * 3 and r.queue_wait_percentiles == [0] * 3 and r.request_count == 3
        assert r.memtable_count == 10 * second and r.worker_count == second % 2  # a window's end is its second's number + 1
    client = Connection(Store(spark, str(tmp_path / "kv")), metrics=ring.since)
    ask = lambda since: json.loads(client.request(json.dumps({"kind": METRICS, "timestamp": since}), 0))["data"]
    assert [r["timestamp"] // 1_000_000 for r in ask((newest - 3) * 1_000_000)] == [newest - 1, newest - 2, newest - 3]
    assert len(ask(0)) == 32 and ask(0)[0]["request_count"] == 3
    assert len(list((tmp_path / "ring/ticks").glob("batch=*"))) < 6 and len(list((tmp_path / "ring/bases").glob("upto=*"))) == 1
