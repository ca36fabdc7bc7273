"""Language, codec, order, visibility against a model, store maintenance, paging and protocol."""

import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from keystrata.functions import codec
from keystrata.operators import maintain, stats
from keystrata.operators.visible import resolve, resolve_window, visible
from keystrata.plans import lang
from keystrata.plans.paging import Cursor, assign_pages, fold_pages
from keystrata.plans.session import Connection
from keystrata.sources.store import LOG_SCHEMA, Store


def key(n: int) -> bytes:
    return b"\x06" + n.to_bytes(8, "big")


def log(spark, rows):
    return spark.createDataFrame([(bytearray(k), None if v is None else bytearray(v), t, s, ttl) for k, v, t, s, ttl in rows], LOG_SCHEMA)


def test_tokens():
    assert [t.kind for t in lang.tokenize("1234 -12.34")] == ["number", "number"]
    assert [t.kind for t in lang.tokenize("'test'")] == ["string"]
    assert [t.kind for t in lang.tokenize("true FALSE")] == ["bool", "bool"]
    assert len(lang.tokenize("set 'lamp' 4, 'two words' 12.45, 'off' false")) == 9
    assert lang.tokenize("'open")[0].text == "open"
    assert lang.tokenize("''") == []
    with pytest.raises(lang.QueryError) as e:
        lang.tokenize("get #")
    assert (e.value.name, e.value.position) == ("InvalidToken", 4)


def test_literals():
    kinds = {"0": "smallserial", "255": "smallserial", "256": "serial", "4294967296": "bigserial", "-0": "smallint", "-129": "int", "-2147483649": "bigint", "1.5": "bigfloat"}
    for text, kind in kinds.items():
        assert lang.literal(lang.Token("number", text, 0)).kind == kind
    for text in ("18446744073709551616", "-9223372036854775809"):
        with pytest.raises(lang.QueryError):
            lang.literal(lang.Token("number", text, 0))
    assert lang.literal(lang.Token("bool", "TRUE", 0)).value is False


def test_statements():
    put = lang.parse("set 'lamp' 4 expire '10s', 'desk' 12.45 expire '500ms' 'off' false expire '987'")
    assert [(p[0].value, p[2]) for p in put.pairs] == [("lamp", 10000), ("desk", 500), ("off", 987)]
    assert lang.parse("get range 'a' 'z'").high.value == "z"
    assert lang.parse("set") == lang.Put(())
    for bad in ("get range 'a' 123", "SET 'a' 1", "get", "set 'a'", "set 'a' 1 expire 5", "what 'a'", "   "):
        with pytest.raises(lang.QueryError):
            lang.parse(bad)


def test_ladder_agrees_with_parser(spark):
    texts = ["5", "255", "256", "4294967295", "4294967296", "18446744073709551615", "18446744073709551616", "-5", "-0", "-128", "-129", "-2147483649", "-9223372036854775808", "-9223372036854775809", "1.5", "-2.25", "'x'", "true", "TRUE"]

    def want(t):
        try:
            return lang.literal(lang.tokenize(t)[0]).kind
        except lang.QueryError:
            return None

    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", codec.literal_kind(F.col("t")).alias("k"))
    assert {r.t: r.k for r in df.collect()} == {t: want(t) for t in texts}


@pytest.mark.parametrize(
    "kind,values,sql",
    [
        ("bigserial", ["0", "1", "9223372036854775808", "18446744073709551615"], "decimal(20,0)"),
        ("bigint", ["-1", "-9223372036854775808", "5"], "bigint"),
        ("int", ["-2147483648", "7"], "int"),
        ("smallint", ["-128", "-1", "3"], "tinyint"),
        ("bigfloat", ["-5.5", "0.0", "-0.0", "1.25"], "double"),
        ("float", ["-5.5", "2.5"], "float"),
        ("serial", ["4294967295", "0"], "bigint"),
    ],
)
def test_codec_round_trip(spark, kind, values, sql):
    df = spark.createDataFrame([(v,) for v in values], "t string").select("t", F.col("t").cast(sql).alias("v"))
    for r in df.select("t", "v", codec.encode(F.col("v"), kind).alias("e")).select("*", codec.decode(F.col("e"), kind).alias("d")).collect():
        number = float(r.t) if kind in ("float", "bigfloat") else int(r.t)
        assert bytes(r.e) == lang.typed(kind, number).data
        assert r.d == r.v


def test_order_is_bytewise(spark):
    items = [b"", b"\0", b"\0\0", b"\0\1", b"\0\0\0\0\0", b"\0\0\0\0\2", b"b", b"abcd"]
    got = [bytes(r.k) for r in spark.createDataFrame([(bytearray(i),) for i in items], "k binary").orderBy("k").collect()]
    assert got == sorted(items) and got.index(b"b") > got.index(b"abcd") and got.index(b"\0\1") > got.index(b"\0\0\0\0\2")


def test_negative_floats_come_after_positives(spark):
    values = [3.0, -1.0, -2.0, 0.0, -0.0, 1.0]
    df = spark.createDataFrame([(v,) for v in values], "v double").select(codec.encode(F.col("v"), "bigfloat").alias("k"))
    order = [struct.unpack(">d", bytes(r.k)[1:])[0] for r in df.orderBy("k").collect()]
    assert [str(v) for v in order] == ["0.0", "1.0", "3.0", "-0.0", "-1.0", "-2.0"]


def test_merge_with_expiry(spark):
    now = 1_000_000
    age = {5: (10_000, 5_000), 2: (20_000, 1_000), 4: (5_000, 1), 3: (1_000, 60_000)}
    rows = [(key(k), b"\x04\x01", (now - age.get(k, (0, None))[0]) * 1000, 0, age.get(k, (0, None))[1]) for k in range(1, 9)]
    assert [bytes(r.key) for r in visible(log(spark, rows), now).orderBy("key").collect()] == [key(k) for k in (1, 3, 6, 7, 8)]


def test_three_sources_that_share_a_key(spark):
    rows = [(key(1), b"\x04\x00", 0, 0, None), (key(1), b"\x04\x0a", 10, 0, None), (key(1), b"\x04\x14", 20, 0, None), (key(2), b"\x04\x14", 20, 0, None)]
    got = {bytes(r.key): bytes(r.value) for r in visible(log(spark, rows), 0).collect()}
    assert got == {key(1): b"\x04\x14", key(2): b"\x04\x14"}


def test_random_operations_match_a_model(spark):
    rng = random.Random(7)
    rows = [(key(rng.randrange(20)), None if rng.random() < 0.2 else bytes([4, rng.randrange(256)]), rng.randrange(50) * 1000, i, rng.choice([None, None, 5, 40])) for i in range(400)]
    for now in (0, 20, 60, 100):
        newest: dict = {}
        for r in rows:
            if r[0] not in newest or (r[2], r[3]) > newest[r[0]][2:4]:
                newest[r[0]] = r
        want = {k: r[1] for k, r in newest.items() if r[1] is not None and (r[4] is None or now <= r[2] // 1000 + r[4])}
        assert {bytes(r.key): bytes(r.value) for r in visible(log(spark, rows), now).collect()} == want
    a, b = resolve(log(spark, rows)), resolve_window(log(spark, rows))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_store_flush_compact_cleanup(spark, tmp_path):
    store = Store(spark, str(tmp_path / "kv"), files_per_run=2)
    for run in range(5):
        store.flush(log(spark, [(key(i), b"\x04" + bytes([run]), run, 0, None) for i in range(run * 10, run * 10 + 10)]), run)
    store.flush(log(spark, [(key(3), None, 9, 0, None)]), 9)
    assert store.live(key(5), key(15)).count() == 2  # runs outside aren't read
    assert store.compact(1, 10) == 1
    one = [r for r in store.live().collect() if r["level"] == 1]
    assert [(bytes(r["min_key"]), bytes(r["max_key"]), r["records"]) for r in one] == [(key(0), key(39), 40)]
    assert visible(store.log(), 1).count() == 49  # 3 is deleted
    assert visible(store.log(key(5), key(15)), 1).count() == 11
    assert store.cleanup(11) == 4 and store.cleanup(12) == 0
    again = Store(spark, str(tmp_path / "kv"))
    assert visible(again.log(), 1).count() == 49
    again.flush(log(spark, [(key(99), b"\x04\x01", 20, 0, None)]), 20)
    ids = [r["run_id"] for r in again.live().where("level = 0").collect()]
    assert sorted(ids) == [4, 5, 6]  # never used again


def test_point_predicate_is_pushed_to_runs(spark, tmp_path):
    store = Store(spark, str(tmp_path / "kv"))
    store.flush(log(spark, [(key(i), b"\x04\x01", 1, i, None) for i in range(100)]), 1)
    p = visible(store.log(key(5)), 1)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(key" in p and "ThanOrEqual(key" not in p  # what a Bloom filter can answer
    p = visible(store.log(key(5), key(6)), 1)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(key" in p and "LessThanOrEqual(key" in p


def test_delta_rotates_by_size_and_survives(spark, tmp_path):
    store = Store(spark, str(tmp_path / "kv"), delta_bytes=1 << 30)
    first, second = Connection(store), Connection(store)
    for i in range(3):
        first.execute(f"set 'k{i}' {i}", 1_000_000)
    first.execute("set 'same' 1", 2_000_000)
    second.execute("set 'same' 2", 2_000_000)  # the same microsecond: the later statement wins
    assert store.live().count() == 0 and json.loads(first.execute("get 'same'", 3_000_000))["data"] == 2
    again = Store(spark, str(tmp_path / "kv"), delta_bytes=1)
    assert visible(again.log(), 3_000).count() == 4  # replayed from the delta
    Connection(again).execute("delete 'k0'", 4_000_000)
    assert again.live().count() == 1 and not again._delta() and again.sum_records() == 4
    assert visible(again.log(), 5_000).count() == 3
    Connection(again).execute("set 'k0' 7", 4_000_000)  # numbers go on behind those of an emptied delta
    assert json.loads(first.execute("get 'k0'", 5_000_000))["data"] == 7


def test_writers_never_share_a_run(spark, tmp_path):
    one, two = (Store(spark, str(tmp_path / "kv")) for _ in range(2))
    assert [one._claim("run-0", 0), two._claim("run-0", 0), one._claim("run-0", 0)] == [0, 1, 2]


def test_cleanup_waits_for_cursors(spark, tmp_path):
    store = Store(spark, str(tmp_path / "kv"), fan_in=2, threshold=2, delta_bytes=1)
    c = Connection(store, page_bytes=10)
    for i in range(2):
        c.execute(f"set 'k{i}' {i}, 'm{i}' {i}", 1_000_000 + i)
    c.execute("get range 'a' 'z'", 2_000_000)
    assert store.compact(1, 3_000_000) == 1 and store.cleanup(4_000_000) == 0
    seen = []
    while page := json.loads(c.next_page())["data"]:
        seen += page
    assert seen and store.cleanup(5_000_000) == 2


def test_last_merge_drops_expired_versions(spark, tmp_path):
    store = Store(spark, str(tmp_path / "kv"), fan_in=2, threshold=2, delta_bytes=1)
    c = Connection(store)
    c.execute("set 'old' 1 expire '1ms'", 1_000_000)
    c.execute("set 'new' 1", 1_000_001)
    assert store.compact(5_000, 9_000_000) == 1 and store.sum_records() == 1


def test_partial_compaction_turns_expired_into_tombstones(spark):
    rows = log(spark, [(key(1), b"\x04\x01", 0, 0, 5), (key(2), b"\x04\x01", 0, 1, None)])
    got = {bytes(r.key): r.value for r in maintain.compact(rows, 100).collect()}
    assert got[key(1)] is None and bytes(got[key(2)]) == b"\x04\x01"
    assert maintain.compact(rows, 100, covers_oldest=True).count() == 1


def test_block_capacity():
    assert maintain.block_capacity(86, 22) == 3 and maintain.block_capacity(108, 22) == 4


def test_percentiles_below_a_hundred(spark):
    df = spark.createDataFrame([("a", 700)] * 99 + [("b", 700)] * 100 + [("c", 9_000_000)] * 100, "g string, v bigint")
    got = {r.g: (r.p50, r.p95, r.p99) for r in stats.percentiles(df, ["g"], F.col("v")).collect()}
    assert got == {"a": (10, 10, 10), "b": (1000, 1000, 1000), "c": (5_000_000,) * 3}


def test_gauge_never_falls_below_zero(spark):
    steps = [-1, 1, 1, -1, -1, -1, 1]
    df = spark.createDataFrame([(0, i, s) for i, s in enumerate(steps)], "g int, i int, s int")
    got = [r.gauge for r in stats.gauge(df, ["g"], ["i"], F.col("s")).orderBy("i").collect()]
    level, want = 0, []
    for s in steps:
        level = max(0, level + s)
        want.append(level)
    assert got == want


def test_read_until_is_inclusive_and_skips_the_newest(spark):
    df = spark.createDataFrame([(i,) for i in range(100)], "ts bigint")
    assert [r.ts for r in stats.read_until(df, F.lit(95)).collect()] == [98, 97, 96, 95]
    assert len(stats.read_until(df, F.lit(-1)).collect()) == 32


def test_pages(spark):
    records = [(key(i), b"\x04\x01") for i in range(30)]
    pages = list(fold_pages(records, 40))
    df = spark.createDataFrame([(bytearray(k), bytearray(v)) for k, v in records], "key binary, value binary")
    assert [r.page for r in assign_pages(df, 40).orderBy("key").collect()] == pages
    cursor, got, n = Cursor(df, 40), [], 0
    while page := cursor.page():
        got += [n] * len(page)
        n += 1
    assert got == pages and pages[0] == 0 and pages[-1] > 5
    assert cursor.page() == []


def test_protocol(spark, tmp_path):
    c = Connection(Store(spark, str(tmp_path / "kv")), page_bytes=24)
    ask = lambda q, t=1_000_000_000, kind=1: json.loads(c.request(json.dumps({"kind": kind, "query": q, "timestamp": 0}), t))
    assert ask("set 1 true, 2 18446744073709551615, 3 -5 expire '1s'") == {"data": 0, "errors": None}
    assert ask("get 1") == {"data": "true", "errors": None}
    first = ask("get range 1 9")
    pages = first["data"] + (second := ask("", kind=2))["data"]
    assert pages == [{"key": 1, "value": True}, {"key": 2, "value": "18446744073709551615"}, {"key": 3, "value": -5}] and second["data"]
    assert ask("get 3", 1_000_000_000 + 1_001_000) == {"data": None, "errors": None}
    assert ask("delete 7") == {"data": 0, "errors": None}
    assert ask("", kind=2) == {"data": None, "errors": "QueryMalformed"}
    assert ask("get #") == {"data": 4, "errors": "InvalidToken"}
    assert c.request("no json", 0) == '{"data":null,"errors":"QueryMalformed"}\n'
