"""Whole tables are worked on, and positions hold however the rows fall into partitions."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from keystrata.plans import catalogue, kv, paging  # noqa: F401  (kv registers its queries)

DIR = "/root/testdata/sf0.01"
TABLES = ("orders", "customer", "supplier")


def test_mixed_order_ranks_whole_tables(spark):
    duck = duckdb.connect()
    for t in TABLES:
        duck.sql(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    # Ranges from few samples and not coalesced: two cuts of the same rows differ.
    odd = {"spark.sql.execution.rangeExchange.sampleSizePerPartition": "2", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in odd}
    try:
        for k, v in odd.items():
            spark.conf.set(k, v)
        got = [(r.src, r.id, r.pos) for r in catalogue.queries()["kv_mixed_type_order"](spark, DIR).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(got) == sum(duck.sql(f"select count(*) from {t}").fetchall()[0][0] for t in TABLES)
    want = duck.sql(catalogue.oracle_sql()["kv_mixed_type_order"])
    assert want.columns == ["src", "id", "pos"] and sorted(got) == sorted(want.fetchall())


def records(seed, kind, n):
    """Pairs of stored values: numbers of one size, numbers up to the largest, texts, or some that exceed a page."""
    r = random.Random(seed)
    number = lambda bits: b"\x06" + r.randrange(1 << bits).to_bytes(8, "big")
    text = lambda most: b"\x09" + b"x" * r.randrange(most)
    one = {"even": lambda: number(62), "large": lambda: number(64), "texts": lambda: text(40), "huge": lambda: r.choice([number(64), text(3), text(300)])}[kind]
    return [(one(), one()) for _ in range(n)]


@pytest.mark.parametrize("kind", ["even", "large", "texts", "huge"])
@pytest.mark.parametrize("limit", [0, 1, 40, 128])
def test_a_range_is_folded_for_every_state(kind, limit):
    """A stretch of records in pieces of odd sizes, against the fold from each state that a page can be in there."""
    for seed, n in enumerate((1, 2, 30, 150)):
        part, starts, high, below = records(seed, kind, n), paging.Starts(limit), [], []
        more = [sum(map(paging._digits_above_signed, kv)) for kv in part]
        size = [len(k) + len(v) for k, v in part]
        assert sum(paging._large_digits(pa.array(c, pa.binary())) for c in zip(*part)).tolist() == more
        for i in range(0, n, 13):
            h, b = starts.add(np.array(size[i : i + 13]), np.array(more[i : i + 13]))
            high, below = high + h.tolist(), below + b.tolist()
        for entry in range(limit + 2):
            page, used, want = 0, entry, []
            for s, m in zip(size, more):
                want.append(page)
                page, used = (page + 1, min(s, limit + 1)) if s + 2 * m + used > limit else (page, used + s + m)
            assert [h - (entry < b) for h, b in zip(high, below)] == want
            _, pages, state = max(e for e in starts.end() if e[0] <= entry)
            assert (pages, state if pages else entry + state) == (page, used)


@pytest.fixture
def most_read(spark):
    """Runs a query without coalesced partitions: its rows, and the most that one of its tasks read from a shuffle."""
    context, was = spark.sparkContext, spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")

    def run(query):
        group = f"read-{random.random()}"
        context.setJobGroup(group, group)
        rows = query().collect()
        tracker, store, read = context.statusTracker(), context._jsc.sc().statusStore(), [0]
        for stage in {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}:
            tasks = store.taskList(stage, 0, 1000)
            metrics = [tasks.apply(i).taskMetrics() for i in range(tasks.size())]
            read += [m.get().shuffleReadMetrics().recordsRead() for m in metrics if m.isDefined()]
        return rows, max(read)

    yield run
    context.setLocalProperty("spark.jobGroup.id", None)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)


@pytest.mark.parametrize("kind", ["large", "huge"])
def test_pages_of_ranges_equal_one_fold(spark, most_read, kind):
    rows = sorted(dict(records(7, kind, 3000)).items())
    df = spark.createDataFrame([(bytearray(k), bytearray(v)) for k, v in rows], "key binary, value binary").repartition(8)
    got, most = most_read(lambda: paging.assign_pages(df, 128))
    assert sorted((bytes(r.key), bytes(r.value), r.page) for r in got) == [(k, v, p) for (k, v), p in zip(rows, paging.fold_pages(rows, 128))]
    assert 0 < most < len(rows) / 2
    assert paging.assign_pages(df.limit(0), 128).collect() == []


def test_page_query_has_no_task_with_all_rows(spark, most_read):
    got, most = most_read(lambda: catalogue.queries()["kv_page_assignment"](spark, DIR))
    keys = duckdb.sql(f"select distinct '06' || printf('%016X', o_orderkey) from read_parquet('{DIR}/orders.parquet') order by 1").fetchall()
    assert sorted((r.key, r.bytes, r.page) for r in got) == [(k, 9, p) for (k,), p in zip(keys, paging.fold_pages([(bytes(9), bytes(9))] * len(keys), 512))]
    assert 0 < most < len(keys) / 2
