"""The catalogue's queries: the driver's tables read as logs, runs, manifests and metrics."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.functions import codec, records, render
from keystrata.operators import maintain, ops, stats
from keystrata.operators.visible import live, resolve, resolve_window, union_sources, visible
from keystrata.plans import paging, requests
from keystrata.plans.catalogue import query
from keystrata.session import table, written
from keystrata.streaming import ingest

AS_OF_MS = 1_705_708_800_000  # 2024-01-20, inside the events' month
FAR_MS = 4_102_444_800_000
DIV = lambda a, b: F.call_function("div", a, F.lit(b))  # noqa: E731  integer division


def _micros(c: str) -> F.Column:
    """Epoch microseconds of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {c})")


def _orders(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("value"), _micros("o_orderdate").alias("ts_us"), F.col("o_custkey").alias("seq"), F.lit(None).cast("bigint").alias("ttl_ms"))


def _events(spark: SparkSession, d: str, tombstone: str | None = "error", ttl: bool = False) -> DataFrame:
    """events as a log by user: one type deletes, and types may have different times to live."""
    e = table(spark, d, "events")
    value = F.col("value") if tombstone is None else F.when(F.col("event_type") != tombstone, F.col("value"))
    days = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", 5).when(F.col("event_type") == "purchase", 30)
    ttl_ms = (days.cast("bigint") * 86_400_000 if ttl else F.lit(None)).cast("bigint")
    return e.select(F.col("user_id").alias("key"), value.alias("value"), _micros("ts").alias("ts_us"), F.col("event_id").alias("seq"), ttl_ms.alias("ttl_ms"))


RN = "row_number() over (partition by user_id order by ts desc, event_id desc) = 1"
TTL = "case event_type when 'click' then 86400000 when 'view' then 432000000 when 'purchase' then 2592000000 end"


@query("select o_orderkey as key, o_totalprice as value from orders where o_orderkey = 4242 qualify row_number() over (partition by o_orderkey order by o_orderdate desc, o_custkey desc) = 1")
def kv_point_get(spark, d):
    return ops.get(_orders(spark, d), F.lit(4242).cast("bigint"), FAR_MS).select("key", "value")


@query("select k.key, v.o_totalprice as value from (select unnest([1, 77, 1234, 4242, 9999, 123456789]) as key) k left join (select * from orders qualify row_number() over (partition by o_orderkey order by o_orderdate desc, o_custkey desc) = 1) v on v.o_orderkey = k.key")
def kv_multi_get(spark, d):
    keys = spark.createDataFrame([(k,) for k in (1, 77, 1234, 4242, 9999, 123456789)], "key bigint")
    return ops.multi_get(_orders(spark, d), keys, FAR_MS).select("key", "value")


@query("select o_orderkey as key, o_totalprice as value from orders where o_orderkey between 1000 and 2000 qualify row_number() over (partition by o_orderkey order by o_orderdate desc, o_custkey desc) = 1")
def kv_range_scan(spark, d):
    return ops.range_scan(_orders(spark, d), F.lit(1000).cast("bigint"), F.lit(2000).cast("bigint"), FAR_MS).select("key", "value")


@query(f"select user_id as key, value, epoch_us(ts) as ts_us from events qualify {RN}")
def kv_latest_version(spark, d):
    return resolve(_events(spark, d, None)).select("key", "value", "ts_us")


@query(f"select user_id as key, value, epoch_us(ts) as ts_us from events qualify {RN}")
def kv_latest_version_window(spark, d):
    return resolve_window(_events(spark, d, None)).select("key", "value", "ts_us")


@query(f"select user_id as key, value from (select * from events qualify {RN}) where event_type <> 'error'")
def kv_tombstone_visible(spark, d):
    return visible(_events(spark, d), FAR_MS).select("key", "value")


@query(f"select user_id as key, value from (select *, {TTL} ttl from events qualify {RN}) where event_type <> 'error' and (ttl is null or {AS_OF_MS} <= epoch_us(ts) // 1000 + ttl)")
def kv_ttl_visible(spark, d):
    return visible(_events(spark, d, ttl=True), AS_OF_MS).select("key", "value")


@query(f"select user_id as key, event_id as winner, (ttl is not null and {AS_OF_MS} > epoch_us(ts) // 1000 + ttl) as hidden from (select *, {TTL} ttl from events qualify {RN})")
def kv_expired_winner_hides(spark, d):
    won = resolve(_events(spark, d, None, ttl=True))
    return won.select("key", F.col("seq").alias("winner"), (~live(F.col("value"), F.col("ts_us"), F.col("ttl_ms"), AS_OF_MS)).alias("hidden"))


@query("select o_orderkey as key, o_totalprice as value from orders where o_orderkey % 3 <> 0 qualify row_number() over (partition by o_orderkey order by o_orderdate desc, o_custkey desc) = 1")
def kv_delete_then_get(spark, d):
    log = _orders(spark, d)
    gone = log.where("key % 3 = 0").select("key")
    return visible(ops.delete(log, gone, F.lit(FAR_MS * 1000), F.lit(0)), FAR_MS).select("key", "value")


LITERALS = "(select p_partkey, case p_partkey % 9 when 0 then '' || p_partkey when 1 then '-' || p_partkey when 2 then p_partkey || '.5' when 3 then '''' || p_partkey || '''' when 4 then 'true' when 5 then '' || (p_partkey::bigint * 4294967) when 6 then '-' || (p_partkey::bigint * 42949672) when 7 then '18446744073709' || lpad('' || (p_partkey % 1000000), 6, '0') else '-' || p_partkey || '00000000000000000' end lit from part)"


@query(f"""select p_partkey, lit, case when lit like '''%' then 'string' when lit = 'true' then 'boolean' when contains(lit, '.') then 'bigfloat'
  when lit like '-%' then case when try_cast(lit as tinyint) is not null then 'smallint' when try_cast(lit as integer) is not null then 'int' when try_cast(lit as bigint) is not null then 'bigint' end
  when try_cast(lit as utinyint) is not null then 'smallserial' when try_cast(lit as uinteger) is not null then 'serial' when try_cast(lit as ubigint) is not null then 'bigserial' end kind from {LITERALS}""")
def kv_typed_literals(spark, d):
    n, s = F.col("p_partkey"), F.col("p_partkey").cast("string")
    wide = n.cast("decimal(38,0)")
    forms = [
        s, F.concat(F.lit("-"), s), F.concat(s, F.lit(".5")), F.concat(F.lit("'"), s, F.lit("'")), F.lit("true"), (wide * 4294967).cast("string"),
        F.concat(F.lit("-"), (wide * 42949672).cast("string")), F.concat(F.lit("18446744073709"), F.lpad((n % 1000000).cast("string"), 6, "0")), F.concat(F.lit("-"), s, F.lit("0" * 17)),
    ]
    lit = forms[-1]
    for i, form in enumerate(forms[:-1]):
        lit = F.when(n % 9 == i, form).otherwise(lit)
    return table(spark, d, "part").select("p_partkey", lit.alias("lit")).select("p_partkey", "lit", codec.literal_kind(F.col("lit")).alias("kind"))


@query("select o_orderkey, printf('06%016X', o_orderkey) as serial_hex, printf('02%08X', case when o_orderkey % 2 = 0 then o_orderkey % 100000 else 4294967296 - o_orderkey % 100000 end) as int_hex, '09' || hex(encode(o_orderstatus)) as text_hex from orders")
def kv_key_encoding(spark, d):
    k = F.col("o_orderkey")
    small = F.when(k % 2 == 0, k % 100000).otherwise(-(k % 100000))
    return table(spark, d, "orders").select(
        k, F.hex(codec.encode(k, "bigserial")).alias("serial_hex"), F.hex(codec.encode(small, "int")).alias("int_hex"), F.hex(codec.encode(F.col("o_orderstatus"), "string")).alias("text_hex")
    )


@query("select s_suppkey, row_number() over (order by s_acctbal < 0, abs(s_acctbal), s_suppkey) as pos from supplier")
def kv_key_order(spark, d):
    rows = table(spark, d, "supplier").select("s_suppkey", codec.encode(F.col("s_acctbal"), "bigfloat").alias("key"))
    return _numbered(rows, ["key", "s_suppkey"]).select("s_suppkey", "pos")


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Global positions without gathering all rows in one task: range partitions, then their offsets.

    The ranges are cut from a sample, so they are written once: cut twice, they need not be the same.
    """
    from pyspark.sql import Window

    cut = rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    cut = cut.withColumn("nth", F.row_number().over(Window.partitionBy("part").orderBy(*order)))
    local = written(cut)
    counts = local.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("part", before.alias("off"))  # one row for each partition
    return local.join(F.broadcast(offsets), "part").withColumn("pos", (F.col("off") + F.col("nth")).cast("bigint")).drop("part", "nth", "off")


@query("""select src, id, row_number() over (order by tag, f < 0, abs(f), h, id) as pos from (select 'order' src, o_orderkey id, 6 tag, 0.0::double f, printf('%016X', o_orderkey) h from orders
  union all select 'customer', c_custkey, 9, 0.0, hex(encode(c_name)) from customer union all select 'supplier', s_suppkey, 8, s_acctbal::double, '' from supplier)""")
def kv_mixed_type_order(spark, d):
    """All rows of the three tables, as one domain of keys."""
    row = lambda t, src, key, val, kind: table(spark, d, t).select(F.lit(src).alias("src"), F.col(key).cast("bigint").alias("id"), codec.encode(F.col(val), kind).alias("key"))
    rows = union_sources(row("orders", "order", "o_orderkey", "o_orderkey", "bigserial"), row("customer", "customer", "c_custkey", "c_name", "string"), row("supplier", "supplier", "s_suppkey", "s_acctbal", "bigfloat"))
    return _numbered(rows, ["key", "id"]).select("src", "id", "pos")


@query("select l_linenumber as run, count(*) as records, min(l_orderkey) as min_key, max(l_orderkey) as max_key from lineitem group by 1")
def kv_flush_run_stats(spark, d):
    return maintain.run_stats(table(spark, d, "lineitem").withColumnRenamed("l_linenumber", "run"), "run", "l_orderkey")


def _order_runs(spark, d):
    return table(spark, d, "orders").select(DIV(F.col("o_orderkey"), 1000).alias("run"), F.col("o_orderkey").alias("key"))


@query("select run, min_key, max_key from (select o_orderkey // 1000 as run, min(o_orderkey) min_key, max(o_orderkey) max_key from orders group by 1) where min_key <= 5500 and max_key >= 2500")
def kv_range_overlap_prune(spark, d):
    return maintain.overlapping(maintain.run_stats(_order_runs(spark, d), "run", "key"), F.lit(2500), F.lit(5500)).select("run", "min_key", "max_key")


@query("select run, block, min(key) as min_key from (select o_orderkey // 1000 as run, o_orderkey as key, (row_number() over (partition by o_orderkey // 1000 order by o_orderkey) - 1) // 64 as block from orders) group by 1, 2")
def kv_sparse_index(spark, d):
    return maintain.block_index(_order_runs(spark, d), "key", 64, "run").select("run", "block", "min_key")


@query("select run, block, min(key) as min_key, count(*) as records from (select o_orderkey // 1000 as run, o_orderkey as key, (row_number() over (partition by o_orderkey // 1000 order by o_orderkey) - 1) // 157 as block from orders) group by 1, 2")
def kv_block_fill(spark, d):
    return maintain.block_index(_order_runs(spark, d), "key", maintain.block_capacity(4096, 22), "run")


RUNS = "(select cast(s_nationkey % 4 as integer) as level, s_suppkey as run_id from supplier)"


def _runs(spark, d):
    return table(spark, d, "supplier").select((F.col("s_nationkey") % 4).cast("int").alias("level"), F.col("s_suppkey").alias("run_id"))


@query(f"select level, run_id from (select *, count(*) over (partition by level) c, row_number() over (partition by level order by run_id) rn from {RUNS}) where c >= 4 and rn <= 4 and level + 1 < 4")
def kv_compaction_plan(spark, d):
    return maintain.compaction_plan(_runs(spark, d), 4, 4, 4)


@query(f"""select user_id as key, case when gone then null else value end as value, epoch_us(ts) as ts_us, case when gone then null else ttl end as ttl_ms from
  (select *, coalesce({AS_OF_MS} > epoch_us(ts) // 1000 + ttl, false) gone from (select user_id, ts, event_id, case when event_type <> 'error' then value end as value, {TTL} as ttl from events where event_id % 5 < 4 qualify {RN}))""")
def kv_compaction_merge(spark, d):
    merged = _events(spark, d, ttl=True).where("seq % 5 < 4")  # four of five runs
    return maintain.compact(merged, AS_OF_MS).select("key", "value", "ts_us", "ttl_ms")


MANIFEST = """(select o_orderkey as pos, case o_orderstatus when 'F' then 1 when 'O' then 0 else 2 end as entry_type, cast(o_custkey % 5 as integer) as level, o_custkey as run_id,
  case when o_orderstatus not in ('F', 'O') then o_orderkey - 100 end as ckpt_pos, epoch_us(o_orderdate) as ts_us from orders)"""


def _manifest(spark, d):
    o = table(spark, d, "orders")
    kind = F.when(F.col("o_orderstatus") == "F", maintain.REMOVE).when(F.col("o_orderstatus") == "O", maintain.ADD).otherwise(maintain.CHECKPOINT)
    ckpt = F.when(~F.col("o_orderstatus").isin("F", "O"), F.col("o_orderkey") - 100)
    return o.select(F.col("o_orderkey").alias("pos"), kind.alias("entry_type"), (F.col("o_custkey") % 5).cast("int").alias("level"), F.col("o_custkey").alias("run_id"), ckpt.alias("ckpt_pos"), _micros("o_orderdate").alias("ts_us"))


LIVE = f"(select level, run_id from {MANIFEST} where entry_type <> 2 group by all having arg_max(entry_type, pos) = 0)"


@query(f"select level, run_id from {LIVE}")
def kv_manifest_live(spark, d):
    return maintain.live_runs(_manifest(spark, d))


@query(f"select pos, level, run_id from {MANIFEST} where entry_type = 1 and pos >= coalesce((select arg_max(ckpt_pos, pos) from {MANIFEST} where entry_type = 2), 0)")
def kv_cleanup_candidates(spark, d):
    return maintain.cleanup_candidates(_manifest(spark, d))


@query(f"select level, count(*) as files from {LIVE} group by 1")
def kv_level_counts(spark, d):
    return maintain.level_counts(maintain.live_runs(_manifest(spark, d)))


@query(f"select level, max(run_id) + 1 as next_run_id from {MANIFEST} where entry_type <> 2 group by 1")
def kv_next_run_id(spark, d):
    return maintain.next_run_id(_manifest(spark, d))


@query(f"""select level, count(*) filter (entry_type = 1) as removed, max(ts_us) - min(ts_us) >= 60000000 and count(*) filter (entry_type = 1) >= 5 as due from {MANIFEST} group by 1""")
def kv_cleanup_trigger(spark, d):
    by = _manifest(spark, d).groupBy("level").agg(F.count(F.when(F.col("entry_type") == maintain.REMOVE, 1)).alias("removed"), F.max("ts_us").alias("now"), F.min("ts_us").alias("last"))
    return by.select("level", "removed", maintain.cleanup_due(F.col("now"), F.col("last"), F.col("removed"), 60_000_000, 5).alias("due"))


def _latency(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", "event_type", F.floor(F.col("value") * 100).cast("bigint").alias("us"), DIV(_micros("ts"), 86_400_000_000).alias("day"), _micros("ts").alias("ts_us"))


LAT = "(select event_id, event_type, cast(floor(value * 100) as bigint) us, epoch_us(ts) // 86400000000 as day, epoch_us(ts) ts_us from events)"
BUCKET = "case " + " ".join(f"when us <= {b} then {i}" for i, b in enumerate(stats.BOUNDS)) + f" else {len(stats.BOUNDS)} end"


@query(f"select event_type, {BUCKET} as bucket, count(*) as n from {LAT} group by 1, 2")
def kv_latency_histogram(spark, d):
    return stats.histogram(_latency(spark, d), ["event_type"], F.col("us"))


def _percentile_sql(by: str) -> str:
    bounds = ", ".join(f"({i}, {b})" for i, b in enumerate(stats.BOUNDS))
    pick = ", ".join(f"coalesce(min(bound) filter (cum >= need * {p}), {stats.BOUNDS[-1]}) as p{p}" for p in stats.PERCENTILES)
    return f"""with l as (select *, {BUCKET} b from {LAT}), t as (select {by}, count(*) total from l group by 1), g as (select * from t, (values {bounds}) v(i, bound)),
  c as (select g.*, total // 100 need, (select count(*) from l where l.{by} = g.{by} and l.b <= g.i) cum from g)
  select {by}, total, {pick} from c group by {by}, total"""


@query(_percentile_sql("day"))
def kv_percentile_snapshot(spark, d):
    return stats.percentiles(_latency(spark, d), ["day"], F.col("us"))


@query("select epoch_us(ts) // 3600000000 as hour, count(*) as requests from events group by 1")
def kv_request_counter(spark, d):
    return table(spark, d, "events").groupBy(DIV(_micros("ts"), 3_600_000_000).alias("hour")).agg(F.count("*").alias("requests"))


CHANGE = "case event_type when 'signup' then 1 when 'error' then -1 else 0 end"


@query(f"""select user_id, event_id, cast(s - least(0, min(s) over (partition by user_id order by ts, event_id)) as bigint) as gauge from
  (select *, sum({CHANGE}) over (partition by user_id order by ts, event_id rows unbounded preceding) s from events)""")
def kv_gauge_clamped(spark, d):
    change = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "error", -1).otherwise(0)
    return stats.gauge(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], change).select("user_id", "event_id", F.col("gauge").cast("bigint").alias("gauge"))


@query("""select day, n from (select *, row_number() over (order by day desc) rn, lag(day) over (order by day desc) prev from (select epoch_us(ts) // 86400000000 as day, count(*) n from events group by 1))
  where rn between 2 and 33 and (rn = 2 or prev > 19735)""")
def kv_read_until(spark, d):
    days = _latency(spark, d).groupBy("day").agg(F.count("*").alias("n"))
    return stats.read_until(days, F.lit(19735), ts="day").select("day", "n")


@query(f"""with p as ({_percentile_sql("day")}), w as (select *, row_number() over (order by day) % 9 as workers from p)
  select day, p95, workers, p95 >= 800 and workers < 8 as scale_out from w""")
def kv_autoscale_rule(spark, d):
    from pyspark.sql import Window

    days = stats.percentiles(_latency(spark, d), ["day"], F.col("us"))  # one row for each tick
    workers = (F.row_number().over(Window.orderBy("day")) % 9).cast("bigint")
    return days.select("day", "p95", workers.alias("workers")).withColumn("scale_out", stats.scale_out(F.col("p95"), F.col("workers"), 800, 8))


@query("select event_type as kind, epoch_us(ts) // 86400000000 as tick, count(*) as n, cast(sum(floor(value * 100)) as bigint) as total from events group by 1, 2")
def kv_metric_dispatch(spark, d):
    return _latency(spark, d).groupBy(F.col("event_type").alias("kind"), F.col("day").alias("tick")).agg(F.count("*").alias("n"), F.sum("us").alias("total"))


@query("""with recursive r as (select k, row_number() over (order by k) n from (select distinct o_orderkey k from orders)),
  p(n, page, used) as (select 1::bigint, 0::bigint, 0::bigint union all
    select n + 1, case when 18 + used > 512 then page + 1 else page end, case when 18 + used > 512 then 18 else used + 18 end from p where n < (select max(n) from r))
  select '06' || printf('%016X', k) as key, 9::integer as bytes, page from r join p using (n)""")
def kv_page_assignment(spark, d):
    """Keys and values have nine bytes each, and none is above the signed numbers."""
    rows = ops.range_scan(_orders(spark, d), F.lit(0).cast("bigint"), F.lit((1 << 63) - 1).cast("bigint"), FAR_MS)
    encoded = rows.select(codec.encode(F.col("key"), "bigserial").alias("key"), codec.encode(F.floor("value").cast("bigint"), "bigserial").alias("value"))
    return paging.assign_pages(encoded, 512).select(F.hex("key").alias("key"), F.octet_length("value").alias("bytes"), "page")


@query("""select c_custkey, '{"data":' || '"' || c_name || '"' || ',"errors":null}' as point, '{"data":[{"key":' || c_custkey || ',"value":"' || c_name || '"}],"errors":null}' as page,
  '{"data":null,"errors":"InvalidQuery"}' as failed from customer""")
def kv_json_render(spark, d):
    c = table(spark, d, "customer")
    page = F.to_json(F.array(F.struct(F.col("c_custkey").alias("key"), F.col("c_name").alias("value"))))
    return c.select("c_custkey", render.envelope(render.quoted(F.col("c_name"))).alias("point"), render.envelope(page).alias("page"), render.envelope(F.lit(None).cast("string"), F.lit("InvalidQuery")).alias("failed"))


@query("""with v(c_custkey, kind, point, page) as (
    select c_custkey, 'boolean', '"' || (c_acctbal > 0) || '"', (c_acctbal > 0)::varchar from customer union all
    select c_custkey, 'int', (-c_custkey)::varchar, (-c_custkey)::varchar from customer union all
    select c_custkey, 'bigserial', (9223372036854775000::hugeint + c_custkey * 10)::varchar,
      case when c_custkey * 10 > 807 then '"' || (9223372036854775000::hugeint + c_custkey * 10) || '"' else (9223372036854775000::hugeint + c_custkey * 10)::varchar end from customer union all
    select c_custkey, 'bigfloat', c_acctbal::varchar, c_acctbal::varchar from customer union all
    select c_custkey, 'string', '"' || c_mktsegment || '"', '"' || c_mktsegment || '"' from customer)
  select * from v""")
def kv_json_by_type(spark, d):
    """Stored bytes of five types as point answers and pages show them."""
    c, key = table(spark, d, "customer"), F.col("c_custkey")
    values = {"boolean": F.col("c_acctbal") > 0, "int": -key, "bigserial": F.lit("9223372036854775000").cast("decimal(20,0)") + key * 10, "bigfloat": F.col("c_acctbal"), "string": F.col("c_mktsegment")}
    stored = c.select("c_custkey", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), codec.encode(v, k).alias("data")) for k, v in values.items()])).alias("s"))
    return stored.select("c_custkey", "s.kind", render.point_json(F.col("s.data")).alias("point"), render.range_json(F.col("s.data")).alias("page"))


@query("""select c_custkey, '000906' || printf('%016X', c_custkey) || printf('%016X', 1700000000000000 + c_custkey) || case when c_acctbal < 0 then '0000'
    else printf('%04X', 1 + strlen(c_name)) || case when c_nationkey % 2 = 0 then '01' else '00' end || '09' || hex(c_name) || case when c_nationkey % 2 = 0 then '0000000000001388' else '' end end as record,
  case when c_acctbal >= 0 then c_name end as value, case when c_acctbal >= 0 and c_nationkey % 2 = 0 then 5000::bigint end as ttl_ms from customer""")
def kv_raw_records(spark, d):
    """Customers as raw records, and what is read back from these: deleted ones with no money left, some with a time to live."""
    c = table(spark, d, "customer")
    value = F.when(F.col("c_acctbal") >= 0, codec.encode(F.col("c_name"), "string"))
    ttl = F.when(F.col("c_nationkey") % 2 == 0, F.lit(5000).cast("bigint"))
    made = c.select(records.to_record(codec.encode(F.col("c_custkey"), "bigserial"), F.lit(1_700_000_000_000_000) + F.col("c_custkey"), value, ttl).alias("record"))
    r = records.from_records(made, "record")
    again = records.to_record(F.col("key"), F.col("ts_us"), F.col("value"), F.col("ttl_ms"))
    return r.select(codec.decode(F.col("key"), "bigserial").cast("bigint").alias("c_custkey"), F.hex(again).alias("record"), codec.decode(F.col("value"), "string").alias("value"), "ttl_ms")


@query("""select o_orderkey, '{"data":' || coalesce(c_acctbal::varchar, 'null') || ',"errors":null}' as response
  from orders left join (select * from customer where c_nationkey <> 7) on c_custkey = o_custkey where o_custkey is not null""")
def kv_bulk_point_gets(spark, d):
    """A request line for each order's customer, answered together from a log of customers; those of one nation are deleted."""
    c = table(spark, d, "customer")
    value = F.when(F.col("c_nationkey") != 7, codec.encode(F.col("c_acctbal"), "bigfloat"))
    log = c.select(requests.literal_key(F.col("c_custkey").cast("string")).alias("key"), value.alias("value"), F.lit(1).cast("bigint").alias("ts_us"), F.lit(0).cast("bigint").alias("seq"), F.lit(None).cast("bigint").alias("ttl_ms"))
    o = table(spark, d, "orders").where("o_custkey is not null")
    lines = o.select("o_orderkey", F.to_json(F.struct(F.lit(1).alias("kind"), F.concat(F.lit("get "), F.col("o_custkey").cast("string")).alias("query"))).alias("line"))
    return requests.answer_gets(lines, log, FAR_MS).select("o_orderkey", "response")


@query("""select step::integer as step, query, response from (values
  (0, 'set ''a'' 1, ''b'' 2.5, ''c'' true', '{"data":0,"errors":null}'),
  (1, 'get ''a''', '{"data":1,"errors":null}'),
  (2, 'get ''c''', '{"data":"true","errors":null}'),
  (3, 'get range ''a'' ''z''', '{"data":[{"key":"a","value":1},{"key":"b","value":2.5},{"key":"c","value":true}],"errors":null}'),
  (4, 'delete ''a''', '{"data":0,"errors":null}'),
  (5, 'get ''a''', '{"data":null,"errors":null}'),
  (6, 'set ''b'' 7 expire ''1ms''', '{"data":0,"errors":null}'),
  (7, 'get ''b''', '{"data":null,"errors":null}'),
  (8, 'get range ''a'' ''z''', '{"data":[{"key":"c","value":true}],"errors":null}'),
  (9, 'get range ''a'' 1', '{"data":null,"errors":"InvalidQuery"}'),
  (10, 'SET ''x'' 1', '{"data":null,"errors":"InvalidQuery"}'),
  (11, 'get ''missing''', '{"data":null,"errors":null}')) t(step, query, response)""")
def kv_statement_suite(spark, d):
    """Statements in sequence on an empty store in the shared folder; one response line each, as the protocol has it."""
    from keystrata.plans.session import Connection
    from keystrata.sources.store import Store

    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    connection = Connection(Store(spark, f"{base}/kv-{uuid.uuid4().hex}"))
    lines = ["set 'a' 1, 'b' 2.5, 'c' true", "get 'a'", "get 'c'", "get range 'a' 'z'", "delete 'a'", "get 'a'", "set 'b' 7 expire '1ms'", "get 'b'", "get range 'a' 'z'", "get range 'a' 1", "SET 'x' 1", "get 'missing'"]
    out = [(i, q, connection.execute(q, 1_700_000_000_000_000 + i * 1_000_000).rstrip("\n")) for i, q in enumerate(lines)]
    return spark.createDataFrame(out, "step int, query string, response string")


@query(f"select user_id as key, value, epoch_us(ts) as ts_us from events qualify {RN}")
def kv_stream_upsert(spark, d):
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{base}/kv-{uuid.uuid4().hex}"
    stream = ingest.files(spark, d, "events.parquet", table(spark, d, "events").schema)
    log = stream.select(F.col("user_id").alias("key"), "value", _micros("ts").alias("ts_us"), F.col("event_id").alias("seq"))
    ingest.ingest(log, lambda rows, n: rows.write.mode("overwrite").parquet(f"{path}/log/batch={n}"), f"{path}/checkpoint")
    return resolve(spark.read.parquet(f"{path}/log").drop("batch")).select("key", "value", "ts_us")


@query("select o_orderkey as k, o_orderkey as serial, cast(o_orderkey as bigint) as big, -(o_orderkey % 100) as small, o_totalprice as price, o_orderpriority as text from orders")
def kv_decode_roundtrip(spark, d):
    k = F.col("o_orderkey")
    back = lambda c, kind: codec.decode(codec.encode(c, kind), kind)
    return table(spark, d, "orders").select(
        k.alias("k"), back(k, "bigserial").cast("bigint").alias("serial"), back(k, "bigint").alias("big"), back(-(k % 100), "smallint").cast("bigint").alias("small"),
        back(F.col("o_totalprice"), "bigfloat").alias("price"), back(F.col("o_orderpriority"), "string").alias("text"),
    )


@query(f"select event_id, 12 + 9 + case when event_type = 'error' then 0 else 1 + 9 + case when {TTL} is null then 0 else 8 end end as bytes from events")
def kv_record_size(spark, d):
    e = _events(spark, d, ttl=True)
    value = F.when(F.col("value").isNotNull(), codec.encode(F.lit(0.0), "bigfloat"))
    return e.select(F.col("seq").alias("event_id"), codec.stored_size(codec.encode(F.col("key"), "bigserial"), value, F.col("ttl_ms")).alias("bytes"))


@query("select p_partkey, length(p_partkey::varchar) as n, length((p_partkey::bigint * 1000003)::varchar) as m from part")
def kv_digits(spark, d):
    return table(spark, d, "part").select("p_partkey", codec.digits(F.col("p_partkey")).alias("n"), codec.digits(F.col("p_partkey").cast("bigint") * 1000003).alias("m"))


@query("select p_partkey, case p_partkey % 4 when 0 then p_size * 1000 when 1 then p_size when 2 then p_size when 3 then null end as ms from part")
def kv_ttl_literal(spark, d):
    size = F.col("p_size").cast("string")
    text = F.when(F.col("p_partkey") % 4 == 0, F.concat(size, F.lit("s"))).when(F.col("p_partkey") % 4 == 1, F.concat(size, F.lit("ms"))).when(F.col("p_partkey") % 4 == 2, size).otherwise("ms")
    return table(spark, d, "part").select("p_partkey", codec.ttl_millis(text).alias("ms"))


@query("select user_id as key, event_id as seq, value from events")
def kv_run_union_scan(spark, d):
    e = _events(spark, d, None)
    return union_sources(*(e.where(f"seq % 4 = {i}") for i in range(4))).select("key", "seq", "value")


@query(f"select user_id as key, value, event_id as seq from events qualify {RN}")
def kv_wal_replay(spark, d):
    log = _events(spark, d, None)
    return resolve(union_sources(log, _events(spark, d, None))).select("key", "value", "seq")


@query("select o_orderkey as key, o_totalprice as value from orders where o_orderkey in (select l_orderkey from lineitem where l_quantity = 50 and l_linenumber = 1)")
def kv_bloom_semijoin(spark, d):
    keys = table(spark, d, "lineitem").where("l_quantity = 50 and l_linenumber = 1").select(F.col("l_orderkey").alias("key"))
    return _orders(spark, d).join(keys, "key", "left_semi").select("key", "value")


@query("select s_suppkey, cast(split_part(name, '.', 1) as integer) as level, cast(split_part(name, '.', 2) as bigint) as run_id from (select s_suppkey, (s_nationkey % 6) || '.' || s_suppkey as name from supplier)")
def kv_run_name_parse(spark, d):
    name = F.concat_ws(".", (F.col("s_nationkey") % 6).cast("string"), F.col("s_suppkey").cast("string"))
    part = lambda i: F.regexp_extract("name", r"^([0-9]+)\.([0-9]+)$", i)
    return table(spark, d, "supplier").select("s_suppkey", name.alias("name")).select("s_suppkey", part(1).cast("int").alias("level"), part(2).cast("bigint").alias("run_id"))
