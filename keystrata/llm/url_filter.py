"""URL filtering by explicit rules and, where none fits, by a learned path-template tree.

Explicit rules (host suffix and path prefix) label the URLs they fit. Per host, URL paths form a
tree of segments. Segments that look like identifiers become typed wildcards, and so do all
children of a node with more than `fanout` different ones; what is left are path templates. A
template whose labelled rate does not differ significantly from that of its siblings together is
merged with them. A URL without a rule is blocked if the smoothed labelled purity of its (merged)
template reaches `purity`.

Everything is counts over all rows: a group per path, then per template, per parent and per host.
Joins go through a hash column of their own so that adaptive execution can split a hot host.

Null or odd rows: a null URL or one without `://` has an empty host and path and is judged by the
template of that empty path; repeated rows are judged alike; an empty table gives an empty result.
Columns other than id and url are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.session import table

#: (action, host suffix and path prefix); the longest text that fits wins, block before allow.
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Segments that vary from page to page: numbers, then long hexadecimal names, each perhaps with an extension.
NUMBER, HEX = r"^[0-9]+(\.[A-Za-z0-9]{1,5})?$", r"^[0-9a-fA-F-]{16,}(\.[A-Za-z0-9]{1,5})?$"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return (
        F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER),
        F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1),
    )


def _fits(rule: str, host: Column, path: Column) -> Column:
    suffix, slash, prefix = rule.partition("/")
    return ((host == suffix) | host.endswith(f".{suffix}")) & path.startswith(slash + prefix)


def _hashed(df: DataFrame, *keys: str) -> DataFrame:
    return df.withColumn("h", F.xxhash64(*keys))


def judge(
    urls: DataFrame,
    rules: Sequence[tuple[str, str]] = RULES,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    fanout: int = 20,
    z2: float = 4.0,
    weight: float = 4.0,
    purity: float = 0.75,
) -> DataFrame:
    """(id, host, path, rule, template, purity, verdict) for each row of urls.

    rules become one ordered conditional expression, so there should be some hundreds at most.
    fanout: children of a node beyond which its segments are one wildcard. z2: squared normal
    deviate up to which a template's rate counts as its siblings' rate. weight: labelled URLs that
    the host's smoothed rate counts as. purity: smoothed share of blocked labels that rejects.
    """
    host, path = host_and_path(F.col("url"))
    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[0] != "block", r[1]))
    base = urls.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    base = base.select("id", host.alias("host"), path.alias("path"))
    rule = F.coalesce(F.lit(None).cast("string"), *(F.when(_fits(r, F.col("host"), F.col("path")), F.lit(r)) for _, r in ordered))
    base = base.withColumn("rule", rule)
    action = F.lit(None).cast("string")
    for act, text in ordered:
        action = F.when(F.col("rule") == text, F.lit(act)).otherwise(action)
    base = base.withColumn("action", action)
    typed = F.transform(
        F.split("path", "/"),
        lambda s: F.when(s.rlike(NUMBER), F.regexp_replace(s, NUMBER, "{n}")).when(s.rlike(HEX), F.lit("{h}")).otherwise(s),
    )
    base = base.withColumn("shape", F.array_join(typed, "/"))

    shapes = base.groupBy("host", "shape").agg(
        F.count(F.when(F.col("action").isNotNull(), 1)).alias("l"),
        F.count(F.when(F.col("action") == "block", 1)).alias("b"),
    )
    # Nodes of the tree: `up` is the hash of all segments before, so deep paths cost no longer keys.
    seg = F.split("shape", "/")
    ups = F.aggregate(
        seg,
        F.array(F.lit(0).cast("bigint")),
        lambda acc, s: F.concat(acc, F.array(F.xxhash64(F.element_at(acc, -1), s))),
    )
    nodes = shapes.select("host", "shape", F.posexplode(F.arrays_zip(F.slice(ups, 1, F.size(seg)).alias("up"), seg.alias("seg"))))
    nodes = nodes.select("host", "shape", "pos", F.col("col.up").alias("up"), F.col("col.seg").alias("seg"))
    wide = (
        nodes.groupBy("host", "up", "seg").agg(F.lit(1).alias("one"))
        .groupBy("host", "up").agg(F.count("*").alias("kids"))
        .where(F.col("kids") > fanout)
    )
    split = _hashed(nodes, "host", "up").join(_hashed(wide, "host", "up"), ["h", "host", "up"], "left")
    split = split.withColumn("seg", F.when(F.col("kids").isNotNull(), F.lit("{*}")).otherwise(F.col("seg")))
    template = F.transform(F.sort_array(F.collect_list(F.struct("pos", "seg"))), lambda x: x["seg"])
    named = split.groupBy("host", "shape").agg(template.alias("t")).select(
        "host",
        "shape",
        F.array_join("t", "/").alias("template"),
        F.array_join(F.expr("slice(t, 1, size(t) - 1)"), "/").alias("parent"),
    )
    # l and b again by shape: each (host, shape) is one row on both sides.
    counted = shapes.join(named, ["host", "shape"])
    own = counted.groupBy("host", "parent", "template").agg(F.sum("l").alias("l"), F.sum("b").alias("b"))
    near = own.groupBy("host", "parent").agg(F.sum("l").alias("pl"), F.sum("b").alias("pb"))
    all_of = near.groupBy("host").agg(F.sum("pl").alias("hl"), F.sum("pb").alias("hb"))
    near = _hashed(near, "host").join(_hashed(all_of, "host"), ["h", "host"]).drop("h")
    tree = _hashed(own, "host", "parent").join(_hashed(near, "host", "parent"), ["h", "host", "parent"]).drop("h")
    mine, pooled = F.try_divide("b", "l"), F.try_divide("pb", "pl")
    differs = (F.col("l") > 0) & ((mine - pooled) * (mine - pooled) * F.col("l") > z2 * pooled * (1 - pooled))
    tree = tree.withColumn("own", F.coalesce(differs, F.lit(False)))
    prior = (F.col("hb") + 1) / (F.col("hl") + 2)
    hits = F.when(F.col("own"), F.col("b")).otherwise(F.col("pb"))
    seen = F.when(F.col("own"), F.col("l")).otherwise(F.col("pl"))
    tree = tree.select("host", "template", ((hits + weight * prior) / (seen + weight)).alias("purity"))
    scored = _hashed(named, "host", "template").join(_hashed(tree, "host", "template"), ["h", "host", "template"])
    scored = scored.select("host", "shape", "template", "purity")
    out = _hashed(base, "host", "shape").join(_hashed(scored, "host", "shape"), ["h", "host", "shape"])
    learned = F.when(F.col("purity") >= purity, F.lit("block")).otherwise(F.lit("allow"))
    return out.select(
        F.col("id").alias(id_col), "host", "path", "rule", "template", "purity", F.coalesce("action", learned).alias("verdict")
    )


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    """The same method in SQL; segments before a node are compared as text instead of by hash."""
    fits = lambda r: "(host = '{0}' or ends_with(host, '.{0}')) and starts_with(path, '/{1}')".format(*r.split("/", 1))
    ordered = sorted(RULES, key=lambda r: (-len(r[1]), r[0] != "block", r[1]))
    rule = " ".join(f"when {fits(r)} then '{r}'" for _, r in ordered)
    action = " ".join(f"when rule = '{r}' then '{a}'" for a, r in ordered)
    return rf"""
with u as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end rest from pages),
s as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path from u),
r as (select *, case {rule} end rule from s),
a as (select *, case {action} end action, array_to_string(list_transform(string_split(path, '/'), lambda x:
  case when regexp_matches(x, '{NUMBER}') then '{{n}}' when regexp_matches(x, '{HEX}') then '{{h}}' else x end), '/') shape from r),
shapes as (select host, shape, count(*) filter (action is not null) l, count(*) filter (action = 'block') b from a group by all),
segs as (select *, string_split(shape, '/') seg from shapes),
nodes as (select host, shape, i pos, array_to_string(seg[1:i - 1], '/') || '|' || i up, seg[i] seg
  from (select *, unnest(range(1, len(seg) + 1)) i from segs)),
wide as (select host, up from nodes group by all having count(distinct seg) > 20),
named as (select n.host, shape, list(case when w.host is null then seg else '{{*}}' end order by pos) t
  from nodes n left join wide w on n.host = w.host and n.up = w.up group by all),
named2 as (select host, shape, array_to_string(t, '/') template, array_to_string(t[1:len(t) - 1], '/') parent from named),
own as (select host, parent, template, sum(l) l, sum(b) b from shapes join named2 using (host, shape) group by all),
near as (select *, sum(l) over (partition by host, parent) pl, sum(b) over (partition by host, parent) pb,
  sum(l) over (partition by host) hl, sum(b) over (partition by host) hb from own),
d as (select *, l > 0 and coalesce((b / l - pb / pl) * (b / l - pb / pl) * l > 4.0 * (pb / pl) * (1 - pb / pl), false) mine from near),
tree as (select host, template, ((case when mine then b else pb end) + 4.0 * ((hb + 1) / (hl + 2))) /
  ((case when mine then l else pl end) + 4.0) purity from d)
select page_id, host, path, rule, coalesce(action, case when purity >= 0.75 then 'block' else 'allow' end) verdict
from a join named2 using (host, shape) join tree using (host, template)"""


def queries() -> dict:
    return {"op10_url_filter": op10_url_filter}


def oracle_sql() -> dict:
    return {"op10_url_filter": _sql()}
