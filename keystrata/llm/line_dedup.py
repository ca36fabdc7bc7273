"""Line deduplication by overlapping windows of three lines.

Each window of three consecutive lines that aren't blank (compared without surrounding spaces) is
hashed to 96 bits. A window found again anywhere, in the order of documents and lines, is removed
there: the lines that such later windows cover, merged, go; the first occurrence stays. If a window
recurs so close in one document that it overlaps its own first occurrence, those lines stay.

Counts and first occurrences are combined before they are shuffled. The join that finds later
occurrences has a key of its own, so adaptive execution can split a window that a third of all
documents share. Only built-in expressions are used.

Null texts stay null; empty texts and those with fewer than three lines that aren't blank stay as
they are. A document is known by its id and text: rows that agree in both (a null id is the
smallest) are one document and are treated alike, so repeated rows don't remove each other's lines.
Columns besides id and text pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.session import table

WINDOW = 3


def _key(id_col: str, text_col: str) -> list[Column]:
    return [
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("_ld_id"),
        F.xxhash64(F.col(text_col)).alias("_ld_text"),
    ]


def _filled(text: Column) -> Column:
    """(place, line) of each line that isn't blank, places from 0."""
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("place"), F.trim(x).alias("line")))
    return F.filter(lines, lambda x: x["line"].rlike(r"\S"))


def _windows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    own = docs.select(*_key(id_col, text_col), F.transform(_filled(F.col(text_col)), lambda x: x["line"]).alias("lines"))
    own = own.where(F.size("lines") >= WINDOW)
    places = F.sequence(F.lit(0), F.size("lines") - WINDOW)
    hashed = F.transform(
        places,
        lambda k: F.struct(
            k.alias("k"),
            F.xxhash64(F.slice("lines", k + 1, F.lit(WINDOW))).alias("h"),
            F.hash(F.slice("lines", k + 1, F.lit(WINDOW))).alias("g"),
        ),
    )
    return own.select("_ld_id", "_ld_text", F.inline(hashed))


def removals(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_ld_id, _ld_text, _ld_gone) for each document that loses lines; _ld_gone counts lines that aren't blank, from 0."""
    windows = _windows(docs, id_col, text_col)
    first = windows.groupBy("h", "g").agg(F.count("*").alias("n"), F.min(F.struct("_ld_id", "_ld_text", "k")).alias("first"))
    own_key = lambda df: df.withColumn("j", F.xxhash64("h", "g"))
    again = own_key(windows).join(own_key(first.where("n > 1")), ["j", "h", "g"])
    same = (F.col("_ld_id") == F.col("first._ld_id")) & (F.col("_ld_text") == F.col("first._ld_text"))
    start = F.when(same, F.greatest(F.col("k"), F.col("first.k") + WINDOW)).otherwise(F.col("k"))
    later = again.where(~(same & (F.col("k") == F.col("first.k")))).select("_ld_id", "_ld_text", start.alias("start"), "k")
    gone = F.array_distinct(F.flatten(F.collect_list(F.sequence(F.col("start"), F.col("k") + WINDOW - 1))))
    # Distinct, so that of many equal rows of one document only one document's windows are gathered.
    return later.distinct().groupBy("_ld_id", "_ld_text").agg(gone.alias("_ld_gone"))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """docs without the lines of repeated windows, in the same columns (and the number of removed lines, if named)."""
    gone = removals(docs, id_col=id_col, text_col=text_col)
    keyed = docs.select(F.struct(*docs.columns).alias("row"), *_key(id_col, text_col))
    joined = keyed.join(gone.hint("shuffle_hash"), ["_ld_id", "_ld_text"], "left")
    text = F.col("row")[text_col]

    all_lines = F.split(text, "\n")
    filled = _filled(text)
    removed = F.get(F.transform(F.array(filled), lambda f: F.transform("_ld_gone", lambda k: F.get(f, k)["place"])), F.lit(0))
    stay = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), removed)
    left = F.get(F.transform(F.array(all_lines), lambda a: F.array_join(F.transform(stay, lambda i: F.coalesce(F.get(a, i), F.lit(""))), "\n")), F.lit(0))
    changed = F.when(F.col("_ld_gone").isNull(), text).otherwise(left)
    columns = [(changed if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns]
    if count_col:
        columns.append(F.coalesce(F.size("_ld_gone"), F.lit(0)).cast("long").alias(count_col))
    return joined.select(*columns)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, count_col="n_removed").select("doc_id", "n_removed", "text")


SQL = r"""
with lines as (select doc_id, unnest(range(len(a))) i, unnest(a) line from (select doc_id, string_split(text, chr(10)) a from documents)),
filled as (select *, row_number() over (partition by doc_id order by i) - 1 k, trim(line, ' ') t from lines where regexp_matches(line, '[^ \t\n\x0B\f\r]')),
w as (select doc_id, k, t, lead(t, 1) over d t1, lead(t, 2) over d t2 from filled window d as (partition by doc_id order by k)),
f as (select doc_id, k, first_value(doc_id) over x fd, first_value(k) over x fk from w where t2 is not null
  window x as (partition by t, t1, t2 order by doc_id, k)),
s as (select doc_id, case when doc_id = fd then greatest(k, fk + 3) else k end a, k + 2 b from f where doc_id <> fd or k <> fk),
gone as (select distinct doc_id, unnest(range(a, b + 1)) k from s),
l as (select doc_id, i, line, g.k is not null gone from lines left join filled using (doc_id, i, line) left join gone g using (doc_id, k))
select doc_id, n_removed, case when text is null then null else coalesce(rest, '') end as text from (
  select doc_id, text, coalesce(n, 0) n_removed, rest from documents left join
    (select doc_id, count(*) filter (gone) n, string_agg(line, chr(10) order by i) filter (not gone) rest from l group by doc_id) using (doc_id))"""


def queries() -> dict:
    return {"op1_line_dedup": op1_line_dedup}


def oracle_sql() -> dict:
    return {"op1_line_dedup": SQL}
