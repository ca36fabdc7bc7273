"""Many request lines at once: point reads of a whole batch are one join, on tables and in streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.functions import codec, render
from keystrata.operators.ops import multi_get

REQUEST = "kind int, query string, timestamp bigint"
#: A get of one literal; what follows the literal is ignored, as the parser does.
GET = r"^\s*get\s*('[^']+'|-?[0-9]+(?:\.[0-9]*)?(?![0-9A-Za-z_.])|(?i:true|false)(?![0-9A-Za-z_]))"
KINDS = ("string", "boolean", "bigfloat", "smallint", "int", "bigint", "smallserial", "serial", "bigserial")


def literal_key(text: Column) -> Column:
    """The stored bytes of a literal's text, null if it is none."""
    kind, out = codec.literal_kind(text), F.lit(None).cast("binary")
    whole = text.try_cast("decimal(38,0)")
    values = {"string": text.substr(F.lit(2), F.length(text) - 2), "boolean": codec.literal_true(text), "bigfloat": text.try_cast("double")}
    for k in KINDS:
        out = F.when(kind == k, codec.encode(values.get(k, whole), k)).otherwise(out)
    return out


def answer_gets(lines: DataFrame, log: DataFrame, now_ms: int, line: str = "line") -> DataFrame:
    """The lines' columns and `response`: for each point read its answer, for lines that are no requests an error, and
    null for other statements, which change or page and so go through a Connection in order.

    Equal keys are read once. The log is cut to the asked keys before it is resolved; the answers go back
    by a join that adaptive execution can split, so a key that many lines ask for is no hot task.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in lines.columns)).alias("row")
    asked = lines.select(row, F.from_json(F.col(f"`{line}`").cast("string"), REQUEST).alias("r"))
    asked = asked.withColumn("t", F.when(F.col("r.kind") == 1, F.nullif(F.regexp_extract("r.query", GET, 1), F.lit(""))))
    asked = asked.withColumn("key", literal_key(F.col("t"))).withColumn("h", F.xxhash64("key"))
    found = multi_get(log, asked.where("key is not null").select("key").distinct(), now_ms)
    found = found.where("value is not null").select(F.xxhash64("key").alias("h"), "key", "value")
    out = asked.join(found, ["h", "key"], "left")
    malformed = F.coalesce(~F.col("r.kind").isin(0, 1, 2), F.lit(True))
    data = F.when(F.col("value").isNotNull(), render.point_json(F.col("value")))
    answer = F.when(malformed, render.envelope(F.lit(None).cast("string"), F.lit("QueryMalformed")))
    answer = answer.when(F.col("key").isNotNull(), render.envelope(data))
    return out.select(*(F.col("row").getField(c).alias(c) for c in lines.columns), answer.alias("response"))
