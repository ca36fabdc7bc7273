"""Typed scalars as tagged bytes, their order, and the literal typing ladder, all as Column expressions.

A storage key is one tag byte and a big-endian payload. Spark compares BINARY as unsigned bytes,
shorter prefix first, which is the store's total order. Group and join on encoded keys: a DOUBLE key
would merge 0.0 and -0.0, which are different keys here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the storage format: tag and payload width in bytes of each type.
TAGS = {
    "boolean": 0, "smallint": 1, "int": 2, "bigint": 3, "smallserial": 4,
    "serial": 5, "bigserial": 6, "float": 7, "bigfloat": 8, "string": 9,
}
WIDTHS = {
    "boolean": 1, "smallint": 1, "int": 4, "bigint": 8, "smallserial": 1,
    "serial": 4, "bigserial": 8, "float": 4, "bigfloat": 8,
}
SIGNED = ("smallint", "int", "bigint")
TWO_64 = "18446744073709551616"


def _payload_hex(value: Column, kind: str) -> Column:
    width = 2 * WIDTHS[kind]
    if kind == "boolean":
        return F.when(value, "01").otherwise("00")
    if kind == "float":
        return F.lpad(F.hex(F.java_method(F.lit("java.lang.Float"), F.lit("floatToRawIntBits"), value.cast("float")).cast("int").cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")
    if kind == "bigfloat":
        bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToRawLongBits"), value.cast("double"))
        return F.lpad(F.hex(bits.cast("bigint")), 16, "0")
    if kind == "bigserial":
        wide = value.cast("decimal(21,0)")
        signed = F.when(wide >= F.lit("9223372036854775808").cast("decimal(21,0)"), wide - F.lit(TWO_64).cast("decimal(21,0)")).otherwise(wide)
        return F.lpad(F.hex(signed.cast("bigint")), 16, "0")
    mask = (1 << 8 * WIDTHS[kind]) - 1
    number = value.cast("bigint")
    return F.lpad(F.hex(number if kind == "bigint" else number.bitwiseAND(F.lit(mask))), width, "0")


def encode(value: Column, kind: str) -> Column:
    """Tag and payload of a typed value; null stays null."""
    tag = f"{TAGS[kind]:02X}"
    if kind == "string":
        return F.concat(F.unhex(F.lit(tag)), value.cast("binary"))
    return F.unhex(F.concat(F.lit(tag), _payload_hex(value, kind)))


def decode(key: Column, kind: str) -> Column:
    """The typed value of an encoded one."""
    body = F.substring(key, 2, 1 << 30)
    digits = F.hex(body)
    if kind == "string":
        return F.decode(body, "UTF-8")
    if kind == "boolean":
        return digits == "01"
    if kind == "bigfloat":
        bits = F.java_method(F.lit("java.lang.Long"), F.lit("parseUnsignedLong"), digits, F.lit(16))
        return F.java_method(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), bits.cast("bigint")).cast("double")
    if kind == "float":
        bits = F.java_method(F.lit("java.lang.Integer"), F.lit("parseUnsignedInt"), digits, F.lit(16))
        return F.java_method(F.lit("java.lang.Float"), F.lit("intBitsToFloat"), bits.cast("int")).cast("float")
    number = F.conv(digits, 16, 10).cast("decimal(21,0)")
    if kind in SIGNED:
        top = F.lit(str(1 << (8 * WIDTHS[kind] - 1))).cast("decimal(21,0)")
        whole = F.lit(str(1 << (8 * WIDTHS[kind]))).cast("decimal(21,0)")
        number = F.when(number >= top, number - whole).otherwise(number)
    spark_type = {"smallint": "tinyint", "int": "int", "bigint": "bigint", "smallserial": "smallint", "serial": "bigint"}
    return number.cast(spark_type.get(kind, "decimal(20,0)"))


def literal_kind(text: Column) -> Column:
    """The narrowest type of a literal's text, null if it has none (out of range or malformed).

    Quoted text is a string, `true` and `false` (in any case) are booleans, a point makes a bigfloat;
    a minus sign selects the signed types, its absence the unsigned ones.
    """
    whole = F.when(text.rlike(r"^-?[0-9]+$"), text)
    as_type = lambda t: whole.try_cast(t)
    negative = text.startswith("-")
    wide = as_type("decimal(38,0)")
    return (
        F.when(text.rlike(r"^'[\s\S]*'$"), "string")
        .when(F.lower(text).isin("true", "false"), "boolean")
        .when(text.rlike(r"^-?[0-9]*\.[0-9]*$") & text.try_cast("double").isNotNull(), "bigfloat")
        .when(negative & as_type("tinyint").isNotNull(), "smallint")
        .when(negative & as_type("int").isNotNull(), "int")
        .when(negative & as_type("bigint").isNotNull(), "bigint")
        .when(negative, None)
        .when(wide <= 255, "smallserial")
        .when(wide <= (1 << 32) - 1, "serial")
        .when(wide <= F.lit(str((1 << 64) - 1)).cast("decimal(38,0)"), "bigserial")
    )


def literal_true(text: Column) -> Column:
    """The stored boolean: only the lower-case word is true, although any case reads as a boolean."""
    return text == "true"


def ttl_millis(text: Column) -> Column:
    """Milliseconds of a TTL text: '500ms', '10s' or '987'; null if malformed."""
    digits = F.regexp_extract(text, r"^(-?[0-9]+)(ms|s)?$", 1)
    number = F.when(digits != "", digits).try_cast("bigint")
    return F.when(text.rlike("^-?[0-9]+s$"), number * 1000).otherwise(number)


def digits(value: Column) -> Column:
    """Decimal digits of an unsigned number."""
    return F.length(value.cast("string"))


def expired(ts_us: Column, ttl_ms: Column, now_ms: int | Column) -> Column:
    """Whether a record is past its time to live; one without never is."""
    now = F.lit(now_ms) if isinstance(now_ms, int) else now_ms
    return F.coalesce(now > F.call_function("div", ts_us, F.lit(1000)) + ttl_ms, F.lit(False))


def stored_size(key: Column, value: Column, ttl_ms: Column) -> Column:
    """Bytes of a record in memory: 12, the key, and for a value one flag byte, its bytes and 8 for a TTL."""
    body = F.when(value.isNull(), 0).otherwise(1 + F.octet_length(value) + F.when(ttl_ms.isNull(), 0).otherwise(8))
    return 12 + F.octet_length(key) + body
