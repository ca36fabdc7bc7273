"""JSON rendering of results: point answers, range pages and the response envelope."""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from keystrata.functions import codec

INT64_MAX = (1 << 63) - 1


def envelope(data: Column, errors: Column | None = None) -> Column:
    """`{"data":...,"errors":...}` with nulls written out; data is JSON text or null."""
    error = F.lit("null") if errors is None else F.coalesce(F.concat(F.lit('"'), errors, F.lit('"')), F.lit("null"))
    return F.concat(F.lit('{"data":'), F.coalesce(data, F.lit("null")), F.lit(',"errors":'), error, F.lit("}"))


def quoted(text: Column) -> Column:
    """A JSON string, without the brackets that to_json needs around it."""
    array = F.to_json(F.array(text))
    return F.substring(array, F.lit(2), F.length(array) - 2)


def point_json(data: Column) -> Column:
    """JSON text of stored bytes as a point answer shows them: booleans are strings, unsigned numbers numbers."""
    return _json(data, lambda text: F.concat(F.lit('"'), text, F.lit('"')), lambda text: text)


def range_json(data: Column) -> Column:
    """JSON text of stored bytes in a page: booleans stay, unsigned numbers above the signed range are strings."""
    wide = lambda text: F.when(text.cast("decimal(20,0)") > INT64_MAX, F.concat(F.lit('"'), text, F.lit('"'))).otherwise(text)
    return _json(data, lambda text: text, wide)


def _json(data: Column, boolean: Callable[[Column], Column], wide: Callable[[Column], Column]) -> Column:
    """One branch for each tag; null, bytes without a known tag and floats that aren't finite give JSON null."""
    tag, out = F.hex(F.substring(data, 1, 1)), F.when(data.isNull(), "null")
    for kind, number in codec.TAGS.items():
        value = codec.decode(data, kind)
        if kind == "string":
            text = quoted(value)
        elif kind in ("float", "bigfloat"):
            double = value.cast("double")
            text = F.when(F.isnan(double) | (F.abs(double) == float("inf")), "null").otherwise(double.cast("string"))
        else:
            text = value.cast("string")
            text = boolean(text) if kind == "boolean" else wide(text) if kind == "bigserial" else text
        out = out.when(tag == f"{number:02X}", text)
    return out.otherwise("null")


def point_value(kind: str, value: Any) -> Any:
    """A point answer's JSON value: booleans are strings there."""
    return str(value).lower() if kind == "boolean" else _number(kind, value)


def range_value(kind: str, value: Any) -> Any:
    """A page's JSON value: booleans stay, unsigned numbers above the signed range are strings."""
    if kind == "bigserial" and value > INT64_MAX:
        return str(value)
    return _number(kind, value)


def _number(kind: str, value: Any) -> Any:
    if kind in ("float", "bigfloat"):
        return None if math.isnan(value) else float(value)
    return value if kind in ("boolean", "string") else int(value)


def response(data: Any = None, errors: str | None = None) -> str:
    """One line of the wire protocol."""
    return json.dumps({"data": data, "errors": errors}, ensure_ascii=False, separators=(",", ":")) + "\n"
