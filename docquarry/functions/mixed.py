"""Mixed-type (Any) columns: building, decoding and order."""

from __future__ import annotations

import base64
import datetime as dt
import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.types import ANY_CHILDREN, ANY_STRUCT

STRATEGIES = ("float", "string", "keep_struct")


def child_of(kind: T.DataType, metadata: dict | None = None) -> str:
    if (metadata or {}).get("kind") == "objectid":
        return "objectid_value"
    for child, types in (
        ("bool_value", T.BooleanType),
        ("int64_value", T.LongType),
        ("int32_value", (T.IntegerType, T.ShortType, T.ByteType)),
        ("float_value", (T.DoubleType, T.FloatType)),
        ("decimal128_value", T.DecimalType),
        ("binary_value", T.BinaryType),
        ("datetime_value", (T.TimestampType, T.TimestampNTZType, T.DateType)),
        ("array_value", T.ArrayType),
        ("document_value", (T.StructType, T.MapType)),
    ):
        if isinstance(kind, types):
            return child
    return "string_value"


def mixed_from(column: Column, kind: T.DataType, metadata: dict | None = None) -> Column:
    """A column of one type as a mixed-type column; nulls set null_value."""
    child = child_of(kind, metadata)
    value = {"binary_value": F.base64, "array_value": F.to_json, "document_value": F.to_json}.get(child, lambda c: c)(column)
    parts = []
    for name, t in ANY_CHILDREN:
        part = value.cast(t) if name == child else F.when(column.isNull(), F.lit(True)) if name == "null_value" else F.lit(None).cast(t)
        parts.append(part.alias(name))
    return F.struct(*parts)


def mixed_case(*cases: tuple[Column, Column, T.DataType]) -> Column:
    """A mixed-type column of the first case (condition, column, type) that holds, else null."""
    out = None
    for condition, column, kind in cases:
        made = mixed_from(column, kind)
        out = F.when(condition, made) if out is None else out.when(condition, made)
    return out.otherwise(mixed_from(F.lit(None).cast("string"), T.StringType()))


def encode_value(value: object) -> dict:
    """A Python value as a dict of the children."""
    out = dict.fromkeys(ANY_STRUCT.names)
    if value is None:
        out["null_value"] = True
    elif isinstance(value, bool):
        out["bool_value"] = value
    elif isinstance(value, int):
        if not -(2**63) <= value < 2**63:
            raise ValueError(f"{value} needs more than 64 bits")
        out["int32_value" if -(2**31) <= value < 2**31 else "int64_value"] = value
    elif isinstance(value, float):
        out["float_value"] = value
    elif isinstance(value, (bytes, bytearray)):
        out["binary_value"] = base64.b64encode(value).decode()
    elif isinstance(value, dt.datetime):
        out["datetime_value"] = value.astimezone(dt.UTC).replace(tzinfo=None) if value.tzinfo else value
    elif isinstance(value, dict):
        out["document_value"] = json.dumps(value, default=str)
    elif isinstance(value, (list, tuple)):
        out["array_value"] = json.dumps(list(value), default=str)
    else:
        out[{"ObjectId": "objectid_value", "Decimal": "decimal128_value", "Decimal128": "decimal128_value", "Pattern": "regex_value"}.get(type(value).__name__, "string_value")] = getattr(value, "pattern", None) or str(value)
    return out


def decode_value(children: dict | None) -> object:
    """The Python value of a row's children; datetimes stay datetimes."""
    for name, value in (children or {}).items():
        if value is not None and name != "null_value":
            if name == "binary_value":
                return base64.b64decode(value)
            return json.loads(value) if name in ("document_value", "array_value") else value
    return None


def as_float(c: Column) -> Column:
    return F.coalesce(c["float_value"], c["int64_value"].cast("double"), c["int32_value"].cast("double"), c["bool_value"].cast("double"))


def as_string(c: Column) -> Column:
    names = ["string_value", "float_value", "int64_value", "int32_value", "bool_value", "objectid_value", "decimal128_value", "regex_value", "binary_value", "document_value", "array_value"]
    time = F.date_format(c["datetime_value"], "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.coalesce(*[c[n].cast("string") for n in names], time)


def decode(column: Column, strategy: str) -> Column:
    if strategy not in STRATEGIES:
        raise ValueError(f"any_type_strategy is one of {STRATEGIES}, not {strategy!r}")
    return column if strategy == "keep_struct" else as_float(column) if strategy == "float" else as_string(column)


def lost_in_double(c: Column) -> Column:
    """How far a whole number lies above its double: 0 up to 2 ** 53 and for other values, so that equal numbers of any type tie."""
    whole = F.coalesce(c["int64_value"], c["int32_value"].cast("bigint"))
    near, most = whole.cast("double"), 2**63 - 1
    above = F.when(near >= F.lit(float(2**63)), whole - F.lit(most) - 1).otherwise(whole - near.cast("bigint"))  # 2 ** 63 is no bigint
    return F.when(c["float_value"].isNull() & whole.isNotNull(), above).otherwise(F.lit(0).cast("bigint"))


def sort_keys(c: Column) -> list[Column]:
    """Rank by type (null, number, string, document, array, binary, id, bool, time, pattern), then the value of each type. NaN is the largest number."""
    number = F.coalesce(c["float_value"], c["int64_value"].cast("double"), c["int32_value"].cast("double"), c["decimal128_value"].try_cast("double"))
    values = [number, c["string_value"], c["document_value"], c["array_value"], c["binary_value"], c["objectid_value"], c["bool_value"], c["datetime_value"], c["regex_value"]]
    rank = F.when(c.isNull() | F.coalesce(c["null_value"], F.lit(False)), F.lit(0))
    for k, v in enumerate(values, 1):
        rank = rank.when(v.isNotNull(), F.lit(k))
    return [rank.otherwise(F.lit(10)), number, lost_in_double(c), *values[1:]]
