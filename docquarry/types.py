"""The field types of a collection. All are frozen, comparable and hashable."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import types as T

#: Children of a mixed-type column, in the order in which they are decoded; exactly one of them is set.
ANY_CHILDREN = (
    ("float_value", T.DoubleType()),
    ("int32_value", T.IntegerType()),
    ("int64_value", T.LongType()),
    ("string_value", T.StringType()),
    ("objectid_value", T.StringType()),
    ("decimal128_value", T.StringType()),
    ("regex_value", T.StringType()),
    ("binary_value", T.StringType()),
    ("document_value", T.StringType()),
    ("array_value", T.StringType()),
    ("bool_value", T.BooleanType()),
    ("datetime_value", T.TimestampNTZType()),
    ("null_value", T.BooleanType()),
)
ANY_STRUCT = T.StructType([T.StructField(n, t) for n, t in ANY_CHILDREN])


@dataclass(frozen=True)
class FieldType:
    def spark(self) -> T.DataType:
        raise NotImplementedError

    def spec(self) -> dict:
        return {"kind": self.kind}


@dataclass(frozen=True)
class String(FieldType):
    kind = "string"

    def spark(self):
        return T.StringType()


@dataclass(frozen=True)
class Int(FieldType):
    kind = "int64"

    def spark(self):
        return T.LongType()


@dataclass(frozen=True)
class Float(FieldType):
    kind = "float64"

    def spark(self):
        return T.DoubleType()


@dataclass(frozen=True)
class Bool(FieldType):
    kind = "bool"

    def spark(self):
        return T.BooleanType()


@dataclass(frozen=True)
class Timestamp(FieldType):
    """With a zone, an instant; without, local time. Spark keeps microseconds, so ns are cut."""

    unit: str = "ns"
    tz: str | None = "UTC"
    kind = "timestamp"

    def __post_init__(self):
        if self.unit not in ("s", "ms", "us", "ns"):
            raise ValueError(f"unknown time unit {self.unit!r}")

    def spark(self):
        return T.TimestampType() if self.tz else T.TimestampNTZType()

    def spec(self):
        return {"kind": self.kind, "unit": self.unit, "tz": self.tz}


@dataclass(frozen=True)
class DateTime(FieldType):
    tz: str | None = "UTC"
    kind = "timestamp"

    def spark(self):
        return T.TimestampType() if self.tz else T.TimestampNTZType()

    def spec(self):
        return {"kind": self.kind, "unit": "ms", "tz": self.tz}


@dataclass(frozen=True)
class ObjectId(FieldType):
    """Kept as 24 lower-case hexadecimal digits; the field's metadata tells it from a string."""

    kind = "objectid"

    def spark(self):
        return T.StringType()


@dataclass(frozen=True)
class Any(FieldType):
    kind = "any"

    def spark(self):
        return ANY_STRUCT

    def spec(self):
        return {"kind": self.kind, "any_layout": [n for n, _ in ANY_CHILDREN]}


class Struct(FieldType):
    """Named fields; their order does not matter for equality."""

    kind = "struct"

    def __init__(self, fields: Mapping[str, FieldType]):
        object.__setattr__(self, "fields", dict(fields))

    def __eq__(self, other):
        return isinstance(other, Struct) and self.fields == other.fields

    def __hash__(self):
        return hash(frozenset(self.fields.items()))

    def __repr__(self):
        return f"Struct({self.fields!r})"

    def spark(self):
        return T.StructType([T.StructField(n, t.spark()) for n, t in self.fields.items()])

    def spec(self):
        return {"kind": self.kind, "fields": {n: t.spec() for n, t in self.fields.items()}}


@dataclass(frozen=True)
class List(FieldType):
    element: FieldType
    kind = "list"

    def spark(self):
        return T.ArrayType(self.element.spark())

    def spec(self):
        return {"kind": self.kind, "element": self.element.spec()}


def from_spec(spec: dict) -> FieldType:
    kind = spec["kind"]
    if kind == "timestamp":
        return Timestamp(spec.get("unit", "ns"), spec.get("tz"))
    if kind == "struct":
        return Struct({n: from_spec(s) for n, s in spec["fields"].items()})
    if kind == "list":
        return List(from_spec(spec["element"]))
    plain = {t.kind: t for t in (String, Int, Float, Bool, ObjectId, Any)}
    if kind not in plain:
        raise ValueError(f"unknown kind {kind!r}")
    return plain[kind]()


def is_any(kind: T.DataType) -> bool:
    return isinstance(kind, T.StructType) and kind.names == ANY_STRUCT.names


def from_spark(field: T.StructField) -> FieldType:
    """The field type that a Spark column stands for."""
    kind = field.dataType
    if (field.metadata or {}).get("kind") == "objectid":
        return ObjectId()
    if is_any(kind):
        return Any()
    if isinstance(kind, T.StructType):
        return Struct({f.name: from_spark(f) for f in kind.fields})
    if isinstance(kind, T.ArrayType):
        return List(from_spark(T.StructField("element", kind.elementType)))
    if isinstance(kind, T.TimestampType):
        return Timestamp("us", "UTC")
    if isinstance(kind, (T.TimestampNTZType, T.DateType)):
        return Timestamp("us", None)
    if isinstance(kind, T.BooleanType):
        return Bool()
    if isinstance(kind, T.IntegralType):
        return Int()
    return Float() if isinstance(kind, T.NumericType) else String()
