"""Schemas of collections: fields, one of which is the time."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry import types as K

SPEC_VERSION = 1


class Schema:
    def __init__(self, time_field: str, fields: Mapping[str, K.FieldType], avg_doc_size_bytes: int = 500, flatten_nested: bool = True):
        if time_field not in fields:
            raise ValueError(f"time field {time_field!r} is not one of the fields {list(fields)}")
        if not isinstance(fields[time_field], (K.Timestamp, K.DateTime)):
            raise ValueError(f"time field {time_field!r} must be a Timestamp or DateTime, not {fields[time_field]!r}")
        self.time_field, self.fields = time_field, dict(fields)
        self.avg_doc_size_bytes, self.flatten_nested = avg_doc_size_bytes, flatten_nested

    @classmethod
    def of(cls, df: DataFrame, time_field: str) -> Schema:
        """The schema of a frame's columns."""
        return cls(time_field, {f.name: K.from_spark(f) for f in df.schema.fields})

    def __repr__(self) -> str:
        return f"Schema(time_field={self.time_field!r}, fields={self.fields!r})"

    def __eq__(self, other) -> bool:
        return isinstance(other, Schema) and self.to_spec() == other.to_spec()

    def get_field_names(self) -> list[str]:
        return list(self.fields)

    def has_field(self, name: str) -> bool:
        return name in self.fields

    def get_field_type(self, name: str) -> K.FieldType:
        return self.fields[name]

    def get_any_fields(self) -> list[str]:
        return [n for n, t in self.fields.items() if isinstance(t, K.Any)]

    def expand(self, name: str) -> list[str]:
        """The field, or the fields below a parent name, in schema order."""
        if name in self.fields:
            return [name]
        below = [n for n in self.fields if n.startswith(f"{name}.")]
        if not below:
            raise ValueError(f"{name!r} is neither a field nor a parent of one; fields: {list(self.fields)}")
        return below

    def to_struct(self) -> T.StructType:
        return T.StructType([T.StructField(n, t.spark(), True, {"kind": "objectid"} if isinstance(t, K.ObjectId) else {}) for n, t in self.fields.items()])

    def to_spec(self) -> dict:
        return {"version": SPEC_VERSION, "time_field": self.time_field, "avg_doc_size_bytes": self.avg_doc_size_bytes, "fields": {n: t.spec() for n, t in self.fields.items()}}

    @classmethod
    def from_spec(cls, spec: dict) -> Schema:
        if spec.get("version") != SPEC_VERSION:
            raise ValueError(f"unknown schema version {spec.get('version')!r}")
        return cls(spec["time_field"], {n: K.from_spec(s) for n, s in spec["fields"].items()}, spec.get("avg_doc_size_bytes", 500))

    def apply(self, df: DataFrame, strict: bool = True) -> DataFrame:
        """The schema's columns of a frame: flat names with dots come from nested ones, missing fields are null.

        A value of the wrong type fails the job if strict, else it becomes null.
        """
        out = []
        for field in self.to_struct().fields:
            if field.name in df.columns:
                column = df[f"`{field.name}`"]
            else:
                head, *rest = field.name.split(".")
                column = F.col(f"`{head}`") if head in df.columns else None
                kind = df.schema[head].dataType if column is not None else None
                for part in rest:
                    if column is None or not isinstance(kind, T.StructType) or part not in kind.names:
                        column = None
                        break
                    column, kind = column.getField(part), kind[part].dataType
            if column is None:
                column = F.lit(None).cast(field.dataType)
            elif dict(df.dtypes).get(field.name) != field.dataType.simpleString():
                column = column.cast(field.dataType) if strict else column.try_cast(field.dataType)
            out.append(column.alias(field.name, metadata=field.metadata))
        return df.select(*out)
