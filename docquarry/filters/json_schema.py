"""The part of JSON schemas that tells rows apart."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.filters.tree import Field, InvalidQuery

IGNORED = {"title", "description"}
# JSON types by their type aliases.
TYPES = {"object": ("object",), "array": ("array",), "number": ("number",), "boolean": ("bool",), "string": ("string",), "null": ("null",)}


def compile_schema(schema: Mapping, compiler) -> Column:
    """A document matches if its required fields are there and each field that is there has its properties."""
    tests = []
    for key, value in schema.items():
        if key == "required":
            tests += [compiler.at_path(Field(n, "$exists", True)) for n in value]
        elif key == "properties":
            tests += [property_test(n, p, compiler) for n, p in value.items()]
        elif key in ("bsonType", "type"):
            if value != "object":
                return F.lit(False)
        elif key not in IGNORED:
            raise InvalidQuery(f"$jsonSchema keyword {key} is not supported")
    return every(tests)


def every(tests: list[Column]) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def property_test(name: str, rules: Mapping, compiler) -> Column:
    found = compiler.resolve(name)
    if found is None:
        return F.lit(True)
    column, kind, rest, _ = found
    for part in rest:
        if not isinstance(kind, T.StructType) or part not in kind.names:
            return F.lit(True)
        column, kind = column.getField(part), kind[part].dataType
    text, number, listed = isinstance(kind, T.StringType), isinstance(kind, T.NumericType), isinstance(kind, T.ArrayType)
    tests = []
    for key, value in rules.items():
        if key in ("bsonType", "type"):
            names = value if isinstance(value, (list, tuple)) else [value]
            tests.append(compiler.test(column, kind, Field(name, "$type", tuple(x for n in names for x in (TYPES.get(n, (n,)) if key == "type" else (n,))))))
        elif key == "enum":
            tests.append(compiler.in_test(column, kind, tuple(value)))
        elif key == "properties" or key == "required":
            if isinstance(kind, T.StructType):
                tests.append(compile_schema({key: value}, type(compiler)(kind, column.getField)))
        elif key in ("minimum", "maximum"):
            tests.append((column >= value if key == "minimum" else column <= value) if number else F.lit(True))
        elif key == "pattern":
            tests.append(column.rlike(value) if text else F.lit(True))
        elif key in ("minLength", "maxLength"):
            tests.append((F.length(column) >= value if key == "minLength" else F.length(column) <= value) if text else F.lit(True))
        elif key in ("minItems", "maxItems"):
            tests.append((F.size(column) >= value if key == "minItems" else F.size(column) <= value) if listed else F.lit(True))
        elif key not in IGNORED:
            raise InvalidQuery(f"$jsonSchema keyword {key} is not supported")
    return column.isNull() | F.coalesce(every(tests), F.lit(False))
