"""Filter trees to Catalyst expressions.

A compiled test is true where a document matches, and false or null where it does not; only under
negation is null made false. So plain comparisons stay `column op literal`, which reaches the
Parquet scan. Comparisons never cross types: a literal of another type class matches nothing.
Missing fields and nulls are the same in typed columns.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import re
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.filters import expressions, json_schema
from docquarry.filters.tree import All_, Field, InvalidQuery, Negated, Node, Some, Whole, parse
from docquarry.types import is_any

NUMBER, STRING, BOOL, DATE, BINARY, ARRAY, OBJECT, NULL, REGEX = "number", "string", "bool", "date", "binary", "array", "object", "null", "regex"

# Type numbers and aliases.
TYPE_NUMBERS = {1: "double", 2: "string", 3: "object", 4: "array", 5: "binData", 7: "objectId", 8: "bool", 9: "date", 10: "null", 11: "regex", 16: "int", 17: "timestamp", 18: "long", 19: "decimal"}
NUMERIC_ALIASES = {"int", "long", "double", "decimal"}
#: Of a mixed-type column: the children of each type class, and the type alias of each child.
ANY_CLASS = {STRING: ("string_value",), BOOL: ("bool_value",), DATE: ("datetime_value",)}
ANY_ALIAS = {"float_value": "double", "int32_value": "int", "int64_value": "long", "string_value": "string", "objectid_value": "objectId", "decimal128_value": "decimal", "regex_value": "regex", "binary_value": "binData", "document_value": "object", "array_value": "array", "bool_value": "bool", "datetime_value": "date", "null_value": "null"}

def literal_class(value: object) -> str:
    if value is None:
        return NULL
    if isinstance(value, bool):
        return BOOL
    if isinstance(value, (int, float, decimal.Decimal)):
        return NUMBER
    if isinstance(value, str):
        return STRING
    if isinstance(value, (dt.datetime, dt.date)):
        return DATE
    if isinstance(value, (bytes, bytearray)):
        return BINARY
    if isinstance(value, re.Pattern):
        return REGEX
    if isinstance(value, (list, tuple)):
        return ARRAY
    if isinstance(value, Mapping):
        return OBJECT
    raise InvalidQuery(f"no type of document has values like {value!r}")


def column_class(kind: T.DataType) -> str:
    if isinstance(kind, T.NumericType):
        return NUMBER
    if isinstance(kind, T.BooleanType):
        return BOOL
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return DATE
    if isinstance(kind, T.BinaryType):
        return BINARY
    if isinstance(kind, T.ArrayType):
        return ARRAY
    return OBJECT if isinstance(kind, T.StructType) else STRING


def literal(value: object, kind: T.DataType) -> Column:
    """A literal to compare with a column of the same class."""
    if isinstance(value, (dt.datetime, dt.date)):
        if not isinstance(value, dt.datetime):
            value = dt.datetime(value.year, value.month, value.day)
        utc = value.astimezone(dt.UTC) if value.tzinfo else value.replace(tzinfo=dt.UTC)
        if isinstance(kind, T.TimestampType):
            return F.lit(utc)
        return F.lit(utc.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz")
    if isinstance(value, int) and not isinstance(value, bool) and not -(2**63) <= value < 2**63:
        return F.lit(float(value))
    return F.lit(bytes(value)) if isinstance(value, bytearray) else F.lit(value)


def leaves(document: Mapping, above: str = "") -> dict[str, object]:
    """The values of a document by their dotted names, in order."""
    out: dict[str, object] = {}
    for name, value in document.items():
        out |= leaves(value, f"{above}{name}.") if isinstance(value, Mapping) and value else {f"{above}{name}": value}
    return out


def any_true(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns) if columns else F.lit(False)


def all_true(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns) if columns else F.lit(True)


def sure(column: Column) -> Column:
    return F.coalesce(column, F.lit(False))


def any_number(column: Column) -> Column:
    c = column
    return F.coalesce(c["float_value"], c["int64_value"].cast("double"), c["int32_value"].cast("double"), c["decimal128_value"].try_cast("double"))


def any_number_test(op: str, column: Column, value: int | float | decimal.Decimal) -> Column:
    """Whole numbers are compared as such, so that those beyond 2 ** 53 stay apart."""
    whole = not isinstance(value, float) or math.isfinite(value)
    whole = whole and value == int(value) and -(2**63) <= int(value) < 2**63
    exact, near = F.lit(int(value)).cast("bigint") if whole else None, F.lit(float(value))
    tests = [compare(op, column["float_value"], near), compare(op, column["decimal128_value"].try_cast("decimal(38,18)"), exact.cast("decimal(38,18)")) if whole else compare(op, column["decimal128_value"].try_cast("double"), near)]
    for child in ("int64_value", "int32_value"):
        tests.append(compare(op, column[child].cast("bigint"), exact) if whole else compare(op, column[child].cast("double"), near))
    return F.coalesce(*tests, F.lit(False))


def any_is_null(column: Column) -> Column:
    return column.isNull() | sure(column["null_value"])


def compare(op: str, column: Column, value: Column) -> Column:
    return {"$eq": column == value, "$gt": column > value, "$gte": column >= value, "$lt": column < value, "$lte": column <= value}[op]


class Compiler:
    """Compiles for the columns of a schema; a path may be a flat name with dots or lead through structs and arrays of them."""

    def __init__(self, schema: T.StructType, root: Callable[[str], Column] | None = None):
        self.schema = schema
        self.root = root or (lambda name: F.col("`" + name.replace("`", "``") + "`"))
        self.kinds = {f.name: f for f in schema.fields}

    def compile(self, node: Node) -> Column:
        if isinstance(node, All_):
            return all_true([self.compile(i) for i in node.items])
        if isinstance(node, Some):
            return any_true([self.compile(i) for i in node.items])
        if isinstance(node, Negated):
            return ~sure(self.compile(node.item))
        if isinstance(node, Whole):
            if node.op == "$expr":
                return expressions.truth(expressions.compile_expression(node.value, self))
            return json_schema.compile_schema(node.value, self)
        if isinstance(node, Field):
            return self.at_path(node)
        raise InvalidQuery(f"cannot compile {node!r}")

    def resolve(self, path: str) -> tuple[Column, T.DataType, list[str], dict] | None:
        """The column that the longest flat name of a path gives, with the parts of the path that are left."""
        parts = path.split(".")
        for k in range(len(parts), 0, -1):
            if (name := ".".join(parts[:k])) in self.kinds:
                field = self.kinds[name]
                return self.root(name), field.dataType, parts[k:], field.metadata or {}
        return None

    def at_path(self, node: Field) -> Column:
        found = self.resolve(node.path)
        if found is None:
            below = [n for n in self.kinds if n.startswith(f"{node.path}.")]
            return self.parent_test(node, below) if below else self.missing(node)
        column, kind, rest, metadata = found
        return self.descend(column, kind, rest, node, metadata)

    def parent_test(self, node: Field, below: list[str]) -> Column:
        """A test of a document of which only the fields below are columns: it is null if all of them are."""
        op, value = node.op, node.value
        there = any_true([self.root(n).isNotNull() for n in below])
        if op == "$exists":
            return there if value else ~there
        if value is None and op in ("$eq", "$gte", "$lte"):
            return ~there
        if value is None and op in ("$gt", "$lt"):
            return F.lit(False)
        if op == "$in":
            return any_true([self.parent_test(Field(node.path, "$eq", v), below) for v in value])
        if op == "$type":
            wanted = {TYPE_NUMBERS.get(n, n) for n in value}
            return any_true([there] * ("object" in wanted) + [~there] * ("null" in wanted))
        if op == "$eq" and isinstance(value, Mapping):
            given = leaves(value, f"{node.path}.")
            if list(given) != below:
                return F.lit(False)
            return there & all_true([sure(self.at_path(Field(n, "$eq", v))) for n, v in given.items()])
        if op == "$eq" and literal_class(value) != ARRAY:
            return F.lit(False)  # a document equals no other type
        raise InvalidQuery(f"{node.path} is a parent of columns, which {op} can't test; name a field below it")

    def missing(self, node: Field) -> Column:
        """A field that no document has."""
        null = node.op == "$eq" and node.value is None or node.op == "$in" and None in node.value or node.op in ("$gte", "$lte") and node.value is None or node.op == "$exists" and not node.value
        return F.lit(bool(null))

    def descend(self, column: Column, kind: T.DataType, rest: list[str], node: Field, metadata: dict) -> Column:
        if not rest:
            return self.test(column, kind, node, metadata)
        if isinstance(kind, T.ArrayType):
            if rest[0].isdigit():
                return self.descend(F.get(column, F.lit(int(rest[0]))), kind.elementType, rest[1:], node, {})
            if isinstance(kind.elementType, T.StructType):
                found = F.exists(column, lambda x: sure(self.descend(x, kind.elementType, rest, node, {})))
                return sure(found) | self.missing(node) & sure(F.size(column) == 0) | (column.isNull() & self.missing(node))
            return self.missing(node)
        if isinstance(kind, T.StructType) and rest[0] in kind.names:
            field = kind[rest[0]]
            return self.descend(column.getField(rest[0]), field.dataType, rest[1:], node, field.metadata or {})
        return self.missing(node)

    def test(self, column: Column, kind: T.DataType, node: Field, metadata: dict | None = None) -> Column:
        """A test of a value, and for arrays also of each of their elements."""
        op, value = node.op, node.value
        if op == "$exists":
            there = ~any_is_null(column) if is_any(kind) else column.isNotNull()
            return there if value else ~there
        if op == "$type":
            return self.type_test(column, kind, value, metadata or {})
        if op == "$in":
            return self.in_test(column, kind, value)
        if op == "$geoWithin":
            return expressions.within(column, kind, *value)
        if isinstance(kind, T.ArrayType):
            return self.array_test(column, kind, node)
        if op in ("$elemMatch", "$size"):
            return F.lit(False)
        return self.scalar_test(column, kind, op, value)

    def array_test(self, column: Column, kind: T.ArrayType, node: Field) -> Column:
        op, value, element = node.op, node.value, kind.elementType
        if op == "$size":
            return F.size(column) == value
        if op == "$elemMatch":
            return F.exists(column, lambda x: sure(self.within_element(x, element, value)))
        if op in ("$eq", "$gte", "$lte") and value is None:
            return column.isNull() | F.exists(column, lambda x: x.isNull())
        if isinstance(value, (list, tuple)) and op in ("$eq", "$gt", "$gte", "$lt", "$lte"):
            if any(v is not None and literal_class(v) != column_class(element) for v in value) or not isinstance(element, T.AtomicType):
                return F.lit(False)
            whole = F.array(*[literal(v, element) if v is not None else F.lit(None) for v in value]).cast(T.ArrayType(element))
            return compare(op, column, whole)
        return F.exists(column, lambda x: sure(self.scalar_test(x, element, op, value)))

    def within_element(self, element: Column, kind: T.DataType, tests: Node) -> Column:
        """$elemMatch: tests of the element itself (paths are empty) or of its fields."""
        if isinstance(tests, All_):
            return all_true([self.within_element(element, kind, t) for t in tests.items])
        if isinstance(tests, Some):
            return any_true([self.within_element(element, kind, t) for t in tests.items])
        if isinstance(tests, Negated):
            return ~sure(self.within_element(element, kind, tests.item))
        if isinstance(tests, Field):
            if not tests.path:
                return self.test(element, kind, tests)
            if isinstance(kind, T.StructType) and not is_any(kind):
                return Compiler(kind, element.getField).at_path(tests)
            return F.lit(False)
        raise InvalidQuery("$elemMatch takes tests of values or fields")

    def scalar_test(self, column: Column, kind: T.DataType, op: str, value: object) -> Column:
        if is_any(kind):
            return self.any_test(column, op, value)
        if op == "$regex":
            return column.rlike(regex(value)) if column_class(kind) == STRING else F.lit(False)
        if op == "$mod":
            if column_class(kind) != NUMBER:
                return F.lit(False)
            return column.try_cast("bigint") % F.lit(value[0]) == F.lit(value[1])
        if op.startswith("$bits"):
            return self.bits_test(column, kind, op, value)
        if value is None:
            return column.isNull() if op in ("$eq", "$gte", "$lte") else F.lit(False)
        if isinstance(value, re.Pattern):
            raise InvalidQuery("a pattern can only be matched")
        if isinstance(value, Mapping) and op == "$eq" and isinstance(kind, T.StructType):
            if list(value) != kind.names:
                return F.lit(False)
            return all_true([column.isNotNull(), *[sure(self.test(column.getField(n), kind[n].dataType, Field(n, "$eq", v))) for n, v in value.items()]])
        if literal_class(value) != column_class(kind) or literal_class(value) in (ARRAY, OBJECT):
            return F.lit(False)
        if isinstance(value, float) and math.isnan(value) and not isinstance(kind, (T.DoubleType, T.FloatType)):
            return F.lit(False)
        if isinstance(kind, T.DateType):
            column = column.cast("timestamp_ntz")
        return compare(op, column, literal(value, kind))

    def any_test(self, column: Column, op: str, value: object) -> Column:
        if op == "$regex":
            return column["string_value"].rlike(regex(value))
        if op == "$mod":
            return any_number(column).try_cast("bigint") % F.lit(value[0]) == F.lit(value[1])
        if op.startswith("$bits"):
            return self.bits_test(F.coalesce(column["int64_value"], column["int32_value"].cast("bigint")), T.LongType(), op, value)
        if value is None:
            return any_is_null(column) if op in ("$eq", "$gte", "$lte") else F.lit(False)
        kind = literal_class(value)
        if kind == NUMBER:
            return any_number_test(op, column, value)
        if kind == BINARY:
            return compare(op, F.unbase64(column["binary_value"]), literal(value, T.BinaryType()))
        if kind in ANY_CLASS:
            return any_true([compare(op, column[c], literal(value, T.TimestampNTZType())) for c in ANY_CLASS[kind]])
        return F.lit(False)

    def bits_test(self, column: Column, kind: T.DataType, op: str, mask: int) -> Column:
        if column_class(kind) != NUMBER:
            return F.lit(False)
        number = column if isinstance(kind, T.IntegralType) else F.when(column == F.floor(column), column.try_cast("bigint"))
        bits, whole = number.cast("bigint").bitwiseAND(F.lit(mask)), F.lit(mask)
        return {"$bitsAllClear": bits == 0, "$bitsAllSet": bits == whole, "$bitsAnyClear": bits != whole, "$bitsAnySet": bits != 0}[op]

    def in_test(self, column: Column, kind: T.DataType, values: tuple) -> Column:
        plain = isinstance(kind, T.AtomicType) and not isinstance(kind, T.DateType)
        same = [v for v in values if plain and v is not None and not isinstance(v, re.Pattern) and literal_class(v) == column_class(kind)]
        tests = [column.isin(*[literal(v, kind) for v in same])] if same else []
        for v in values:
            if isinstance(v, re.Pattern):
                from docquarry.filters.tree import pattern_flags

                tests.append(self.test(column, kind, Field("", "$regex", (v.pattern, pattern_flags(v)))))
            elif v is None or not plain:
                tests.append(self.test(column, kind, Field("", "$eq", v)))
        return any_true(tests)

    def type_test(self, column: Column, kind: T.DataType, names: tuple, metadata: dict) -> Column:
        wanted = set()
        for n in names:
            alias = TYPE_NUMBERS.get(n) if isinstance(n, (int, float)) and not isinstance(n, bool) else n
            if alias not in {*TYPE_NUMBERS.values(), "number"}:
                raise InvalidQuery(f"unknown type {n!r}")
            wanted |= NUMERIC_ALIASES if alias == "number" else {alias}
        if is_any(kind):
            tests = [column[child].isNotNull() for child, alias in ANY_ALIAS.items() if alias in wanted and alias != "null"]
            return any_true(tests + ([any_is_null(column)] if "null" in wanted else []))
        tests = [column.isNull()] if "null" in wanted else []
        if type_alias(kind, metadata) in wanted:
            tests.append(column.isNotNull())
        elif isinstance(kind, T.ArrayType) and type_alias(kind.elementType, {}) in wanted:
            tests.append(F.exists(column, lambda x: x.isNotNull()))
        return any_true(tests)


def type_alias(kind: T.DataType, metadata: dict) -> str:
    if metadata.get("kind") == "objectid":
        return "objectId"
    if isinstance(kind, T.LongType):
        return "long"
    if isinstance(kind, T.IntegralType):
        return "int"
    if isinstance(kind, T.DecimalType):
        return "decimal"
    return {NUMBER: "double", STRING: "string", BOOL: "bool", DATE: "date", BINARY: "binData", ARRAY: "array", OBJECT: "object"}[column_class(kind)]


def regex(value: tuple[str, str]) -> str:
    pattern, options = value
    return f"(?{options}){pattern}" if options else pattern


def compile_filter(query: Mapping | None, schema: T.StructType) -> Column:
    return Compiler(schema).compile(parse(query))


def where(df: DataFrame, query: Mapping | None) -> DataFrame:
    """The rows of a frame that match a query document."""
    return df.where(compile_filter(query, df.schema)) if query else df
