"""Aggregation expressions as typed columns, and areas.

Every expression has a static class of values, so that nothing is cast from one class to another:
values of different classes compare by the order of their classes, and an operator that gets a
value it is not made for gives null.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.filters.tree import InvalidQuery, UnsupportedOperator
from docquarry.types import is_any

NULL, NUMBER, STRING, OBJECT, ARRAY, BINARY, BOOL, DATE = "null", "number", "string", "object", "array", "binary", "bool", "date"
# The order of classes, lowest first.
RANKS = {NULL: 0, NUMBER: 1, STRING: 2, OBJECT: 3, ARRAY: 4, BINARY: 5, BOOL: 7, DATE: 8}


class Typed(NamedTuple):
    column: Column
    kind: str
    element: T.DataType | None = None  # of arrays, if known


def nothing() -> Typed:
    return Typed(F.lit(None), NULL)


def class_of(kind: T.DataType) -> str:
    for found, types in (
        (NUMBER, T.NumericType), (BOOL, T.BooleanType), (DATE, (T.TimestampType, T.TimestampNTZType, T.DateType)),
        (BINARY, T.BinaryType), (ARRAY, T.ArrayType), (OBJECT, (T.StructType, T.MapType)), (NULL, T.NullType),
    ):
        if isinstance(kind, types):
            return found
    return STRING


def typed(column: Column, kind: T.DataType) -> Typed:
    if isinstance(kind, (T.TimestampType, T.DateType)):
        column = column.cast("timestamp_ntz")  # the session's zone is UTC for both
    return Typed(column, class_of(kind), kind.elementType if isinstance(kind, T.ArrayType) else None)


def constant(value: object) -> Typed:
    from docquarry.filters.compile import literal, literal_class

    kind = literal_class(value)
    if kind == DATE:
        return Typed(literal(value, T.TimestampNTZType()), DATE)
    if kind == OBJECT:
        raise InvalidQuery(f"documents can't be compared in expressions: {value!r}")
    return Typed(literal(value, T.NullType()) if value is not None else F.lit(None), kind)


def rank(x: Typed) -> Column:
    return F.when(x.column.isNull(), F.lit(0)).otherwise(F.lit(RANKS[x.kind]))


def ordered(op: str, a: Typed, b: Typed) -> Column:
    """A comparison over all classes: null is lowest, and equal to null alone."""
    x, y = (a.column, b.column) if a.kind == b.kind else (rank(a), rank(b))
    same = a.column.eqNullSafe(b.column) if a.kind == b.kind else a.column.isNull() & b.column.isNull()
    less = F.coalesce(x < y, a.column.isNull() & b.column.isNotNull())
    return {"$eq": same, "$ne": ~same, "$lt": less, "$lte": less | same, "$gt": ~(less | same), "$gte": ~less}[op]


def truth(x: Typed) -> Column:
    """Null, false and 0 are false; everything else is true, texts that say false among it."""
    if x.kind == NULL:
        return F.lit(False)
    if x.kind == BOOL:
        return F.coalesce(x.column, F.lit(False))
    return F.coalesce(x.column != 0, F.lit(False)) if x.kind == NUMBER else x.column.isNotNull()


def whole(x: Column) -> Column:
    return x.cast("int")


def substring(text: Column, start: Column, length: Column) -> Column:
    return F.substring(text, whole(start) + 1, F.when(length < 0, F.length(text)).otherwise(whole(length)))


def rounded(x: Column, places: Column | None = None, down: bool = False) -> Column:
    factor = F.pow(F.lit(10.0), F.lit(0.0) if places is None else places.cast("double"))
    scaled = x.cast("double") * factor
    return (F.when(scaled < 0, F.ceil(scaled)).otherwise(F.floor(scaled)) if down else F.rint(scaled)) / factor


def divided(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


#: By operator: classes of the operands (the last one stands for all further), the result's class, and how it is made.
OPERATORS: dict[str, tuple[tuple[str, ...], str, Callable[..., Column]]] = {
    "$abs": ((NUMBER,), NUMBER, F.abs), "$ceil": ((NUMBER,), NUMBER, F.ceil), "$floor": ((NUMBER,), NUMBER, F.floor),
    "$sqrt": ((NUMBER,), NUMBER, lambda a: F.when(a >= 0, F.sqrt(a))), "$exp": ((NUMBER,), NUMBER, F.exp), "$ln": ((NUMBER,), NUMBER, lambda a: F.when(a > 0, F.ln(a))),
    "$log10": ((NUMBER,), NUMBER, lambda a: F.when(a > 0, F.log10(a))), "$pow": ((NUMBER, NUMBER), NUMBER, F.pow),
    "$round": ((NUMBER, NUMBER), NUMBER, rounded), "$trunc": ((NUMBER, NUMBER), NUMBER, lambda a, p=None: rounded(a, p, True)),
    "$add": ((NUMBER,), NUMBER, lambda *x: reduce(F.try_add, x)), "$multiply": ((NUMBER,), NUMBER, lambda *x: reduce(F.try_multiply, x)),
    "$subtract": ((NUMBER, NUMBER), NUMBER, F.try_subtract), "$divide": ((NUMBER, NUMBER), NUMBER, divided), "$mod": ((NUMBER, NUMBER), NUMBER, lambda a, b: F.try_mod(a, b)),
    "$toLower": ((STRING,), STRING, F.lower), "$toUpper": ((STRING,), STRING, F.upper), "$concat": ((STRING,), STRING, F.concat),
    "$strLenCP": ((STRING,), NUMBER, F.length), "$strLenBytes": ((STRING,), NUMBER, F.octet_length), "$trim": ((STRING,), STRING, lambda a: F.btrim(a, F.lit(" \t\n\r\f\v\0"))),
    "$substrCP": ((STRING, NUMBER, NUMBER), STRING, substring), "$indexOfCP": ((STRING, STRING), NUMBER, lambda a, b: F.position(b, a) - 1),
    "$strcasecmp": ((STRING, STRING), NUMBER, lambda a, b: F.when(F.upper(a) < F.upper(b), -1).when(F.upper(a) > F.upper(b), 1).when(F.upper(a) == F.upper(b), 0)),
    "$year": ((DATE,), NUMBER, F.year), "$month": ((DATE,), NUMBER, F.month), "$dayOfMonth": ((DATE,), NUMBER, F.dayofmonth), "$hour": ((DATE,), NUMBER, F.hour),
    "$minute": ((DATE,), NUMBER, F.minute), "$second": ((DATE,), NUMBER, F.second), "$dayOfYear": ((DATE,), NUMBER, F.dayofyear), "$dayOfWeek": ((DATE,), NUMBER, F.dayofweek),
    "$isoWeek": ((DATE,), NUMBER, F.weekofyear), "$isoDayOfWeek": ((DATE,), NUMBER, lambda a: F.weekday(a) + 1), "$millisecond": ((DATE,), NUMBER, lambda a: F.date_format(a, "SSS").cast("int")),
    "$size": ((ARRAY,), NUMBER, F.size),
    "$toString": ((NUMBER,), STRING, lambda a: a.cast("string")), "$toDouble": ((NUMBER,), NUMBER, lambda a: a.cast("double")),
    "$toInt": ((NUMBER,), NUMBER, lambda a: a.try_cast("int")), "$toLong": ((NUMBER,), NUMBER, lambda a: a.try_cast("bigint")),
}


def compile_expression(e: object, compiler) -> Typed:
    """Strings that begin with $ are field paths, documents with one $ key are operators, all else is literal."""
    if isinstance(e, str) and e.startswith("$"):
        return field(e[1:], compiler)
    if isinstance(e, (list, tuple)):
        parts = [compile_expression(x, compiler) for x in e]
        return Typed(F.array(*[p.column for p in parts]), ARRAY) if one_class(parts) else array_error(e)
    if not isinstance(e, Mapping):
        return constant(e)
    if len(e) != 1:
        raise InvalidQuery(f"an expression has one operator: {list(e)}")
    op, operand = next(iter(e.items()))
    if op == "$literal":
        return constant(operand)
    if op == "$cond":
        if isinstance(operand, Mapping):
            operand = [operand["if"], operand["then"], operand["else"]]
        test, yes, no = (compile_expression(x, compiler) for x in operand)
        return chosen([yes, no], lambda y, n: F.when(truth(test), y).otherwise(n))
    if op == "$switch":
        tests = [truth(compile_expression(b["case"], compiler)) for b in operand["branches"]]
        values = [compile_expression(x, compiler) for x in [*[b["then"] for b in operand["branches"]], operand.get("default")]]
        return chosen(values, lambda *v: reduce(lambda rest, tv: F.when(tv[0], tv[1]).otherwise(rest), reversed(list(zip(tests, v, strict=False))), v[-1]))
    listed = operand if isinstance(operand, (list, tuple)) else [operand]
    if op == "$in" and len(listed) == 2 and isinstance(listed[1], (list, tuple)):
        value = compile_expression(listed[0], compiler)
        return Typed(reduce(lambda a, b: a | b, [ordered("$eq", value, compile_expression(x, compiler)) for x in listed[1]], F.lit(False)), BOOL)
    parts = [compile_expression(x, compiler) for x in listed]
    if op == "$in":
        value, among = parts
        if among.kind != ARRAY or among.element is not None and class_of(among.element) != value.kind:
            return Typed(F.lit(False), BOOL)
        return Typed(F.coalesce(F.array_contains(among.column, value.column), F.lit(False)), BOOL)
    if op in ("$eq", "$ne", "$gt", "$gte", "$lt", "$lte"):
        return Typed(ordered(op, *parts), BOOL)
    if op == "$cmp":
        return Typed(F.when(ordered("$lt", *parts), -1).when(ordered("$gt", *parts), 1).otherwise(0), NUMBER)
    if op == "$and":
        return Typed(reduce(lambda a, b: a & b, map(truth, parts), F.lit(True)), BOOL)
    if op == "$or":
        return Typed(reduce(lambda a, b: a | b, map(truth, parts), F.lit(False)), BOOL)
    if op == "$not":
        return Typed(~truth(parts[0]), BOOL)
    if op == "$ifNull":
        return chosen(parts, F.coalesce)
    if op == "$isNumber":
        return Typed(parts[0].column.isNotNull() if parts[0].kind == NUMBER else F.lit(False), BOOL)
    if op == "$isArray":
        return Typed(parts[0].column.isNotNull() if parts[0].kind == ARRAY else F.lit(False), BOOL)
    if op == "$arrayElemAt":
        among, at = parts
        if among.kind != ARRAY or at.kind != NUMBER:
            return nothing()
        place = F.when(at.column < 0, at.column + F.size(among.column)).otherwise(at.column)
        return typed(F.get(among.column, whole(place)), among.element) if among.element is not None else Typed(F.get(among.column, whole(place)), STRING)
    if op == "$split" and isinstance(listed[1], str):
        return Typed(F.split(parts[0].column, "\\Q" + listed[1] + "\\E", -1), ARRAY, T.StringType()) if parts[0].kind == STRING else nothing()
    if op == "$subtract" and [p.kind for p in parts] == [DATE, DATE]:
        return Typed((F.unix_micros(parts[0].column.cast("timestamp")) - F.unix_micros(parts[1].column.cast("timestamp"))) / 1000, NUMBER)
    if op == "$toString" and parts[0].kind == STRING:
        return parts[0]
    if op in ("$toDouble", "$toInt", "$toLong") and parts[0].kind == STRING:
        return Typed(parts[0].column.try_cast({"$toDouble": "double", "$toInt": "int", "$toLong": "bigint"}[op]), NUMBER)
    if op in OPERATORS:
        classes, result, made = OPERATORS[op]
        classes = [*classes, *[classes[-1]] * (len(parts) - len(classes))][: len(parts)]
        if any(p.kind != c for p, c in zip(parts, classes, strict=True)):
            return nothing()
        return Typed(made(*[p.column for p in parts]), result)
    raise UnsupportedOperator(f"unknown expression operator {op}")


def field(path: str, compiler) -> Typed:
    found = compiler.resolve(path)
    if found is None:
        return nothing()
    column, kind, rest, _ = found
    for part in rest:
        if not isinstance(kind, T.StructType) or part not in kind.names:
            return nothing()
        column, kind = column.getField(part), kind[part].dataType
    if is_any(kind):
        raise UnsupportedOperator(f"{path} holds values of mixed types, which expressions can't take")
    return typed(column, kind)


def one_class(parts: list[Typed]) -> bool:
    return len({p.kind for p in parts if p.kind != NULL}) <= 1


def array_error(e: object) -> Typed:
    raise InvalidQuery(f"an array in an expression has values of one type: {e!r}")


def chosen(parts: list[Typed], made: Callable[..., Column]) -> Typed:
    """One of the parts, which have one class; nulls aside."""
    if not one_class(parts):
        raise InvalidQuery("the branches of an expression have values of one type")
    best = next((p for p in parts if p.kind != NULL), parts[0])
    return Typed(made(*[p.column for p in parts]), best.kind, best.element)


def within(column: Column, kind: T.DataType, area: str, numbers: tuple) -> Column:
    """Whether a point, an array of two numbers or a struct whose first fields they are, lies in an area."""
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType):
        x, y = F.get(column, F.lit(0)), F.get(column, F.lit(1))
    elif isinstance(kind, T.StructType) and len(kind.fields) >= 2 and all(isinstance(f.dataType, T.NumericType) for f in kind.fields[:2]):
        x, y = column.getField(kind.names[0]), column.getField(kind.names[1])
    else:
        return F.lit(False)
    if area == "$box":
        a, b, c, d = numbers
        return x.between(min(a, c), max(a, c)) & y.between(min(b, d), max(b, d))
    if area == "$center":
        a, b, r = numbers
        return (x - a) * (x - a) + (y - b) * (y - b) <= r * r
    if area == "$centerSphere":
        a, b, r = numbers
        half = F.pow(F.sin(F.radians(y - b) / 2), 2) + F.cos(F.radians(y)) * math.cos(math.radians(b)) * F.pow(F.sin(F.radians(x - a) / 2), 2)
        return 2 * F.asin(F.sqrt(F.least(half, F.lit(1.0)))) <= r
    crossings = F.lit(0)
    for (a, b), (c, d) in zip(numbers, (*numbers[1:], numbers[0]), strict=True):
        if b != d:
            crossing = ((y < max(b, d)) & (y >= min(b, d))) & (x < a + (y - b) * ((c - a) / (d - b)))
            crossings = crossings + F.coalesce(crossing, F.lit(False)).cast("int")
    return crossings % 2 == 1
