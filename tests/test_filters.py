import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from docquarry.filters.compile import compile_filter, where
from docquarry.filters.tree import ALWAYS, CONDITIONAL, NEVER, InvalidQuery, UnsupportedOperator, parse

SCHEMA = "id long, i long, x double, s string, b boolean, t timestamp_ntz, tags array<string>, nums array<long>, d struct<k:long,n:struct<m:string>>, items array<struct<k:string,v:long>>"


def documents(n=300):
    rng = random.Random(42)
    pick = lambda *v: rng.choice([None, *v])
    out = []
    for k in range(n):
        item = lambda: {"k": pick("a", "b"), "v": pick(1, 2, 3)}
        out.append({
            "id": k, "i": pick(-7, 0, 1, 5, 42), "x": pick(-1.5, 0.0, 2.5, 5.0), "s": pick("", "a", "abc", "ABC", "b c"), "b": pick(True, False),
            "t": pick(dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1, 3)), "tags": pick([], ["a"], ["a", "b"], ["b", None]), "nums": pick([], [1], [1, 5, 9], [-7]),
            "d": pick({"k": pick(1, 2), "n": pick({"m": "a"}, {"m": None})}), "items": pick([], [item()], [item(), item()]),
        })
    return out


# a plain matcher


def values(doc, path):
    """The values at a path: those that arrays on the way hold each, and the value itself."""
    if not path:
        return [doc]
    head, *rest = path
    if isinstance(doc, list):
        found = [v for e in doc if isinstance(e, dict) for v in values(e, path)]
        return found
    return values(doc.get(head), rest) if isinstance(doc, dict) else [None]


def kind(v):
    return bool if isinstance(v, bool) else float if isinstance(v, (int, float)) else type(v)


def single(v, op, arg):
    if op == "$eq":
        return v is None if arg is None else v is not None and kind(v) is kind(arg) and v == arg
    if op in ("$gt", "$gte", "$lt", "$lte"):
        if arg is None:
            return v is None and op in ("$gte", "$lte")
        if v is None or kind(v) is not kind(arg):
            return False
        return {"$gt": v > arg, "$gte": v >= arg, "$lt": v < arg, "$lte": v <= arg}[op]
    if op == "$in":
        return any(bool(isinstance(v, str) and a.search(v)) if isinstance(a, re.Pattern) else single(v, "$eq", a) for a in arg)
    if op == "$regex":
        return isinstance(v, str) and re.search(arg, v) is not None
    if op == "$mod":
        return kind(v) is float and abs(int(v)) % arg[0] * (-1 if v < 0 else 1) == arg[1]
    if op == "$bitsAllSet":
        return kind(v) is float and v == int(v) and int(v) & arg == arg
    raise AssertionError(op)


def field(doc, path, op, arg):
    if op == "$ne":
        return not field(doc, path, "$eq", arg)
    if op == "$nin":
        return not field(doc, path, "$in", arg)
    if op == "$not":
        return not all(field(doc, path, o, a) for o, a in arg.items())
    found = values(doc, path.split("."))
    if op == "$exists":
        return any(v is not None for v in found) == arg
    if op == "$size":
        return any(isinstance(v, list) and len(v) == arg for v in found)
    if op == "$all":
        return bool(arg) and all(field(doc, path, "$eq", a) for a in arg)
    if op == "$elemMatch":
        if next(iter(arg)).startswith("$") and next(iter(arg)) not in ("$and", "$or", "$nor"):
            return any(isinstance(v, list) and any(all(single(e, o, a) for o, a in arg.items()) for e in v) for v in found)
        return any(isinstance(v, list) and any(isinstance(e, dict) and matches(e, arg) for e in v) for v in found)
    if isinstance(arg, list) and op == "$eq":
        return any(isinstance(v, list) and v == arg for v in found)
    return any(any(single(e, op, arg) for e in v) if isinstance(v, list) else single(v, op, arg) for v in found)


def matches(doc, query):
    for key, value in query.items():
        if key == "$and":
            ok = all(matches(doc, q) for q in value)
        elif key == "$or":
            ok = any(matches(doc, q) for q in value)
        elif key == "$nor":
            ok = not any(matches(doc, q) for q in value)
        elif isinstance(value, dict) and value and next(iter(value)).startswith("$"):
            ok = all(field(doc, key, o, a) for o, a in value.items())
        else:
            ok = field(doc, key, "$eq", value)
        if not ok:
            return False
    return True


QUERIES = [
    {}, {"i": 5}, {"i": None}, {"i": {"$ne": 5}}, {"i": {"$ne": None}}, {"i": {"$gt": 0, "$lte": 5}}, {"i": {"$gte": None}}, {"i": "5"}, {"i": {"$ne": "5"}}, {"i": 5.0}, {"i": {"$lt": 2.5}},
    {"x": 5}, {"x": {"$in": [5, -1.5, "a"]}}, {"x": {"$nin": [5, None]}}, {"s": {"$gt": "a"}}, {"s": {"$regex": "^a"}}, {"s": {"$not": {"$regex": "b"}}}, {"s": {"$in": [re.compile("c$"), ""]}},
    {"b": True}, {"b": 1}, {"b": {"$ne": True}}, {"t": dt.datetime(2024, 1, 1)}, {"t": {"$gt": dt.datetime(2024, 1, 1)}}, {"t": {"$gt": "2024-01-01"}}, {"t": {"$not": {"$lt": dt.datetime(2024, 1, 2)}}},
    {"tags": "a"}, {"tags": {"$ne": "a"}}, {"tags": ["a", "b"]}, {"tags": {"$all": ["a", "b"]}}, {"tags": {"$all": []}}, {"tags": {"$size": 0}}, {"tags": {"$in": ["b", "z"]}}, {"tags": {"$nin": ["b"]}}, {"tags": {"$regex": "^b"}},
    {"nums": {"$gt": 4}}, {"nums": {"$gt": 4, "$lt": 2}}, {"nums": {"$elemMatch": {"$gt": 4, "$lt": 6}}}, {"nums": {"$not": {"$elemMatch": {"$gt": 4}}}}, {"i": {"$elemMatch": {"$gt": 0}}}, {"i": {"$size": 1}},
    {"d.k": 1}, {"d.k": {"$ne": 1}}, {"d.n.m": "a"}, {"d.n.m": None}, {"d.n.m": {"$exists": True}}, {"d.q": None}, {"d.q": {"$exists": False}}, {"nope": 1}, {"nope": {"$ne": 1}}, {"nope": {"$exists": False}},
    {"items.v": 2}, {"items.v": {"$gt": 2}}, {"items.k": {"$ne": "a"}}, {"items": {"$elemMatch": {"k": "a", "v": {"$gte": 2}}}}, {"items": {"$elemMatch": {"$or": [{"k": "b"}, {"v": 1}]}}},
    {"i": {"$mod": [3, -1]}}, {"i": {"$mod": [5, 2]}}, {"i": {"$bitsAllSet": 5}}, {"$and": []}, {"$and": [{"i": {"$gt": 0}}, {"i": {"$lt": 42}}]}, {"$or": [{"i": 5}, {"$or": [{"x": 5.0}, {"s": "a"}]}]},
    {"$nor": [{"i": 5}, {"s": "a"}]}, {"$nor": []}, {"$nor": [{"$and": [{"i": {"$gt": 0}}, {"tags": "a"}]}]}, {"i": {"$not": {"$gt": 1, "$lt": 50}}}, {"$and": [{"$or": [{"i": 1}, {"i": 5}]}, {"$or": [{"b": True}, {"x": 2.5}]}]},
]


def test_compiled_filters_match_a_plain_matcher(spark):
    docs = documents()
    df = spark.createDataFrame(docs, SCHEMA).cache()
    for query in QUERIES:
        got = {r["id"] for r in where(df, query).select("id").collect()}
        want = {d["id"] for d in docs if matches(d, query)}
        assert got == want, query


def test_repeated_regex_options_and_patterns(spark):
    df = spark.createDataFrame([("Abc",), ("xabc",), (None,)], "s string")
    assert where(df, {"s": {"$regex": "^abc", "$options": "i"}}).count() == 1
    assert where(df, {"s": re.compile("ABC", re.I)}).count() == 2
    assert where(df, {"s": {"$not": re.compile("^x")}}).count() == 2


@pytest.mark.parametrize("query", [{"$or": []}, {"i": {"$mod": [0, 1]}}, {"i": {"$size": -1}}, {"i": {"$in": 3}}, {"i": {"$gt": 1, "k": 2}}, {"s": {"$regex": "a", "$options": "q"}}, {"$gt": 3}, {"i": {"$type": "nothing"}}, {"i": {"$bitsAllSet": -1}}, {"i": {"$not": 3}}])
def test_invalid_queries(spark, query):
    with pytest.raises(InvalidQuery):
        compile_filter(query, spark.createDataFrame([], SCHEMA).schema)


@pytest.mark.parametrize("query", [{"$where": "1"}, {"$text": {}}, {"i": {"$near": [1, 2]}}, {"i": {"$later": 1}}, {"$later": 1}])
def test_unsupported_operators(query):
    with pytest.raises(UnsupportedOperator):
        parse(query)


def test_operator_classes():
    assert (len(ALWAYS), len(CONDITIONAL), len(NEVER)) == (23, 3, 17)
    assert not (ALWAYS & CONDITIONAL or ALWAYS & NEVER or CONDITIONAL & NEVER)


def test_filters_reach_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    found = where(df, {"ts": {"$gte": dt.datetime(2024, 1, 5), "$lt": dt.datetime(2024, 1, 9)}, "event_type": {"$in": ["click", "view"]}, "user_id": {"$gt": 3}}).select("event_id")
    plan = df._sc._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    pushed = next(line for line in plan.splitlines() if "PushedFilters" in line)
    for part in ("GreaterThanOrEqual(ts", "LessThan(ts", "In(event_type", "GreaterThan(user_id"):
        assert part in pushed
    assert "props" not in next(line for line in plan.splitlines() if "ReadSchema" in line)


def test_expr_and_areas(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [2.0, 2.0]), (3, [9.0, 1.0]), (4, None)], "id int, at array<double>")
    ids = lambda q: sorted(r["id"] for r in where(df, q).collect())
    assert ids({"at": {"$geoWithin": {"$box": [[-1, -1], [3, 3]]}}}) == [1, 2]
    assert ids({"at": {"$geoWithin": {"$polygon": [[1, 1], [10, 0], [1, 3]]}}}) == [2]
    assert ids({"at": {"$geoWithin": {"$centerSphere": [[0, 0], 0.05]}}}) == [1, 2]
    assert ids({"$expr": {"$or": [{"$lt": ["$id", 2]}, {"$eq": [{"$mod": ["$id", 2]}, 0]}]}}) == [1, 2, 4]
    assert ids({"$expr": {"$cond": [{"$gt": ["$id", 2]}, True, False]}}) == [3, 4]
    assert where(df, {"at": {"$not": {"$geoWithin": {"$center": [[0, 0], 1]}}}}).agg(F.count("*")).first()[0] == 3
