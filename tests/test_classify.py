import datetime as dt

import pytest

from docquarry.filters.classify import PARALLEL, REJECT, SINGLE, classify, or_depth, time_bounds
from docquarry.filters.intervals import Interval, as_utc, chunks, union

A, B, C = (dt.datetime(2024, m, 1, tzinfo=dt.UTC) for m in (1, 2, 3))
SPAN = {"$gte": A, "$lt": B}


@pytest.mark.parametrize("query,mode", [
    ({"t": SPAN}, PARALLEL),
    ({"t": SPAN, "$or": [{"r": 1}, {"r": 2}]}, PARALLEL),
    ({"$or": [{"t": SPAN, "r": 1}, {"t": {"$gte": B, "$lt": C}}]}, PARALLEL),
    ({"$and": [{"$and": [{"t": {"$gte": A}}]}, {"t": {"$lte": B}}]}, PARALLEL),
    ({"t": A}, PARALLEL),
    ({"t": SPAN, "x": {"$nin": [1]}}, PARALLEL),
    ({"t": SPAN, "$nor": [{"x": 1}]}, PARALLEL),
    ({"t": SPAN, "$nor": [{"t": A}]}, SINGLE),
    ({"$or": [{"$or": [{"t": SPAN}]}]}, SINGLE),
    ({"$or": []}, REJECT),
    ({"t": SPAN, "$expr": {"$gt": ["$a", 1]}}, SINGLE),
    ({"t": SPAN, "x": {"$elemMatch": {"$expr": 1}}}, SINGLE),
    ({"t": SPAN, "x": {"$new": 1}}, SINGLE),
    ({"t": {"$not": {"$lt": A}}}, SINGLE),
    ({"x": 1}, SINGLE),
    ({"t": {"$gte": A}}, SINGLE),
    ({"t": {"$gte": B, "$lt": A}}, SINGLE),
    ({"$or": [{"t": SPAN}, {"x": 1}]}, SINGLE),
    ({"x": {"$elemMatch": {"t": SPAN}}}, SINGLE),
    ({}, SINGLE),
])
def test_modes(query, mode):
    assert classify(query, "t").mode == mode


def test_natural_order():
    assert classify({"t": SPAN}, "t", [("$natural", 1)]).mode == SINGLE


def test_bounds():
    assert time_bounds({"t": {"$gt": A, "$lte": B}}, "t") == Interval(A, B, False, True)
    assert time_bounds({"$and": [{"t": {"$gte": A, "$lt": C}}, {"t": {"$lt": B}}]}, "t") == Interval(A, B, True, False)
    assert time_bounds({"t": {"$in": [B, A]}}, "t") == Interval(A, B)
    assert time_bounds({"x": {"$elemMatch": {"t": A}}}, "t") == Interval()
    assert or_depth({"$or": [{"$and": [{"$or": [{}]}]}]}) == 2


def test_intervals():
    assert union([Interval(A, B, True, False), Interval(B, C, False, True)]) == [Interval(A, B, True, False), Interval(B, C, False, True)]
    assert union([Interval(A, B, True, False), Interval(B, C)]) == [Interval(A, C)]
    assert Interval(A, A, True, False).empty and not Interval(A, A).empty
    assert as_utc("2024-01-01T00:00:00Z") == A == as_utc(dt.date(2024, 1, 1))


def test_chunks_cover_a_range_once():
    start = dt.datetime(2024, 1, 1, 12, tzinfo=dt.UTC)
    for hours in (5, 8, 24, 100):
        found = chunks(start, C, dt.timedelta(hours=hours))
        assert found[0][0] == start and found[-1][1] == C
        assert all(a < b for a, b in found) and all(x[1] == y[0] for x, y in zip(found, found[1:], strict=False))
    assert chunks(A, A) == []
    with pytest.raises(ValueError):
        chunks(A, B, dt.timedelta(0))
