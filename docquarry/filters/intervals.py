"""Intervals of times with open or closed ends; None is an end that is not bounded."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass


def as_utc(value: object) -> dt.datetime | None:
    """Times as aware datetimes: naive ones and dates are UTC, ISO strings may end in Z; None if it is no time."""
    if isinstance(value, str):
        try:
            value = dt.datetime.fromisoformat(value)
        except ValueError:
            return None
    if isinstance(value, dt.datetime):
        return value.astimezone(dt.UTC) if value.tzinfo else value.replace(tzinfo=dt.UTC)
    return dt.datetime(value.year, value.month, value.day, tzinfo=dt.UTC) if isinstance(value, dt.date) else None


@dataclass(frozen=True)
class Interval:
    low: dt.datetime | None = None
    high: dt.datetime | None = None
    low_closed: bool = True
    high_closed: bool = True

    @property
    def bounded(self) -> bool:
        return self.low is not None and self.high is not None

    @property
    def empty(self) -> bool:
        return self.bounded and (self.low > self.high or self.low == self.high and not (self.low_closed and self.high_closed))

    def meet(self, other: Interval) -> Interval:
        low, low_closed = max(((i.low, i.low_closed) for i in (self, other) if i.low is not None), key=lambda e: (e[0], not e[1]), default=(None, True))
        high, high_closed = min(((i.high, i.high_closed) for i in (self, other) if i.high is not None), key=lambda e: (e[0], e[1]), default=(None, True))
        return Interval(low, high, low_closed, high_closed)

    def hull(self, other: Interval) -> Interval:
        low, low_closed = (None, True) if None in (self.low, other.low) else min(((i.low, i.low_closed) for i in (self, other)), key=lambda e: (e[0], not e[1]))
        high, high_closed = (None, True) if None in (self.high, other.high) else max(((i.high, i.high_closed) for i in (self, other)), key=lambda e: (e[0], e[1]))
        return Interval(low, high, low_closed, high_closed)

    def joins(self, other: Interval) -> bool:
        """Whether the union of two bounded intervals, this one not starting later, has no gap: ends that are both open leave one."""
        return other.low < self.high or other.low == self.high and (self.high_closed or other.low_closed)


def union(intervals: list[Interval]) -> list[Interval]:
    """Bounded intervals as the fewest that cover the same times."""
    out: list[Interval] = []
    for i in sorted((i for i in intervals if not i.empty), key=lambda i: (i.low, not i.low_closed)):
        if out and out[-1].joins(i):
            out[-1] = out[-1].hull(i)
        else:
            out.append(i)
    return out


def chunks(low: dt.datetime, high: dt.datetime, size: dt.timedelta = dt.timedelta(days=1)) -> list[tuple[dt.datetime, dt.datetime]]:
    """Half-open pieces of [low, high) that end at multiples of size from the first day's start."""
    if size <= dt.timedelta(0):
        raise ValueError("chunks need a positive size")
    day = low.replace(hour=0, minute=0, second=0, microsecond=0)
    out, end = [], day + ((low - day) // size + 1) * size
    while low < high:
        out.append((low, min(end, high)))
        low, end = out[-1][1], end + size
    return out
