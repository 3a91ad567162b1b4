"""Sort specifications as sort orders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docquarry import types as K
from docquarry.functions.mixed import sort_keys
from docquarry.schema import Schema


def normalise(sort: object, direction: int = 1) -> list[tuple[str, int]]:
    """A name, a list of names or of (name, direction), or a document, as (name, direction)."""
    if sort is None:
        return []
    if isinstance(sort, str):
        items = [(sort, direction)]
    elif isinstance(sort, dict):
        items = list(sort.items())
    else:
        items = [(x, direction) if isinstance(x, str) else tuple(x) for x in sort]
    for name, way in items:
        if way not in (1, -1):
            raise ValueError(f"sort directions are 1 and -1, not {way!r} for {name!r}")
    return items


def orders(sort: list[tuple[str, int]], schema: Schema) -> list[Column]:
    """Native types: nulls last both ways. Mixed types: by rank of type, null lowest. Parents stand for their fields."""
    out = []
    for name, way in sort:
        if name == "$natural":
            raise ValueError("natural order has no meaning here; sort by a field")
        for field in schema.expand(name):
            column = F.col(f"`{field}`")
            if isinstance(schema.get_field_type(field), K.Any):
                out += [k.asc_nulls_first() if way == 1 else k.desc_nulls_last() for k in sort_keys(column)]
            else:
                out.append(column.asc_nulls_last() if way == 1 else column.desc_nulls_last())
    return out
