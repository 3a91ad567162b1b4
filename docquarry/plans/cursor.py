"""Cursors: lazy queries of a collection."""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry import types as K
from docquarry.filters.classify import PARALLEL, REJECT, classify
from docquarry.filters.compile import compile_filter, literal
from docquarry.filters.intervals import as_utc, chunks
from docquarry.functions.mixed import decode, decode_value
from docquarry.operators import buckets
from docquarry.operators.ordering import normalise, orders
from docquarry.sources.cache import ResultCache, fingerprint, state_of

COERCE = ("raise", "error")


def boundary(value: object, name: str) -> dt.datetime | None:
    """A date bound: a datetime, a date (its midnight in UTC) or an ISO string with a zone."""
    if value is None:
        return None
    if isinstance(value, str):
        at = dt.datetime.fromisoformat(value)
        if at.tzinfo is None:
            raise ValueError(f"{name} needs a time zone: {value!r}")
        return as_utc(at)
    if not isinstance(value, (dt.datetime, dt.date)):
        raise TypeError(f"{name} is a datetime, a date or an ISO string, not {type(value).__name__}")
    return as_utc(value)


class Cursor:
    """A query that runs when it is asked for rows. Settings change the cursor until iteration has begun."""

    def __init__(self, collection, query: Mapping | None = None, projection: Mapping | list | None = None, skip: int = 0, limit: int = 0, sort: object = None, batch_size: int = 1000):
        self.collection, self.query = collection, dict(query or {})
        self.projection = {n: 1 for n in projection} if isinstance(projection, (list, tuple)) else dict(projection or {})
        self._rows: Iterator | None = None
        self._skip = self._limit = 0
        self._sort: list[tuple[str, int]] = []
        self.skip(skip).limit(limit).batch_size(batch_size)
        self._sort = normalise(sort)

    def _open(self) -> None:
        if self._rows is not None:
            raise RuntimeError("the cursor has begun")

    def skip(self, n: int) -> Cursor:
        self._open()
        if n < 0:
            raise ValueError("skip is 0 or more")
        self._skip = n
        return self

    def limit(self, n: int) -> Cursor:
        """0 is no limit."""
        self._open()
        if n < 0:
            raise ValueError("limit is 0 or more")
        self._limit = n
        return self

    def sort(self, key: object, direction: int = 1) -> Cursor:
        self._open()
        self._sort = normalise(key, direction)
        return self

    def batch_size(self, n: int) -> Cursor:
        self._open()
        if n < 1:
            raise ValueError("batch_size is 1 or more")
        self._batch_size = n
        return self

    def raw_cursor(self) -> DataFrame:
        """The plan itself."""
        return self.to_df()

    def clone(self) -> Cursor:
        return Cursor(self.collection, self.query, self.projection, self._skip, self._limit, self._sort, self._batch_size)

    def rewind(self) -> Cursor:
        self._rows = None
        return self

    # plans

    def columns(self) -> list[str]:
        """The columns of the result. The projection must leave the time field and the sort fields."""
        schema = self.collection.schema
        chosen = {n: v for n, v in self.projection.items() if n != "_id"}
        if not chosen:
            return schema.get_field_names()
        kinds = {bool(v) for v in chosen.values()}
        if len(kinds) > 1:
            raise ValueError("a projection includes or excludes fields, not both")
        named, include = {f for n in chosen for f in schema.expand(n)}, kinds.pop()
        out = [f for f in schema.get_field_names() if (f in named) == include]
        if schema.time_field not in out:
            raise ValueError(f"the projection must leave the time field {schema.time_field!r}")
        for name, _ in self._sort:
            if name != "$natural" and (lost := [f for f in schema.expand(name) if f not in out]):
                raise ValueError(f"the projection must leave the sort fields, not drop {lost}")
        return out

    def to_df(self, start_date: object = None, end_date: object = None, any_type_strategy: str = "keep_struct", coerce: str = "raise") -> DataFrame:
        """The result as a lazy frame; start_date is included, end_date is not."""
        return self._decoded(self._undecoded(start_date, end_date, coerce), any_type_strategy)

    def _decoded(self, df: DataFrame, strategy: str) -> DataFrame:
        mixed = set(self.collection.schema.get_any_fields())
        return df.select(*[decode(F.col(f"`{c}`"), strategy).alias(c) if c in mixed else F.col(f"`{c}`") for c in df.columns])

    def _undecoded(self, start_date: object, end_date: object, coerce: str) -> DataFrame:
        if coerce not in COERCE:
            raise ValueError(f"coerce is one of {COERCE}")
        columns, schema = self.columns(), self.collection.schema
        order = orders(self._sort, schema)
        df = self.collection.frame(strict=coerce == "raise")
        df = df.where(compile_filter(self.query, df.schema)) if self.query else df
        kind, when = df.schema[schema.time_field].dataType, F.col(f"`{schema.time_field}`")
        if (low := boundary(start_date, "start_date")) is not None:
            df = df.where(when >= literal(low, kind))
        if (high := boundary(end_date, "end_date")) is not None:
            df = df.where(when < literal(high, kind))
        if order:
            df = df.orderBy(*order)
        if self._skip:
            df = df.offset(self._skip)
        if self._limit:
            df = df.limit(self._limit)
        return df.select(*[F.col(f"`{c}`") for c in columns])

    def cached(self, root: str, cache_read: bool = True, cache_write: bool = True, start_date: object = None, end_date: object = None, any_type_strategy: str = "keep_struct", coerce: str = "raise") -> DataFrame:
        """The result through a folder of kept results; reading and writing it are independent.

        Rows are kept undecoded and come back in the order of the sort, whose fields are always among
        them. A collection of a frame needs a source, or results of different frames would be one.
        """
        c = self.collection
        if not c.source:
            raise ValueError("results are kept by their source: give the collection source=")
        extra = [self.query, self._skip, self._limit, str(start_date), str(end_date), coerce, state_of(c.spark, c.source)]
        cache = ResultCache(c.spark, root, fingerprint(c.source, c.schema, {"q": extra}, self.projection, self._sort))
        if not (cache_read and cache.exists()):
            made = self._undecoded(start_date, end_date, coerce)
            if not cache_write:
                return self._decoded(made, any_type_strategy)
            cache.write(made)
        found = cache.read()
        order = orders(self._sort, c.schema)
        return self._decoded(found.orderBy(*order) if order else found, any_type_strategy)

    # results

    def _options(self, accelerate: bool = True, max_workers: int = 4, chunking_granularity: dt.timedelta | None = None, row_group_size: int | None = None, flush_ram_limit_mb: int = 512) -> None:
        """Settings of the parallel fetch are checked and reported by explain(), but Spark schedules the work."""
        if chunking_granularity is not None and chunking_granularity <= dt.timedelta(0):
            raise ValueError("chunking_granularity must be positive")
        if max_workers < 1 or flush_ram_limit_mb < 1 or row_group_size is not None and row_group_size < 1:
            raise ValueError("max_workers, flush_ram_limit_mb and row_group_size are 1 or more")
        if classify(self.query, self.collection.schema.time_field, self._sort).mode == REJECT:
            raise ValueError("the filter has a $or without branches")

    def _frame(self, start_date, end_date, any_type_strategy, coerce, cache_root, cache_read, cache_write) -> DataFrame:
        options = {"start_date": start_date, "end_date": end_date, "any_type_strategy": any_type_strategy, "coerce": coerce}
        return self.cached(cache_root, cache_read, cache_write, **options) if cache_root else self.to_df(**options)

    def to_dataframe(self, start_date=None, end_date=None, coerce="raise", any_type_strategy="keep_struct", cache_root=None, cache_read=True, cache_write=True, **settings):
        """pandas. Mixed-type values become Python values, structs columns with dotted names."""
        self._options(**settings)
        df = self._frame(start_date, end_date, any_type_strategy, coerce, cache_root, cache_read, cache_write)
        flat, mixed = flatten(df)
        out = flat.toPandas()
        for c in mixed:
            out[c] = [decode_value(v.asDict() if hasattr(v, "asDict") else v) for v in out[c]]
        return out

    def to_arrow(self, start_date=None, end_date=None, coerce="raise", any_type_strategy="float", cache_root=None, cache_read=True, cache_write=True, **settings):
        self._options(**settings)
        return self._frame(start_date, end_date, any_type_strategy, coerce, cache_root, cache_read, cache_write).toArrow()

    def to_polars(self, **options):
        """Needs polars. An empty result keeps its columns."""
        import polars

        return polars.from_arrow(self.to_arrow(**options))

    def __iter__(self) -> Iterator[dict]:
        return self

    def __next__(self) -> dict:
        if self._rows is None:
            self._rows = (r.asDict(recursive=True) for r in self.to_df().toLocalIterator(prefetchPartitions=True))
        return next(self._rows)

    def close(self) -> None:
        self._rows = iter(())

    def __enter__(self) -> Cursor:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def to_list(self, n: int | None = None) -> list[dict]:
        out = []
        while n is None or len(out) < n:
            try:
                out.append(next(self))
            except StopIteration:
                break
        return out

    def to_dataframe_batches(self, batch_size: int = 10_000, start_date=None, end_date=None, coerce="raise", any_type_strategy="keep_struct", cache_root=None, cache_read=True, cache_write=True, **settings) -> Iterator:
        """pandas frames of batch_size rows, in the order of the sort; the driver holds one partition at a time."""
        import pandas as pd

        if batch_size < 1:
            raise ValueError("batch_size is 1 or more")
        self._options(**settings)
        flat, mixed = flatten(self._frame(start_date, end_date, any_type_strategy, coerce, cache_root, cache_read, cache_write))
        rows: list = []

        def made() -> pd.DataFrame:
            out = pd.DataFrame.from_records([tuple(r) for r in rows], columns=flat.columns)
            for c in mixed:
                out[c] = [decode_value(v.asDict() if hasattr(v, "asDict") else v) for v in out[c]]
            return out

        for row in flat.toLocalIterator(prefetchPartitions=True):
            rows.append(row)
            if len(rows) == batch_size:
                yield made()
                rows = []
        if rows:
            yield made()

    def stream_to_callback(self, callback: Callable, *, partition_time_delta: dt.timedelta, partition_by: str | list[str] | None = None, any_type_strategy: str = "float", max_workers: int = 4, start_date=None, end_date=None, coerce: str = "raise", cache_root: str | None = None, cache_read: bool = True, cache_write: bool = True, on_executors: bool = False, **settings) -> dict:
        """Calls callback(arrow_table, metadata) for every time bucket and combination of key values.

        On the driver all rows pass through it, max_workers partitions at once. On the executors the callback is
        pickled, Spark schedules the calls and only counts come to the driver.
        """
        self._options(max_workers=max_workers, **settings)
        schema = self.collection.schema
        if self._skip or self._limit:
            raise ValueError("partitions take the whole result: neither skip nor limit")
        if any(name != schema.time_field for name, _ in self._sort):
            raise ValueError("partitions are sorted by the time field alone")
        keys = [f for n in ([partition_by] if isinstance(partition_by, str) else partition_by or []) for f in schema.expand(n)]
        columns = self.columns()
        if schema.time_field in keys:
            raise ValueError("the time field is partitioned by partition_time_delta, not by partition_by")
        if lost := [k for k in keys if k not in columns]:
            raise ValueError(f"the projection must leave the partition fields, not drop {lost}")
        buckets.seconds_of(partition_time_delta)
        began = time.time()
        df = self._frame(start_date, end_date, any_type_strategy, coerce, cache_root, cache_read, cache_write)
        spent = time.time() - began
        if on_executors:
            found = buckets.call_on_executors(df, callback, schema.time_field, partition_time_delta, keys)
        else:
            found = buckets.call_partitions(df, callback, schema.time_field, partition_time_delta, keys, max_workers)
        return found | {"cache_duration_s": spent, "duration_s": time.time() - began}

    def explain(self, plan: bool = True, max_workers: int = 4, chunking_granularity: dt.timedelta | None = None, row_group_size: int | None = None, flush_ram_limit_mb: int = 512) -> dict:
        """How the query is classified, what the settings come to, and Spark's plan for it.

        workers is how many time chunks could be fetched at once; Spark's own tasks don't depend on it.
        """
        if chunking_granularity is not None and chunking_granularity <= dt.timedelta(0):
            raise ValueError("chunking_granularity must be positive")
        found = classify(self.query, self.collection.schema.time_field, self._sort)
        bounds = found.bounds
        whole = bounds is not None and bounds.bounded and not bounds.empty
        n_chunks = len(chunks(bounds.low, bounds.high, chunking_granularity or dt.timedelta(days=1))) if whole else 0
        out = {
            "filter": self.query,
            "projection": self.projection or None,
            "skip": self._skip,
            "limit": self._limit,
            "sort": self._sort or None,
            "accelerated": found.mode == PARALLEL,
            "is_chunkable": found.mode == PARALLEL,
            "reason": found.reason,
            "mode": found.mode,
            "time_bounds": (bounds.low, bounds.high) if whole else None,
            "estimated_chunks": n_chunks,
            "settings": {"max_workers": max_workers, "workers": min(max_workers, n_chunks) if found.mode == PARALLEL else 1, "chunking_granularity": chunking_granularity, "row_group_size": row_group_size, "flush_ram_limit_mb": flush_ram_limit_mb},
            "branches": len(found.branches),
        }
        if plan and found.mode != REJECT:
            df = self.to_df()
            out["plan"] = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        return out

    explain_acceleration = explain

    def count(self) -> int:
        return self.to_df().count()

    def distinct(self, key: str) -> list:
        return self.collection.distinct(key, self.query)


def flatten(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Struct columns as columns with dotted names, by the schema; mixed-type columns stay and are named."""
    mixed = []

    def parts(column, field: T.StructField, name: str) -> list:
        if K.is_any(field.dataType):
            mixed.append(name)
        elif isinstance(field.dataType, T.StructType):
            return [p for f in field.dataType.fields for p in parts(column[f.name], f, f"{name}.{f.name}")]
        return [column.alias(name)]

    return df.select(*[p for f in df.schema.fields for p in parts(F.col(f"`{f.name}`"), f, f.name)]), mixed
