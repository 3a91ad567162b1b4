"""Time buckets: partitions of a frame by time and keys, and callbacks on them."""

from __future__ import annotations

import datetime as dt
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor, as_completed
from itertools import groupby

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.sources.cache import shared_folder

CHANGED = "its rows changed between two readings"


def seconds_of(delta: dt.timedelta) -> int:
    """Whole seconds; less makes no bucket."""
    seconds = delta.total_seconds()
    if seconds < 1 or seconds != int(seconds):
        raise ValueError("a bucket is one or more whole seconds wide")
    return int(seconds)


def micros(column: Column) -> Column:
    return F.unix_micros(column.cast("timestamp"))


def origin(df: DataFrame, time_field: str) -> int | None:
    """The start of the day of the earliest time, in microseconds; null times don't count."""
    first = df.agg(micros(F.min(F.col(f"`{time_field}`"))).alias("m")).first()["m"]
    return None if first is None else first // 86_400_000_000 * 86_400_000_000


def with_bucket(df: DataFrame, time_field: str, delta: dt.timedelta, name: str = "bucket", start: int | None = None) -> DataFrame:
    """Adds the start of each row's bucket. Buckets count from the first day; a null time has a null bucket."""
    width = seconds_of(delta) * 1_000_000
    start = origin(df, time_field) if start is None else start
    column = F.col(f"`{time_field}`")
    begin = F.expr(f"{start or 0}L") + F.floor((micros(column) - F.lit(start or 0)) / F.lit(width)) * F.lit(width)
    return df.withColumn(name, F.timestamp_micros(begin.cast("long")).cast(df.schema[time_field].dataType))


def partitions(df: DataFrame, time_field: str, delta: dt.timedelta, keys: list[str] = ()) -> DataFrame:
    """bucket, keys, first, last and n of every partition. Null keys are a group; null times have a group of their own."""
    t = F.col(f"`{time_field}`")
    grouped = with_bucket(df, time_field, delta).groupBy("bucket", *[F.col(f"`{k}`") for k in keys])
    return grouped.agg(F.min(t).alias("first"), F.max(t).alias("last"), F.count(F.lit(1)).alias("n"))


def apply_partitions(df: DataFrame, function: Callable, schema: T.StructType | str, time_field: str, delta: dt.timedelta, keys: list[str] = ()) -> DataFrame:
    """Calls function(table) -> table on the executors for every partition; a partition must fit into a task."""
    return with_bucket(df, time_field, delta).groupBy("bucket", *[F.col(f"`{k}`") for k in keys]).applyInArrow(function, schema)


def write_partitioned(df: DataFrame, path: str, time_field: str, delta: dt.timedelta, keys: list[str] = ()) -> None:
    """A Parquet folder per bucket and key; large buckets are split over tasks, not gathered in one."""
    bucketed = with_bucket(df, time_field, delta).withColumn("bucket", F.col("bucket").cast("string"))
    bucketed.hint("rebalance", "bucket").write.partitionBy("bucket", *keys).option("compression", "zstd").parquet(path)


def part_name(bucket: Column, keys: list[Column]) -> Column:
    """A folder's name for a bucket and the values of the keys."""
    told = F.concat_ws(".", F.xxhash64(*[x for k in keys for x in (k.isNull(), k)]), F.xxhash64(F.lit(1), *keys)) if keys else F.lit("all")
    return F.concat_ws("_", micros(bucket), told)


def mark_of(df: DataFrame) -> str:
    """What no column's name begins with."""
    mark = "_"
    while any(c.startswith(mark) for c in df.columns):
        mark += "_"
    return mark


def planned(bucketed: DataFrame, mark: str, keys: list[str], width: dt.timedelta) -> tuple[list[tuple[str, dict]], int]:
    """Name and metadata of every partition in order, and the number of those without a time."""
    bucket, columns = f"{mark}bucket", [F.col(f"`{k}`") for k in keys]
    grouped = bucketed.groupBy(bucket, *columns).agg(F.count(F.lit(1)).alias(f"{mark}n"))
    plan = grouped.withColumn(f"{mark}part", part_name(F.col(bucket), columns)).orderBy(bucket, *columns).collect()
    timed = [r for r in plan if r[bucket] is not None]
    about = [{"time_start": r[bucket], "time_end": r[bucket] + width, "partition_values": {k: r[k] for k in keys}, "row_count": r[f"{mark}n"], "partition_index": i, "total_partitions": len(timed)} for i, r in enumerate(timed)]
    return [(r[f"{mark}part"], m) for r, m in zip(timed, about, strict=True)], len(plan) - len(timed)


def failure(about: dict, reason: object) -> RuntimeError:
    return RuntimeError(f"the callback failed on partition {about['partition_index']} ({about['time_start']} to {about['time_end']}, {about['partition_values']}): {reason}")


def call_partitions(df: DataFrame, callback: Callable, time_field: str, delta: dt.timedelta, keys: list[str], max_workers: int) -> dict:
    """Calls callback(table, metadata) on the driver for every partition, from max_workers threads at most.

    The rows are written once to the shared folder, a folder for each partition, and each call reads its own
    one, so the work does not grow with the number of partitions; the driver holds max_workers of them.
    A failure is raised with the partition's identity. Rows without a time are passed over and counted.
    """
    began, spark = time.time(), df.sparkSession
    path = f"{shared_folder(spark)}/partitions-{uuid.uuid4().hex}"
    width, start = dt.timedelta(seconds=seconds_of(delta)), origin(df, time_field)
    columns, mark = [F.col(f"`{k}`") for k in keys], mark_of(df)
    bucketed = with_bucket(df, time_field, delta, f"{mark}bucket", start)
    named = bucketed.withColumn(f"{mark}part", F.coalesce(part_name(F.col(f"{mark}bucket"), columns), F.lit("none")))
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    try:
        named.hint("rebalance", f"{mark}part").write.partitionBy(f"{mark}part").option("compression", "zstd").parquet(path)
        kept = spark.read.option("recursiveFileLookup", "true").schema(bucketed.schema).parquet(path)
        timed, skipped = planned(kept, mark, keys, width)

        def run(name: str, about: dict) -> None:
            part = spark.read.schema(df.schema).parquet(f"{path}/{mark}part={name}")
            try:
                callback(part.orderBy(F.col(f"`{time_field}`").asc_nulls_last()).toArrow(), dict(about))
            except Exception as e:
                raise failure(about, e) from e

        with ThreadPoolExecutor(max_workers=max_workers) as pool:
            futures = [pool.submit(run, *p) for p in timed]
            try:
                for f in as_completed(futures):
                    f.result()
            except BaseException:
                pool.shutdown(cancel_futures=True)
                raise
    finally:
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return {"total_partitions": len(timed), "total_rows": sum(m["row_count"] for _, m in timed), "skipped_partitions": skipped, "partition_duration_s": time.time() - began}


def call_on_executors(df: DataFrame, callback: Callable, time_field: str, delta: dt.timedelta, keys: list[str]) -> dict:
    """Calls callback(table, metadata) on the executors for every partition; the driver gets a count of each.

    The callback is pickled, so what it changes in the driver's objects is lost. A partition must fit into a task,
    and a task that Spark repeats calls again. A failure doesn't stop the other calls; the first one is raised with
    the partition's identity. Rows without a time are passed over and counted.
    """
    began = time.time()
    width, start = dt.timedelta(seconds=seconds_of(delta)), origin(df, time_field)
    columns, mark = [F.col(f"`{k}`") for k in keys], mark_of(df)
    names, index, place = df.columns, f"{mark}index", f"{mark}place"
    bucketed = with_bucket(df, time_field, delta, f"{mark}bucket", start)
    timed, skipped = planned(bucketed, mark, keys, width)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
        for batch in batches:
            at, ids, rest = 0, batch.column(len(names)), pa.RecordBatch.from_arrays(batch.columns[:-1], names)
            while at < batch.num_rows:
                n = pc.sum(pc.equal(ids, ids[at])).as_py()
                yield ids[at].as_py(), rest.slice(at, n)
                at += n

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, group in groupby(runs(batches), lambda run: run[0]):
            part, reason = pa.Table.from_batches([batch for _, batch in group]), None
            if i < 0 or timed[i][1]["row_count"] != part.num_rows:
                reason = CHANGED
            else:
                try:
                    callback(part, dict(timed[i][1]))
                except Exception as e:
                    reason = f"{type(e).__name__}: {e}"
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([part.num_rows], pa.int64()), pa.array([reason], pa.string())], ["i", "n", "reason"])

    # one number for partition and time, as fine as 63 bits allow, so that rows are seldom compared as a whole
    micros_wide = width // dt.timedelta(microseconds=1)
    step = micros_wide * max(1, len(timed)) // 2**62 + 1
    numbers = F.broadcast(df.sparkSession.createDataFrame([(name, i) for i, (name, _) in enumerate(timed)], f"{mark}part string, {index} long"))
    bucket, when = F.col(f"{mark}bucket"), F.col(f"`{time_field}`")
    named = bucketed.where(bucket.isNotNull()).withColumn(f"{mark}part", part_name(bucket, columns)).join(numbers, f"{mark}part", "left")
    numbered = named.withColumn(index, F.coalesce(index, F.lit(-1))).withColumn(f"{mark}time", micros(when) - micros(bucket))
    placed = numbered.withColumn(place, F.expr(f"{index} * {micros_wide // step + 1}L + {mark}time div {step}L"))
    narrow = placed.drop(f"{mark}bucket", f"{mark}part", f"{mark}time")
    in_order = narrow.repartition(index).sortWithinPartitions(place, *([] if step == 1 else [when])).select(*[F.col(f"`{c}`") for c in names], index)
    called = in_order.toDF(*map(str, range(len(names) + 1))).mapInArrow(call, "i long, n long, reason string").collect()
    for r in sorted(called):
        if r["reason"] is not None:
            raise failure(timed[r["i"]][1], r["reason"]) if r["i"] >= 0 else RuntimeError(CHANGED)
    if len(called) != len(timed):
        raise RuntimeError(f"{len(called)} of {len(timed)} partitions were called: {CHANGED}")
    return {"total_partitions": len(called), "total_rows": sum(r["n"] for r in called), "skipped_partitions": skipped, "partition_duration_s": time.time() - began}
