"""The same filters and buckets over streams."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docquarry.filters.compile import where
from docquarry.operators.buckets import seconds_of


def bucket_counts(stream: DataFrame, time_field: str, delta: dt.timedelta, keys: list[str] = (), late: dt.timedelta = dt.timedelta(0), query: Mapping | None = None) -> DataFrame:
    """bucket, keys, first, last and n of a stream; rows later than the watermark are dropped. Buckets count from the epoch."""
    zoned = where(stream, query).withColumn("_at", F.col(f"`{time_field}`").cast("timestamp")).withWatermark("_at", f"{int(late.total_seconds())} seconds")
    grouped = zoned.groupBy(F.window("_at", f"{seconds_of(delta)} seconds").alias("w"), *[F.col(f"`{k}`") for k in keys])
    counted = grouped.agg(F.min("_at").alias("first"), F.max("_at").alias("last"), F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("bucket"), *[F.col(f"`{k}`") for k in keys], "first", "last", "n")


def append_to(stream: DataFrame, path: str, checkpoint: str, query: Mapping | None = None, trigger: Mapping | None = None) -> StreamingQuery:
    """Writes the matching rows of a stream to a Parquet folder, once each."""
    return where(stream, query).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
