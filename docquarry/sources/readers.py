"""Where collections come from. All readers are lazy scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docquarry.schema import Schema


def read_parquet(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.parquet(*([path] if isinstance(path, str) else path))


def read_json(spark: SparkSession, path: str | list[str], schema: Schema, strict: bool = True) -> DataFrame:
    """Line-wise JSON documents in the types of a schema; dotted fields come from nested documents.

    A value that does not fit fails the job if strict, else it becomes null.
    """
    nested: dict = {}
    for field in schema.to_struct().fields:
        at = nested
        *parents, last = field.name.split(".")
        for p in parents:
            at = at.setdefault(p, {})
        at[last] = field.dataType

    def struct(tree: dict):
        from pyspark.sql import types as T

        return T.StructType([T.StructField(n, struct(t) if isinstance(t, dict) else t) for n, t in tree.items()])

    reader = spark.read.schema(struct(nested)).option("mode", "FAILFAST" if strict else "PERMISSIVE").option("timeZone", "UTC")
    return schema.apply(reader.json(path), strict)


def read_mongo(spark: SparkSession, uri: str, database: str, collection: str, schema: Schema) -> DataFrame:
    """A live collection through the store's public Spark connector, which must be on the class path."""
    reader = spark.read.format("mongodb").option("connection.uri", uri).option("database", database).option("collection", collection)
    return schema.apply(reader.load())
