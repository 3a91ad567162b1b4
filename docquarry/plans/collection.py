"""Collections: a frame with a schema, queried by documents."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.filters.compile import where
from docquarry.plans.aggregate import aggregate
from docquarry.plans.cursor import Cursor
from docquarry.schema import Schema
from docquarry.sources import readers

#: Methods of document stores that change data or follow it.
UNSUPPORTED = frozenset("insert_one insert_many update_one update_many replace_one delete_one delete_many find_one_and_update find_one_and_replace find_one_and_delete bulk_write create_index create_indexes drop_index drop_indexes list_indexes index_information watch drop rename".split())


class Collection:
    def __init__(self, df: DataFrame, schema: Schema | None = None, time_field: str | None = None, name: str = "collection", database: str = "default", source: str | None = None):
        if schema is None and time_field is None:
            raise ValueError("a collection needs a schema, or a time field for the schema of its columns")
        self.df, self.spark, self.name, self.database = df, df.sparkSession, name, database
        self.source = source  # what kept results are known by; a frame has no such name unless it is given
        self._schema = schema or Schema.of(df, time_field)

    @classmethod
    def from_parquet(cls, spark: SparkSession, path: str, time_field: str | None = None, schema: Schema | None = None, **names) -> Collection:
        return cls(readers.read_parquet(spark, path), schema, time_field, source=f"parquet:{path}", **names)

    @classmethod
    def from_json(cls, spark: SparkSession, path: str, schema: Schema, **names) -> Collection:
        return cls(readers.read_json(spark, path, schema), schema, source=f"json:{path}", **names)

    @classmethod
    def from_mongo(cls, spark: SparkSession, uri, database: str, name: str, schema: Schema) -> Collection:
        """uri may be a function that gives it."""
        uri = uri() if callable(uri) else uri
        source = f"store:{hashlib.sha256(uri.encode()).hexdigest()}:{database}.{name}"
        return cls(readers.read_mongo(spark, uri, database, name, schema), schema, name=name, database=database, source=source)

    @property
    def full_name(self) -> str:
        return f"{self.database}.{self.name}"

    @property
    def schema(self) -> Schema:
        return self._schema

    def get_schema(self) -> Schema:
        return self._schema

    def set_schema(self, schema: Schema) -> None:
        self._schema = schema

    def raw_collection(self) -> DataFrame:
        return self.df

    def frame(self, strict: bool = True) -> DataFrame:
        """The schema's columns; the frame as it is if it has just these."""
        wanted = self._schema.to_struct()
        same = [(f.name, f.dataType) for f in self.df.schema.fields] == [(f.name, f.dataType) for f in wanted.fields]
        return self.df if same else self._schema.apply(self.df, strict)

    def find(self, filter: Mapping | None = None, projection: Mapping | list | None = None, skip: int = 0, limit: int = 0, sort: object = None, batch_size: int = 1000) -> Cursor:
        return Cursor(self, filter, projection, skip, limit, sort, batch_size)

    def find_one(self, filter: Mapping | None = None, projection: Mapping | list | None = None, sort: object = None) -> dict | None:
        return next(iter(self.find(filter, projection, limit=1, sort=sort)), None)

    def count_documents(self, filter: Mapping) -> int:
        return where(self.frame(), filter).count()

    def estimated_document_count(self) -> int:
        return self.df.count()

    def distinct_df(self, key: str, filter: Mapping | None = None) -> DataFrame:
        """Different values of a field, those of arrays one by one; nulls are no values."""
        df = where(self.frame(), filter).select(F.col(f"`{key}`").alias(key))
        if isinstance(df.schema[key].dataType, T.ArrayType):
            df = df.select(F.explode(F.col(f"`{key}`")).alias(key))
        return df.where(F.col(f"`{key}`").isNotNull()).distinct()

    def distinct(self, key: str, filter: Mapping | None = None) -> list:
        return [r[0] for r in self.distinct_df(key, filter).collect()]

    def aggregate(self, pipeline: list[Mapping], tables: Mapping[str, DataFrame] | None = None) -> DataFrame:
        return aggregate(self.frame(), pipeline, tables)

    def __getattr__(self, name: str):
        if name in UNSUPPORTED:
            raise NotImplementedError(f"{name} changes or follows a store; collections here are read")
        raise AttributeError(name)


def accelerate(df: DataFrame, schema: Schema, name: str = "collection", approx_document_size_bytes: int = 500) -> Collection:
    """A collection of a frame."""
    schema.avg_doc_size_bytes = approx_document_size_bytes
    return Collection(df, schema, name=name)
