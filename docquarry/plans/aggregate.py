"""Aggregation pipelines as chains of DataFrame operators."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.filters.compile import Compiler, where
from docquarry.filters.expressions import compile_expression
from docquarry.filters.tree import InvalidQuery, UnsupportedOperator
from docquarry.operators.ordering import normalise

ACCUMULATORS = {"$sum": F.sum, "$avg": F.avg, "$min": F.min, "$max": F.max, "$addToSet": F.collect_set, "$push": F.collect_list, "$first": F.first, "$last": F.last, "$stdDevSamp": F.stddev_samp, "$stdDevPop": F.stddev_pop}


def aggregate(df: DataFrame, pipeline: list[Mapping], tables: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """df after every stage; tables are the frames that $lookup and $unionWith name."""
    for stage in pipeline:
        if len(stage) != 1:
            raise InvalidQuery(f"a stage has one operator: {list(stage)}")
        op, value = next(iter(stage.items()))
        if op not in STAGES:
            raise UnsupportedOperator(f"unknown stage {op}")
        df = STAGES[op](df, value, tables or {})
    return df


def column(df: DataFrame, expression: object):
    """An expression; a path alone gives the field as it is."""
    compiler = Compiler(df.schema)
    if isinstance(expression, str) and expression.startswith("$") and (found := compiler.resolve(expression[1:])) and not found[2]:
        return found[0]
    return compile_expression(expression, compiler).column


def included(df: DataFrame, name: str):
    """A field that a projection names; null if there is none."""
    return F.col(f"`{name}`") if name in df.columns else F.lit(None)


def project(df: DataFrame, value: Mapping, tables) -> DataFrame:
    drops = [n for n, v in value.items() if v in (0, False) and n != "_id"]
    if drops and len(drops) == len([n for n in value if n != "_id"]):
        return df.drop(*drops)
    return df.select(*[(included(df, n) if v in (1, True) and not isinstance(v, float) else column(df, v)).alias(n) for n, v in value.items() if not (n == "_id" and v in (0, False))])


def add_fields(df: DataFrame, value: Mapping, tables) -> DataFrame:
    return df.withColumns({n: column(df, v) for n, v in value.items()})


def group(df: DataFrame, value: Mapping, tables) -> DataFrame:
    by = value["_id"]
    keys = {"_id": by} if not isinstance(by, Mapping) or any(k.startswith("$") for k in by) else by
    made = []
    for name, how in value.items():
        if name == "_id":
            continue
        op, operand = next(iter(how.items()))
        if op == "$count":
            made.append(F.count(F.lit(1)).alias(name))
        elif op in ACCUMULATORS:
            made.append(ACCUMULATORS[op](column(df, operand)).alias(name))
        else:
            raise UnsupportedOperator(f"unknown accumulator {op}")
    return df.groupBy(*[column(df, e).alias(n) for n, e in keys.items()]).agg(*made) if made else df.select(*[column(df, e).alias(n) for n, e in keys.items()]).distinct()


def sort(df: DataFrame, value: Mapping, tables) -> DataFrame:
    return df.orderBy(*[F.col(f"`{n}`").asc_nulls_last() if way == 1 else F.col(f"`{n}`").desc_nulls_last() for n, way in normalise(dict(value))])


def unwind(df: DataFrame, value: object, tables) -> DataFrame:
    rules = {"path": value} if isinstance(value, str) else value
    name = rules["path"].lstrip("$")
    explode = F.explode_outer if rules.get("preserveNullAndEmptyArrays") else F.explode
    return df.withColumn(name, explode(F.col(f"`{name}`"))) if isinstance(df.schema[name].dataType, T.ArrayType) else df


def lookup(df: DataFrame, value: Mapping, tables) -> DataFrame:
    """Matches are gathered by key before the join, so rows of df are never repeated."""
    other = tables[value["from"]]
    key, name = value["foreignField"], value["as"]
    lists = other.groupBy(F.col(f"`{key}`").alias("_key")).agg(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in other.columns])).alias(name))
    joined = df.join(lists, F.col(f"`{value['localField']}`").eqNullSafe(F.col("_key")), "left").drop("_key")
    return joined.withColumn(name, F.coalesce(F.col(name), F.array().cast(lists.schema[name].dataType)))


def bucket(df: DataFrame, value: Mapping, tables) -> DataFrame:
    by, ends = column(df, value["groupBy"]), value["boundaries"]
    at = None
    for low, high in zip(ends, ends[1:], strict=False):
        inside = (by >= low) & (by < high)
        at = F.when(inside, F.lit(low)) if at is None else at.when(inside, F.lit(low))
    at = at.otherwise(F.lit(value["default"])) if "default" in value else at
    made = df.withColumn("_id", at)
    return group(made if "default" in value else made.where("_id is not null"), {"_id": "$_id", **value.get("output", {"count": {"$count": {}}})}, tables)


STAGES = {
    "$match": lambda df, v, t: where(df, v),
    "$project": project,
    "$addFields": add_fields,
    "$set": add_fields,
    "$group": group,
    "$sort": sort,
    "$limit": lambda df, v, t: df.limit(v),
    "$skip": lambda df, v, t: df.offset(v),
    "$unwind": unwind,
    "$count": lambda df, v, t: df.agg(F.count(F.lit(1)).alias(v)),
    "$lookup": lookup,
    "$unionWith": lambda df, v, t: df.unionByName(t[v if isinstance(v, str) else v["coll"]], allowMissingColumns=True),
    "$bucket": bucket,
    "$sample": lambda df, v, t: df.orderBy(F.rand()).limit(v["size"]),
}
