"""Registered queries of the document-query engine and their SQL."""

from __future__ import annotations

import datetime as dt
import re
import uuid
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docquarry.functions.mixed import mixed_case
from docquarry.operators import buckets
from docquarry.operators.ordering import normalise, orders
from docquarry.plans.collection import Collection
from docquarry.plans.surface import SURFACE
from docquarry.sources.cache import shared_folder

UTC = dt.UTC
LOW, HIGH = dt.datetime(2024, 1, 5, tzinfo=UTC), dt.datetime(2024, 1, 15, tzinfo=UTC)
SPAN = "ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-15'"

TIME = {"events": "ts", "orders": "o_orderdate", "lineitem": "l_shipdate"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def collection(spark: SparkSession, sf_dir: str, name: str) -> Collection:
    return Collection.from_parquet(spark, f"{sf_dir}/{name}.parquet", TIME[name], name=name)


def nullable(spark: SparkSession, sf_dir: str) -> Collection:
    """Events with nulls in event_type."""
    df = table(spark, sf_dir, "events").withColumn("event_type", F.when(F.col("event_id") % 7 != 0, F.col("event_type")))
    return Collection(df, time_field="ts", name="events")


NULLABLE = "(SELECT event_id, ts, user_id, CASE WHEN event_id % 7 <> 0 THEN event_type END AS event_type, value, props FROM events)"


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").withColumn("words", F.split("p_name", " "))


def matching(df: DataFrame, query: dict) -> DataFrame:
    from docquarry.filters.compile import where

    return where(df, query)


def find(query: dict, name: str = "events", columns: tuple = ("event_id",), nulls: bool = False) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = nullable(spark, sf_dir) if nulls else collection(spark, sf_dir, name)
        return c.find(query).to_df().select(*columns)

    return run


def event_sql(condition: str, nulls: bool = False) -> str:
    return f"SELECT event_id FROM {NULLABLE if nulls else 'events'} WHERE {condition}"


def mixed(df: DataFrame) -> DataFrame:
    """Events with a mixed-type column v: number, whole number (of 64 bits, if 32 are too few), string, bool or null by event_id."""
    k, short = F.col("event_id") % 5, F.col("user_id").try_cast("int")
    whole = ((k == 1) & short.isNotNull(), short, T.IntegerType()), (k == 1, F.col("user_id"), T.LongType())
    v = mixed_case((k == 0, F.col("value"), T.DoubleType()), *whole, (k == 2, F.col("event_type"), T.StringType()), (k == 3, F.col("value") > 10, T.BooleanType()))
    return df.withColumn("v", v)


MIXED = "(SELECT *, event_id % 5 AS k, value > 10 AS big FROM events)"


def position(df: DataFrame, order: list) -> DataFrame:
    """The place of each row in an order: ranges of it are numbered in a task each, after the rows of the ranges before.

    The ranges are written to the shared folder, as their ends come from samples; the driver gets a count for each.
    """
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/ranges-{uuid.uuid4().hex}"
    df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    ranges = spark.read.parquet(path)
    starts, before = [], 0
    for r in ranges.groupBy("_part").count().orderBy("_part").collect():
        starts.append((r["_part"], before))
        before += r["count"]
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    numbered = ranges.join(F.broadcast(spark.createDataFrame(starts, "_part int, _before long")), "_part")
    return numbered.withColumn("position", F.col("_before") + within)


def sorted_events(sort: object, nulls: bool = False) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = nullable(spark, sf_dir) if nulls else collection(spark, sf_dir, "events")
        return position(c.frame(), orders(normalise(sort), c.schema)).select("event_id", "position")

    return run


def any_sort(way: int) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = Collection(mixed(table(spark, sf_dir, "events")), time_field="ts")
        return position(c.frame(), orders([("v", way), ("event_id", 1)], c.schema)).select("event_id", "position")

    return run


def any_sort_sql(way: str) -> str:
    rank = "CASE k WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 7 ELSE 0 END"
    number = "CASE k WHEN 0 THEN value WHEN 1 THEN user_id::DOUBLE END"
    return f"SELECT event_id, row_number() OVER (ORDER BY {rank} {way}, {number} {way} NULLS LAST, CASE k WHEN 2 THEN event_type END {way} NULLS LAST, CASE k WHEN 3 THEN big END {way} NULLS LAST, event_id) AS position FROM {MIXED}"


def any_decode(strategy: str) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = Collection(mixed(table(spark, sf_dir, "events")), time_field="ts")
        return c.find({}).to_df(any_type_strategy=strategy).select("event_id", "v")

    return run


def any_filter(query: dict) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return matching(mixed(table(spark, sf_dir, "events")), query).select("event_id")

    return run


def bucketed(delta: dt.timedelta, nulls: bool = False) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = nullable(spark, sf_dir) if nulls else collection(spark, sf_dir, "events")
        return buckets.partitions(c.frame(), "ts", delta, ["event_type"]).select("bucket", "event_type", F.col("first").alias("first_ts"), F.col("last").alias("last_ts"), "n")

    return run


def bucket_sql(width: str, nulls: bool = False) -> str:
    source = NULLABLE if nulls else "events"
    return f"SELECT time_bucket(INTERVAL '{width}', ts, (SELECT date_trunc('day', min(ts)) FROM events)) AS bucket, event_type, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM {source} GROUP BY ALL"


def callback_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and values of each bucket and type, by a function that runs on the executors."""

    def count(part: pa.Table) -> pa.Table:
        cents = pc.sum(pc.cast(pc.round(pc.multiply(part["value"], 100.0), round_mode="half_to_even"), pa.int64())).as_py()
        return pa.table({"bucket": part["bucket"].slice(0, 1), "event_type": part["event_type"].slice(0, 1), "n": pa.array([part.num_rows], pa.int64()), "cents": pa.array([cents], pa.int64())})

    events = table(spark, sf_dir, "events").select("ts", "event_type", "value")
    return buckets.apply_partitions(events, count, "bucket timestamp_ntz, event_type string, n long, cents long", "ts", dt.timedelta(days=7), ["event_type"])


def round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = f"{shared_folder(spark)}/results"
    return collection(spark, sf_dir, "events").find({"event_type": "view", "value": {"$lt": 20}}, {"ts": 1, "event_id": 1, "value": 1}).cached(root, cache_read=False).select("event_id", "ts", "value")


def json_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").withColumn("props", F.from_json("props", "k bigint"))
    return matching(df, {"props.k": {"$gte": 5}}).select("event_id")


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching(table(spark, sf_dir, "embeddings"), {"embedding": {"$elemMatch": {"$gt": 0.25, "$lt": 0.3}}}).select("vec_id")


def struct_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.array(F.struct(F.col("event_type").alias("kind"), F.col("value").alias("x")), F.struct(F.lit("fixed").alias("kind"), (F.col("value") * 2).alias("x")))
    df = table(spark, sf_dir, "events").withColumn("items", made)
    return matching(df, {"items": {"$elemMatch": {"kind": "fixed", "x": {"$gt": 60}}}, "items.kind": "click"}).select("event_id")


def within_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").withColumn("at", F.array("value", (F.col("user_id") % 100).cast("double")))
    return matching(df, {"at": {"$geoWithin": {"$center": [[30, 40], 25]}}}).select("event_id")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = [{"$match": {"event_type": {"$ne": "error"}}}, {"$group": {"_id": "$event_type", "n": {"$sum": 1}, "users": {"$addToSet": "$user_id"}, "most": {"$max": "$value"}}}, {"$addFields": {"n_users": {"$size": "$users"}}}, {"$project": {"_id": 0, "event_type": "$_id", "n": 1, "n_users": 1, "most": 1}}]
    return collection(spark, sf_dir, "events").aggregate(stages).select("event_type", F.col("n").cast("long").alias("n"), F.col("n_users").cast("long").alias("n_users"), "most")


def joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = [{"$match": {"o_orderstatus": "F"}}, {"$lookup": {"from": "lineitem", "localField": "o_orderkey", "foreignField": "l_orderkey", "as": "lines"}}, {"$addFields": {"n_lines": {"$size": "$lines"}}}, {"$project": {"o_orderkey": 1, "n_lines": 1}}]
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return collection(spark, sf_dir, "orders").aggregate(stages, {"lineitem": lines}).select("o_orderkey", F.col("n_lines").cast("long").alias("n_lines"))


def exact_times(query: Callable) -> Callable:
    """A query of times that are stored: those of the first events."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        times = [r["ts"] for r in table(spark, sf_dir, "events").where("event_id < 4").select("ts").orderBy("event_id").collect()]
        return collection(spark, sf_dir, "events").find({"ts": query(times)}).to_df().select("event_id")

    return run


STORED = "(SELECT ts FROM events WHERE event_id = {})"
IN_RANGE = {"ts": {"$gte": LOW, "$lt": HIGH}, "event_type": {"$in": ["click", "view"]}}

#: name: (query, SQL)
CATALOGUE: dict[str, tuple[Callable, str]] = {
    "f_in_range": (lambda s, d: collection(s, d, "events").find(IN_RANGE, {"ts": 1, "event_type": 1, "value": 1}).sort("ts", 1).to_df(), f"SELECT ts, event_type, value FROM events WHERE {SPAN} AND event_type IN ('click', 'view')"),
    "f_eq": (find({"event_type": {"$eq": "click"}}), event_sql("event_type = 'click'")),
    "f_eq_implicit": (find({"event_type": "click"}), event_sql("event_type = 'click'")),
    "f_ne_null": (find({"event_type": {"$ne": "click"}}, nulls=True), event_sql("event_type IS DISTINCT FROM 'click'", True)),
    "f_eq_null": (find({"event_type": None}, nulls=True), event_sql("event_type IS NULL", True)),
    "f_gt": (find({"value": {"$gt": 12.5}}), event_sql("value > 12.5")),
    "f_gte": (find({"user_id": {"$gte": 100}}), event_sql("user_id >= 100")),
    "f_lt": (find({"value": {"$lt": 5}}), event_sql("value < 5")),
    "f_lte": (find({"user_id": {"$lte": 7}}), event_sql("user_id <= 7")),
    "f_range": (find({"value": {"$gt": 2, "$lte": 30}, "user_id": {"$gte": 3, "$lt": 90}}), event_sql("value > 2 AND value <= 30 AND user_id >= 3 AND user_id < 90")),
    "f_in": (find({"event_type": {"$in": ["click", "error"]}}), event_sql("event_type IN ('click', 'error')")),
    "f_in_null": (find({"event_type": {"$in": ["click", None]}}, nulls=True), event_sql("event_type = 'click' OR event_type IS NULL", True)),
    "f_in_regex": (find({"event_type": {"$in": [re.compile("^s"), "view"]}}), event_sql("event_type LIKE 's%' OR event_type = 'view'")),
    "f_nin_null": (find({"event_type": {"$nin": ["click", "view"]}}, nulls=True), event_sql("event_type IS NULL OR event_type NOT IN ('click', 'view')", True)),
    "f_exists_true": (find({"event_type": {"$exists": True}}, nulls=True), event_sql("event_type IS NOT NULL", True)),
    "f_exists_false": (find({"event_type": {"$exists": False}}, nulls=True), event_sql("event_type IS NULL", True)),
    "f_type_number": (find({"value": {"$type": "number"}, "event_type": {"$type": 2}}, nulls=True), event_sql("event_type IS NOT NULL", True)),
    "f_type_bracket": (find({"$or": [{"value": {"$gt": "x"}}, {"event_type": {"$lt": 5}}, {"event_id": 3}]}), event_sql("event_id = 3")),
    "f_all": (lambda s, d: matching(words(s, d), {"words": {"$all": ["hot", "plate"]}}).select("p_partkey"), "SELECT p_partkey FROM part WHERE list_has_all(string_split(p_name, ' '), ['hot', 'plate'])"),
    "f_array_eq": (lambda s, d: matching(words(s, d), {"words": {"$nin": ["red", "hot"]}}).select("p_partkey"), "SELECT p_partkey FROM part WHERE NOT list_has_any(string_split(p_name, ' '), ['red', 'hot'])"),
    "f_size": (lambda s, d: matching(table(s, d, "pages").withColumn("parts", F.split("url", "/")), {"parts": {"$size": 5}}).select("page_id"), "SELECT page_id FROM pages WHERE len(string_split(url, '/')) = 5"),
    "f_elem_match": (elements, "SELECT vec_id FROM embeddings WHERE len(list_filter(embedding, lambda x: x > 0.25 AND x < 0.3)) > 0"),
    "f_elem_match_struct": (struct_elements, event_sql("value * 2 > 60 AND event_type = 'click'")),
    "f_bits_all_set": (find({"user_id": {"$bitsAllSet": [0, 2]}}), event_sql("user_id & 5 = 5")),
    "f_bits_all_clear": (find({"user_id": {"$bitsAllClear": 6}}), event_sql("user_id & 6 = 0")),
    "f_bits_any_set": (find({"user_id": {"$bitsAnySet": 9}}), event_sql("user_id & 9 <> 0")),
    "f_bits_any_clear": (find({"user_id": {"$bitsAnyClear": [1, 4]}}), event_sql("user_id & 18 <> 18")),
    "f_regex": (lambda s, d: matching(table(s, d, "part"), {"p_name": {"$regex": "e.*t$"}}).select("p_partkey"), "SELECT p_partkey FROM part WHERE regexp_matches(p_name, 'e.*t$')"),
    "f_regex_i": (lambda s, d: matching(table(s, d, "part"), {"p_name": {"$regex": "^R", "$options": "i"}}).select("p_partkey"), "SELECT p_partkey FROM part WHERE regexp_matches(p_name, '^R', 'i')"),
    "f_mod": (find({"user_id": {"$mod": [3, 1]}}), event_sql("user_id % 3 = 1")),
    "f_json_schema": (find({"$jsonSchema": {"required": ["event_type"], "properties": {"value": {"bsonType": "double", "minimum": 3, "maximum": 40}, "event_type": {"enum": ["click", "view", "error"]}}}}, nulls=True), event_sql("event_type IN ('click', 'view', 'error') AND value >= 3 AND value <= 40", True)),
    "f_comment": (find({"$comment": "a note", "event_type": "signup"}), event_sql("event_type = 'signup'")),
    "f_and_dupkey": (find({"$and": [{"value": {"$gt": 1}}, {"value": {"$lt": 5}}]}), event_sql("value > 1 AND value < 5")),
    "f_two_or": (find({"$and": [{"$or": [{"value": {"$lt": 3}}, {"value": {"$gt": 40}}]}, {"$or": [{"event_type": "click"}, {"user_id": 5}]}]}), event_sql("(value < 3 OR value > 40) AND (event_type = 'click' OR user_id = 5)")),
    "f_or_global_time": (find({"ts": {"$gte": LOW, "$lt": HIGH}, "$or": [{"ts": {"$gte": dt.datetime(2024, 1, 1)}, "event_type": "click"}, {"user_id": 9}]}), event_sql(f"{SPAN} AND (event_type = 'click' OR user_id = 9)")),
    "f_or_overlap": (find({"$or": [{"value": {"$gt": 10}}, {"value": {"$lt": 20}}]}), event_sql("value > 10 OR value < 20")),
    "f_or_nested": (find({"$or": [{"$or": [{"user_id": 1}, {"user_id": 2}]}, {"event_type": "error", "value": {"$gt": 20}}]}), event_sql("user_id IN (1, 2) OR (event_type = 'error' AND value > 20)")),
    "f_nor": (find({"$nor": [{"event_type": "click"}, {"value": {"$gt": 10}}]}, nulls=True), event_sql("NOT (coalesce(event_type = 'click', false) OR value > 10)", True)),
    "f_not": (find({"event_type": {"$not": {"$in": ["click", "view"]}}}, nulls=True), event_sql("NOT coalesce(event_type IN ('click', 'view'), false)", True)),
    "f_not_regex": (find({"event_type": {"$not": re.compile("^(c|v)")}}, nulls=True), event_sql("NOT coalesce(regexp_matches(event_type, '^(c|v)'), false)", True)),
    "f_time_gt": (exact_times(lambda t: {"$gt": t[1]}), event_sql(f"ts > {STORED.format(1)}")),
    "f_time_eq": (exact_times(lambda t: t[2]), event_sql(f"ts = {STORED.format(2)}")),
    "f_time_in": (exact_times(lambda t: {"$in": [t[0], t[3]]}), event_sql(f"ts IN ({STORED.format(0)}, {STORED.format(3)})")),
    "f_time_lte": (exact_times(lambda t: {"$lte": t[0]}), event_sql(f"ts <= {STORED.format(0)}")),
    "f_expr": (find({"$expr": {"$gt": [{"$multiply": ["$value", 2]}, {"$add": ["$user_id", 3]}]}}), event_sql("value * 2 > user_id + 3")),
    "f_geo_within": (within_center, event_sql("(value - 30) * (value - 30) + (user_id % 100 - 40) * (user_id % 100 - 40) <= 625")),
    "p_include": (lambda s, d: collection(s, d, "events").find({"user_id": {"$lt": 20}}, {"ts": 1, "value": 1}).to_df(), "SELECT ts, value FROM events WHERE user_id < 20"),
    "p_exclude": (lambda s, d: collection(s, d, "events").find({"user_id": {"$lt": 20}}, {"props": 0, "_id": 0, "value": 0}).to_df(), "SELECT event_id, ts, user_id, event_type FROM events WHERE user_id < 20"),
    "s_multi": (sorted_events([("event_type", -1), ("value", 1), ("event_id", 1)]), "SELECT event_id, row_number() OVER (ORDER BY event_type DESC, value, event_id) AS position FROM events"),
    "s_null_last": (sorted_events([("event_type", 1), ("event_id", -1)], True), f"SELECT event_id, row_number() OVER (ORDER BY event_type NULLS LAST, event_id DESC) AS position FROM {NULLABLE}"),
    "s_null_last_desc": (sorted_events([("event_type", -1), ("event_id", 1)], True), f"SELECT event_id, row_number() OVER (ORDER BY event_type DESC NULLS LAST, event_id) AS position FROM {NULLABLE}"),
    "l_topk": (lambda s, d: collection(s, d, "events").find({"event_type": "view"}).sort([("ts", -1), ("event_id", 1)]).limit(25).to_df(), "SELECT event_id, ts, user_id, event_type, value, props FROM events WHERE event_type = 'view' ORDER BY ts DESC, event_id LIMIT 25"),
    "l_skip_limit": (lambda s, d: collection(s, d, "events").find({}, skip=40, limit=15, sort=[("ts", 1), ("event_id", 1)]).to_df(), "SELECT event_id, ts, user_id, event_type, value, props FROM events ORDER BY ts, event_id LIMIT 15 OFFSET 40"),
    "any_float": (any_decode("float"), f"SELECT event_id, CASE k WHEN 0 THEN value WHEN 1 THEN user_id::DOUBLE WHEN 3 THEN big::INT::DOUBLE END AS v FROM {MIXED}"),
    "any_string": (any_decode("string"), f"SELECT event_id, CASE k WHEN 0 THEN value::VARCHAR WHEN 1 THEN user_id::VARCHAR WHEN 2 THEN event_type WHEN 3 THEN big::VARCHAR END AS v FROM {MIXED}"),
    "any_sort": (any_sort(1), any_sort_sql("ASC")),
    "any_sort_desc": (any_sort(-1), any_sort_sql("DESC")),
    "any_filter": (any_filter({"v": {"$gte": 20}}), f"SELECT event_id FROM {MIXED} WHERE (k = 0 AND value >= 20) OR (k = 1 AND user_id >= 20)"),
    "any_type": (any_filter({"v": {"$type": ["string", "bool"]}}), f"SELECT event_id FROM {MIXED} WHERE k IN (2, 3)"),
    "any_ne": (any_filter({"v": {"$nin": ["click", None]}}), f"SELECT event_id FROM {MIXED} WHERE k <> 4 AND NOT (k = 2 AND event_type = 'click')"),
    "t_bucket_day": (bucketed(dt.timedelta(days=1)), bucket_sql("1 day")),
    "t_bucket_week": (bucketed(dt.timedelta(days=7)), bucket_sql("7 days")),
    "t_bucket_8h": (bucketed(dt.timedelta(hours=8)), bucket_sql("8 hours")),
    "t_bucket_null_key": (bucketed(dt.timedelta(days=7), True), bucket_sql("7 days", True)),
    "d_slice": (lambda s, d: collection(s, d, "events").find({"event_type": "click"}).to_df(start_date=LOW, end_date="2024-01-15T00:00:00Z").select("event_id"), event_sql(f"event_type = 'click' AND {SPAN}")),
    "c_roundtrip": (round_trip, "SELECT event_id, ts, value FROM events WHERE event_type = 'view' AND value < 20"),
    "cb_counts": (callback_counts, "SELECT time_bucket(INTERVAL '7 days', ts, (SELECT date_trunc('day', min(ts)) FROM events)) AS bucket, event_type, count(*) AS n, sum(round_even(value * 100, 0)::BIGINT)::BIGINT AS cents FROM events GROUP BY ALL"),
    "n_json_path": (json_path, event_sql("CAST(json_extract_string(props, '$.k') AS BIGINT) >= 5")),
    "m_count": (lambda s, d: collection(s, d, "events").aggregate([{"$match": {"value": {"$gt": 10}}}, {"$count": "n"}]), "SELECT count(*) AS n FROM events WHERE value > 10"),
    "m_distinct": (lambda s, d: collection(s, d, "events").distinct_df("user_id", {"event_type": "signup"}), "SELECT DISTINCT user_id FROM events WHERE event_type = 'signup'"),
    "m_distinct_array": (lambda s, d: Collection(words(s, d).withColumn("t", F.lit(LOW)), time_field="t").distinct_df("words"), "SELECT DISTINCT unnest(string_split(p_name, ' ')) AS words FROM part"),
    "m_aggregate": (pipeline, "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users, max(value) AS most FROM events WHERE event_type <> 'error' GROUP BY event_type"),
    "m_lookup": (joined, "SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n_lines FROM orders WHERE o_orderstatus = 'F'"),
    "o_range": (find({"o_orderdate": {"$gte": dt.datetime(1995, 1, 1), "$lt": dt.datetime(1997, 1, 1)}, "o_orderpriority": {"$nin": ["1-URGENT"]}}, "orders", ("o_orderkey", "o_totalprice")), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' AND o_orderpriority <> '1-URGENT'"),
    "o_topk": (lambda s, d: collection(s, d, "orders").find({"o_orderstatus": "O"}, sort=[("o_totalprice", -1), ("o_orderkey", 1)], limit=50).to_df().select("o_orderkey", "o_totalprice"), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 50"),
    "li_filter": (find({"l_quantity": {"$gte": 10, "$lt": 30}, "l_returnflag": {"$in": ["A", "R"]}, "l_discount": {"$ne": 0.05}}, "lineitem", ("l_orderkey", "l_linenumber", "l_extendedprice")), "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 30 AND l_returnflag IN ('A', 'R') AND l_discount <> 0.05::DOUBLE"),
    "li_group": (lambda s, d: collection(s, d, "lineitem").aggregate([{"$match": {"l_linestatus": "O"}}, {"$group": {"_id": {"flag": "$l_returnflag", "line": "$l_linenumber"}, "n": {"$count": {}}, "most": {"$max": "$l_extendedprice"}}}]), "SELECT l_returnflag AS flag, l_linenumber AS line, count(*) AS n, max(l_extendedprice) AS most FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL"),
}


CATALOGUE |= SURFACE


def queries() -> dict[str, Callable]:
    return {name: run for name, (run, _) in CATALOGUE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in CATALOGUE.items()}
