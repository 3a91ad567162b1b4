"""Registered queries of the engine's surface: reading, caching, callbacks, classification, areas and expressions."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry import types as K
from docquarry.filters.classify import classify, never_allowed, or_depth, time_bounds, unknown
from docquarry.filters.compile import where
from docquarry.filters.intervals import Interval, as_utc, chunks, union
from docquarry.functions.mixed import mixed_case
from docquarry.operators import buckets
from docquarry.operators.ordering import orders
from docquarry.plans.collection import UNSUPPORTED, Collection, accelerate
from docquarry.plans.cursor import flatten
from docquarry.schema import Schema
from docquarry.sources.cache import ResultCache, fingerprint, shared_folder

FEW = {"event_id": {"$lt": 60}}
WEEK = dt.timedelta(days=7)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> Collection:
    return Collection.from_parquet(spark, f"{sf_dir}/events.parquet", "ts", name="events")


def matching(made: Callable, query: dict, key: str = "event_id") -> Callable:
    """A filter over a frame made from events."""
    return lambda s, d: where(made(table(s, d, "events")), query).select(key)


def rows(made: Callable, schema: str) -> Callable:
    """Rows that the driver gets by the API, a few by the query's own filter, as a frame."""
    return lambda s, d: s.createDataFrame(list(made(s, d)), schema)


def values(names: str, *rows: tuple) -> str:
    """SQL for the rows themselves."""

    def told(v: object) -> str:
        if isinstance(v, bool) or v is None:
            return str(v if v is not None else "NULL")
        if isinstance(v, dt.datetime):
            return f"TIMESTAMP '{v.replace(tzinfo=None)}'"
        return f"{v}::BIGINT" if isinstance(v, int) else f"'{v}'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(told, r)) + ')' for r in rows)}) AS t({names})"


def ids(condition: str, source: str = "events") -> str:
    return f"SELECT event_id FROM {source} WHERE {condition}"


# reading

SOME = Schema("ts", {"event_id": K.Int(), "ts": K.DateTime(), "user_id": K.Int()})


def accelerated(s: SparkSession, d: str) -> DataFrame:
    found = accelerate(table(s, d, "events"), Schema.of(table(s, d, "events").select("event_id", "ts", "user_id"), "ts"))
    return found.find({"user_id": {"$lt": 5}}).to_df().select("event_id", "user_id")


def batches(s: SparkSession, d: str):
    cursor = events(s, d).find(FEW).sort([("value", -1), ("event_id", 1)])
    for k, frame in enumerate(cursor.to_dataframe_batches(batch_size=7)):
        yield from ((k, i, int(x)) for i, x in enumerate(frame["event_id"]))


def iterated(s: SparkSession, d: str):
    with events(s, d).find(FEW, {"ts": 1, "event_id": 1, "event_type": 1}) as cursor:
        yield from ((r["event_id"], r["event_type"]) for r in cursor)


def counted(s: SparkSession, d: str):
    c = events(s, d)
    return [("cursor", c.find(FEW).count()), ("documents", c.count_documents({"event_type": "click"})), ("estimated", c.estimated_document_count()), ("raw", c.raw_collection().count()), ("plan", c.find(FEW).raw_cursor().count())]


def cloned(s: SparkSession, d: str):
    cursor = events(s, d).find(FEW).sort("event_id").skip(5).limit(10).batch_size(3)
    first = cursor.to_list(2)
    again = cursor.clone().to_list()
    return [("first", r["event_id"]) for r in first] + [("clone", r["event_id"]) for r in again] + [("rewound", r["event_id"]) for r in cursor.rewind().to_list(1)]


def parents(df: DataFrame) -> DataFrame:
    """Columns m.a and m.b of a parent m, both null for every fifth row."""
    there = F.col("event_id") % 5 != 0
    return df.withColumn("m.a", F.when(there, F.col("user_id"))).withColumn("m.b", F.when(there & (F.col("event_id") % 2 == 0), F.col("event_type")))


PARENTS = "(SELECT *, CASE WHEN event_id % 5 <> 0 THEN user_id END AS a, CASE WHEN event_id % 5 <> 0 AND event_id % 2 = 0 THEN event_type END AS b FROM events)"


def sorted_by_parent(s: SparkSession, d: str) -> DataFrame:
    return Collection(parents(table(s, d, "events")), time_field="ts").find({"event_id": {"$lt": 40}}).sort("m").limit(25).to_df().select("event_id")


def from_json(s: SparkSession, d: str) -> DataFrame:
    """Documents with a nested one, as lines of JSON, by a schema with dotted names."""
    path = f"{shared_folder(s)}/json-{uuid.uuid4().hex}"
    table(s, d, "events").select("event_id", "ts", F.struct("user_id", "value").alias("who")).write.json(path)
    schema = Schema("ts", {"event_id": K.Int(), "ts": K.Timestamp("us"), "who.user_id": K.Int(), "who.value": K.Float()})
    return Collection.from_json(s, path, schema).find({"who.user_id": {"$lt": 9}}).to_df().select("event_id", F.col("`who.user_id`").alias("user_id"), F.col("`who.value`").alias("value"))


def coerced(s: SparkSession, d: str) -> DataFrame:
    """Texts that a schema says are numbers: null where they are none."""
    df = table(s, d, "events").select("event_id", "ts", F.when(F.col("event_id") % 3 == 0, F.col("user_id").cast("string")).otherwise(F.col("event_type")).alias("mark"))
    schema = Schema("ts", Schema.of(df.withColumn("mark", F.lit(1).cast("long")), "ts").fields)
    return Collection(df, schema).find({}).to_df(coerce="error").select("event_id", F.col("mark").cast("string").alias("mark"))


def flattened(s: SparkSession, d: str) -> DataFrame:
    flat, _ = flatten(table(s, d, "events").select("event_id", F.struct("user_id", F.struct("value").alias("more")).alias("who")))
    return flat.select("event_id", F.col("`who.user_id`").alias("user_id"), F.col("`who.more.value`").alias("value"))


def shards(s: SparkSession, d: str) -> DataFrame:
    path = f"{d}/events.parquet"
    return Collection.from_parquet(s, [path, path], "ts").find({"event_type": "signup"}).to_df().select("event_id")


def spec_rows(s: SparkSession, d: str):
    schema = Schema.from_spec(Schema.of(table(s, d, "events"), "ts").to_spec())
    return [(n, t.spark().simpleString()) for n, t in schema.fields.items()]


# keeping results


def kept_and_sorted(s: SparkSession, d: str):
    root = f"{shared_folder(s)}/results"
    cursor = events(s, d).find(FEW).sort([("value", 1), ("event_id", -1)])
    cursor.to_arrow(cache_root=root)
    return [(k, x) for k, x in enumerate(cursor.to_arrow(cache_root=root, cache_write=False)["event_id"].to_pylist())]


def kept_mixed(s: SparkSession, d: str) -> DataFrame:
    """A kept, sorted and decoded result: a column of mixed types as numbers."""
    k = F.col("event_id") % 3
    df = table(s, d, "events").withColumn("v", mixed_case((k == 0, F.col("value"), T.DoubleType()), (k == 1, F.col("user_id"), T.LongType()), (k == 2, F.col("event_type"), T.StringType())))
    c = Collection(df, time_field="ts", source=f"mixed events of {d}")
    return c.find({"user_id": {"$lt": 30}}).sort([("v", 1), ("event_id", 1)]).cached(f"{shared_folder(s)}/results", cache_read=False, any_type_strategy="float").select("event_id", "v")


def kept_apart(s: SparkSession, d: str) -> DataFrame:
    """Two frames with results of the same query: each has its own."""
    root, out = f"{shared_folder(s)}/results", None
    for low, source in ((0, "low"), (100, "high")):
        df = table(s, d, "events").where(F.col("event_id").between(low, low + 9))
        found = Collection(df, time_field="ts", source=f"{source} events of {d}").find({"value": {"$gte": 0}}).cached(root, cache_read=bool(low)).select("event_id")
        out = found if out is None else out.unionAll(found)
    return out


def kept_statistics(s: SparkSession, d: str):
    c = events(s, d)
    cache = ResultCache(s, f"{shared_folder(s)}/results", fingerprint(c.source, c.schema, {"q": uuid.uuid4().hex}))
    before = cache.exists()
    cache.write(c.find({"event_type": "view"}).to_df())
    found = cache.statistics()
    cache.clean()
    return [("before", int(before)), ("rows", found["total_rows"]), ("fields", len(found["schema_fields"])), ("after", int(cache.exists()))]


# partitions


def called(s: SparkSession, d: str):
    """What a callback on the driver gets, by week and type."""
    got = []

    def callback(part, about):
        got.append((about["time_start"].replace(tzinfo=None), about["partition_values"]["event_type"], about["row_count"], part.num_rows, part["event_id"].to_pylist()[0], about["total_partitions"]))

    events(s, d).find({"user_id": {"$lt": 50}}).sort("ts").stream_to_callback(callback, partition_time_delta=WEEK, partition_by="event_type", max_workers=4)
    return got


def called_summary(s: SparkSession, d: str):
    """The totals of a callback that takes whole weeks of all events, on the executors."""
    found = events(s, d).find({}).stream_to_callback(lambda part, about: None, partition_time_delta=WEEK, on_executors=True)
    return [(n, found[n]) for n in ("total_partitions", "total_rows", "skipped_partitions")]


def written(s: SparkSession, d: str) -> DataFrame:
    path = f"{shared_folder(s)}/partitioned-{uuid.uuid4().hex}"
    buckets.write_partitioned(table(s, d, "events"), path, "ts", WEEK, ["event_type"])
    return s.read.parquet(path).groupBy(F.to_timestamp_ntz("bucket").alias("bucket"), "event_type").agg(F.count(F.lit(1)).alias("n"))


WEEKS = "time_bucket(INTERVAL '7 days', ts, (SELECT date_trunc('day', min(ts)) FROM events{}))"

# classification

A, B, C = (dt.datetime(2024, 1, k, tzinfo=dt.UTC) for k in (5, 10, 15))
FILTERS = {
    "bounded": {"ts": {"$gte": A, "$lt": C}},
    "branches": {"$or": [{"ts": {"$gte": A, "$lt": B}}, {"ts": {"$gte": B, "$lt": C}, "user_id": 5}]},
    "open": {"ts": {"$gte": A}},
    "none": {"user_id": 5},
    "negated": {"ts": {"$gte": A, "$lt": C, "$ne": B}},
    "nor": {"ts": {"$gte": A, "$lt": C}, "$nor": [{"ts": B}]},
    "nested": {"$or": [{"$or": [{"ts": A}]}]},
    "empty or": {"$or": []},
    "text": {"$text": {"$search": "x"}},
    "unknown": {"user_id": {"$unheard": 1}},
    "contradiction": {"ts": {"$gte": C, "$lt": A}},
}
MODES = {"bounded": "parallel", "branches": "parallel", "empty or": "reject"}


def classified(s: SparkSession, d: str):
    return [(name, classify(q, "ts").mode, or_depth(q), never_allowed(q), unknown(q)) for name, q in FILTERS.items()]


def bounded(s: SparkSession, d: str):
    plain = lambda t: t and t.replace(tzinfo=None)
    return [(name, plain(b.low), plain(b.high)) for name in ("bounded", "branches", "open", "none") for b in [time_bounds(FILTERS[name], "ts")]]


def merged(s: SparkSession, d: str):
    return [(i.low.replace(tzinfo=None), i.high.replace(tzinfo=None)) for i in union([Interval(B, C), Interval(A, B, high_closed=False), Interval(C, C), Interval(C + WEEK, C + 2 * WEEK, low_closed=False), Interval(C, A)])]


def explained(s: SparkSession, d: str):
    found = events(s, d).find(FILTERS["branches"]).explain(max_workers=3)
    return [("mode", found["mode"]), ("chunks", str(found["estimated_chunks"])), ("workers", str(found["settings"]["workers"])), ("branches", str(found["branches"])), ("scan", str("Scan parquet" in found["plan"]))]


def refused(s: SparkSession, d: str):
    c = events(s, d)
    for name in sorted(UNSUPPORTED):
        try:
            getattr(c, name)
        except NotImplementedError:
            yield (name,)


# areas, expressions, mixed values


def located(df: DataFrame) -> DataFrame:
    return df.withColumn("at", F.array("value", (F.col("user_id") % 100).cast("double")))


def near(area: dict) -> Callable:
    return matching(located, {"at": {"$geoWithin": area}})


RING = [[0, 0], [60, 0], [60, 60], [0, 60], [0, 0]]


def expr(e: object) -> Callable:
    return matching(lambda df: df, {"$expr": e})


def wide(df: DataFrame) -> DataFrame:
    """Whole numbers about 2 ** 53, as mixed values."""
    return df.withColumn("v", mixed_case((F.lit(True), F.lit(2**53) + F.col("event_id") % 4, T.LongType())))


def wide_sorted(s: SparkSession, d: str):
    c = Collection(wide(table(s, d, "events").where("event_id < 40")), time_field="ts")
    return [(k, r["event_id"]) for k, r in enumerate(c.frame().orderBy(*orders([("v", -1), ("event_id", 1)], c.schema)).select("event_id").collect())]


def binary(df: DataFrame) -> DataFrame:
    return df.withColumn("v", mixed_case((F.lit(True), F.col("event_type").cast("binary"), T.BinaryType())))


def decoded(s: SparkSession, d: str):
    k = F.col("event_id") % 3
    df = table(s, d, "events").withColumn("v", mixed_case((k == 0, F.col("value"), T.DoubleType()), (k == 1, F.col("event_type"), T.StringType())))
    found = Collection(df, time_field="ts").find(FEW).to_dataframe()
    return [(int(i), type(v).__name__) for i, v in zip(found["event_id"], found["v"], strict=True)]


SURFACE: dict[str, tuple[Callable, str]] = {
    "a_accelerate": (accelerated, "SELECT event_id, user_id FROM events WHERE user_id < 5"),
    "a_find_one": (rows(lambda s, d: [(r["event_id"], r["event_type"]) for r in [events(s, d).find_one({"event_id": 7})]], "event_id long, event_type string"), "SELECT event_id, event_type FROM events WHERE event_id = 7"),
    "a_iterate": (rows(iterated, "event_id long, event_type string"), "SELECT event_id, event_type FROM events WHERE event_id < 60"),
    "a_to_list": (rows(lambda s, d: [(r["event_id"],) for r in events(s, d).find({"event_id": 3}).to_list()], "event_id long"), ids("event_id = 3")),
    "a_batches_sorted": (rows(batches, "batch long, place long, event_id long"), "SELECT (n // 7)::BIGINT AS batch, (n % 7)::BIGINT AS place, event_id FROM (SELECT event_id, row_number() OVER (ORDER BY value DESC, event_id) - 1 AS n FROM events WHERE event_id < 60)"),
    "a_to_dataframe": (rows(lambda s, d: [(int(i), float(v)) for i, v in events(s, d).find(FEW).to_dataframe(accelerate=False, max_workers=2)[["event_id", "value"]].itertuples(index=False)], "event_id long, value double"), "SELECT event_id, value FROM events WHERE event_id < 60"),
    "a_to_arrow": (rows(lambda s, d: [(x,) for x in events(s, d).find(FEW).to_arrow()["event_id"].to_pylist()], "event_id long"), ids("event_id < 60")),
    "a_counts": (rows(counted, "what string, n long"), "SELECT 'cursor' AS what, count(*) AS n FROM events WHERE event_id < 60 UNION ALL SELECT 'documents', count(*) FROM events WHERE event_type = 'click' UNION ALL SELECT x, count(*) FROM events, (VALUES ('estimated'), ('raw')) AS t(x) GROUP BY x UNION ALL SELECT 'plan', count(*) FROM events WHERE event_id < 60"),
    "a_distinct": (rows(lambda s, d: [(x,) for x in events(s, d).find({"user_id": {"$lt": 40}}).distinct("event_type")], "event_type string"), "SELECT DISTINCT event_type FROM events WHERE user_id < 40"),
    "a_clone": (rows(cloned, "what string, event_id long"), values("what, event_id", ("first", 5), ("first", 6), *[("clone", k) for k in range(5, 15)], ("rewound", 5))),
    "a_list_sort": (rows(lambda s, d: [(k, r["event_id"]) for k, r in enumerate(events(s, d).find(FEW).sort(["event_type", "event_id"]))], "place long, event_id long"), "SELECT row_number() OVER (ORDER BY event_type, event_id) - 1 AS place, event_id FROM events WHERE event_id < 60"),
    "a_parent_sort": (sorted_by_parent, f"SELECT event_id FROM {PARENTS} WHERE event_id < 40 ORDER BY a NULLS LAST, b NULLS LAST LIMIT 25"),
    "a_json": (from_json, "SELECT event_id, user_id, value FROM events WHERE user_id < 9"),
    "a_coerce": (coerced, "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN user_id::VARCHAR END AS mark FROM events"),
    "a_flatten": (flattened, "SELECT event_id, user_id, value FROM events"),
    "a_shards": (shards, "SELECT event_id FROM events WHERE event_type = 'signup' UNION ALL SELECT event_id FROM events WHERE event_type = 'signup'"),
    "a_schema_spec": (rows(spec_rows, "name string, kind string"), values("name, kind", ("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"), ("event_type", "string"), ("value", "double"), ("props", "string"))),
    "c_sorted": (rows(kept_and_sorted, "place long, event_id long"), "SELECT row_number() OVER (ORDER BY value, event_id DESC) - 1 AS place, event_id FROM events WHERE event_id < 60"),
    "c_mixed": (kept_mixed, "SELECT event_id, CASE event_id % 3 WHEN 0 THEN value WHEN 1 THEN user_id::DOUBLE END AS v FROM events WHERE user_id < 30"),
    "c_frames": (kept_apart, ids("event_id < 10 OR event_id BETWEEN 100 AND 109")),
    "c_statistics": (rows(kept_statistics, "what string, n long"), "SELECT 'before' AS what, 0::BIGINT AS n UNION ALL SELECT 'rows', count(*) FROM events WHERE event_type = 'view' UNION ALL SELECT 'fields', 6 UNION ALL SELECT 'after', 0"),
    "cb_driver": (rows(called, "bucket timestamp_ntz, event_type string, n long, got long, first_id long, parts long"), f"SELECT *, n AS got, (SELECT count(*) FROM (SELECT DISTINCT {WEEKS.format(' WHERE user_id < 50')}, event_type FROM events WHERE user_id < 50)) AS parts FROM (SELECT {WEEKS.format(' WHERE user_id < 50')} AS bucket, event_type, count(*) AS n, arg_min(event_id, ts) AS first_id FROM events WHERE user_id < 50 GROUP BY ALL)"),
    "cb_summary": (rows(called_summary, "what string, n long"), f"SELECT 'total_partitions' AS what, count(DISTINCT {WEEKS.format('')}) AS n FROM events UNION ALL SELECT 'total_rows', count(*) FROM events UNION ALL SELECT 'skipped_partitions', 0"),
    "cb_written": (written, f"SELECT {WEEKS.format('')} AS bucket, event_type, count(*) AS n FROM events GROUP BY ALL"),
    "k_classify": (rows(classified, "name string, mode string, depth long, never string, unheard string"), values("name, mode, depth, never, unheard", *[(n, MODES.get(n, "single"), {"nested": 2, "branches": 1, "empty or": 1}.get(n, 0), "$text" if n == "text" else None, "$unheard" if n == "unknown" else None) for n in FILTERS])),
    "k_bounds": (rows(bounded, "name string, low timestamp_ntz, high timestamp_ntz"), values("name, low, high", ("bounded", A, C), ("branches", A, C), ("open", A, None), ("none", None, None))),
    "k_merge": (rows(merged, "low timestamp_ntz, high timestamp_ntz"), values("low, high", (A, C), (C + WEEK, C + 2 * WEEK))),
    "k_chunks": (rows(lambda s, d: [(a.replace(tzinfo=None), b.replace(tzinfo=None)) for a, b in chunks(A + dt.timedelta(hours=5), B, dt.timedelta(days=2))], "low timestamp_ntz, high timestamp_ntz"), values("low, high", (A + dt.timedelta(hours=5), A + dt.timedelta(days=2)), (A + dt.timedelta(days=2), A + dt.timedelta(days=4)), (A + dt.timedelta(days=4), B))),
    "k_times": (rows(lambda s, d: [(as_utc(v).replace(tzinfo=None),) for v in (dt.date(2024, 1, 5), "2024-01-05T02:00:00+02:00", dt.datetime(2024, 1, 5), A)], "moment timestamp_ntz"), values("moment", *[(A,)] * 4)),
    "k_explain": (rows(explained, "what string, value string"), values("what, value", ("mode", "parallel"), ("chunks", "10"), ("workers", "3"), ("branches", "2"), ("scan", "True"))),
    "k_refused": (rows(refused, "name string"), values("name", *[(n,) for n in sorted(UNSUPPORTED)])),
    "g_box": (near({"$box": [[10, 20], [40, 70]]}), ids("value BETWEEN 10 AND 40 AND user_id % 100 BETWEEN 20 AND 70")),
    "g_polygon": (near({"$polygon": [[0, 0], [50, 0], [0, 50]]}), ids("value >= 0 AND user_id % 100 < 50 AND value < 50 - user_id % 100")),
    "g_geometry": (near({"$geometry": {"type": "Polygon", "coordinates": [RING]}}), ids("value >= 0 AND value < 60 AND user_id % 100 < 60")),
    "g_center_sphere": (matching(lambda df: df.withColumn("at", F.array("value", (F.col("user_id") % 80).cast("double"))), {"at": {"$geoWithin": {"$centerSphere": [[20, 30], 0.3]}}}), ids("2 * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians(user_id % 80 - 30) / 2), 2) + cos(radians(user_id % 80)) * cos(radians(30)) * pow(sin(radians(value - 20) / 2), 2)))) <= 0.3::DOUBLE")),
    "f_parent_null": (matching(parents, {"m": None}), ids("a IS NULL AND b IS NULL", PARENTS)),
    "f_parent_ne_null": (matching(parents, {"m": {"$ne": None}}), ids("a IS NOT NULL OR b IS NOT NULL", PARENTS)),
    "f_parent_exists": (matching(parents, {"m": {"$exists": False}}), ids("a IS NULL AND b IS NULL", PARENTS)),
    "f_parent_document": (matching(parents, {"m": {"a": 5, "b": "click"}}), ids("a = 5 AND b = 'click'", PARENTS)),
    "e_classes": (expr({"$gt": ["$event_type", 5]}), ids("event_type IS NOT NULL")),
    "e_divide": (expr({"$gt": [{"$divide": ["$value", {"$subtract": ["$user_id", 5]}]}, 1]}), ids("user_id <> 5 AND value / (user_id - 5) > 1")),
    "e_truth": (expr({"$and": [{"$cond": [{"$lt": ["$value", 10]}, "false", None]}, {"$mod": ["$user_id", 2]}]}), ids("value < 10 AND user_id % 2 <> 0")),
    "e_dates": (expr({"$and": [{"$eq": [{"$dayOfWeek": "$ts"}, 3]}, {"$lt": [{"$hour": "$ts"}, 12]}, {"$gte": ["$ts", A]}]}), ids("dayofweek(ts) = 2 AND hour(ts) < 12 AND ts >= TIMESTAMP '2024-01-05'")),
    "e_strings": (expr({"$or": [{"$eq": [{"$substrCP": ["$event_type", 1, 2]}, "li"]}, {"$eq": [{"$concat": [{"$toUpper": "$event_type"}, "!"]}, "VIEW!"]}, {"$eq": [{"$indexOfCP": ["$event_type", "rror"]}, 1]}]}), ids("substr(event_type, 2, 2) = 'li' OR event_type = 'view' OR event_type LIKE '_rror%'")),
    "e_switch": (expr({"$eq": [{"$switch": {"branches": [{"case": {"$lt": ["$value", 5]}, "then": "low"}, {"case": {"$lt": ["$value", 30]}, "then": "mid"}], "default": "high"}}, "mid"]}), ids("value >= 5 AND value < 30")),
    "e_in": (expr({"$in": ["$event_type", ["click", 7, "error"]]}), ids("event_type IN ('click', 'error')")),
    "e_array": (matching(located, {"$expr": {"$gt": [{"$arrayElemAt": ["$at", -1]}, {"$arrayElemAt": ["$at", 0]}]}}), ids("user_id % 100 > value")),
    "e_numbers": (expr({"$eq": [{"$trunc": [{"$divide": ["$user_id", 4]}, 0]}, {"$floor": {"$sqrt": {"$multiply": ["$user_id", 1]}}}]}), ids("trunc(user_id / 4.0) = floor(sqrt(user_id))")),
    "any_int64": (matching(wide, {"v": 2**53 + 1}), ids("event_id % 4 = 1")),
    "any_int64_range": (matching(wide, {"v": {"$gt": 2**53, "$lte": 2**53 + 2}}), ids("event_id % 4 IN (1, 2)")),
    "any_int64_sort": (rows(wide_sorted, "place long, event_id long"), "SELECT row_number() OVER (ORDER BY event_id % 4 DESC, event_id) - 1 AS place, event_id FROM events WHERE event_id < 40"),
    "any_binary": (matching(binary, {"v": b"click"}), ids("event_type = 'click'")),
    "any_decode_python": (rows(decoded, "event_id long, kind string"), "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'float' WHEN 1 THEN 'str' ELSE 'NoneType' END AS kind FROM events WHERE event_id < 60"),
    "m_project_missing": (lambda s, d: events(s, d).aggregate([{"$match": FEW}, {"$project": {"event_id": 1, "nowhere": 1}}]).select("event_id", F.col("nowhere").cast("string").alias("nowhere")), "SELECT event_id, NULL::VARCHAR AS nowhere FROM events WHERE event_id < 60"),
}
