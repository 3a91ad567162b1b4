import datetime as dt
import json
import pickle

import pytest
from pyspark.sql import functions as F

import docquarry as q
from docquarry.filters.compile import where
from docquarry.filters.tree import InvalidQuery
from docquarry.functions.mixed import decode_value, encode_value, sort_keys
from docquarry.operators import buckets
from docquarry.sources.cache import ResultCache, fingerprint

HOUR = dt.timedelta(hours=1)
T0 = dt.datetime(2024, 1, 15)


@pytest.fixture(scope="module")
def sensors(spark):
    rows = [(T0 + k * HOUR, float(k), "abc"[k % 3] if k % 5 else None, k) for k in range(30)] + [(None, -1.0, "a", 99)]
    df = spark.createDataFrame(rows, "t timestamp_ntz, value double, `meta.device` string, `meta.n` long")
    return q.Collection(df, time_field="t", name="sensors")


def test_schema_rules():
    with pytest.raises(ValueError):
        q.Schema("t", {"x": q.Int()})
    with pytest.raises(ValueError):
        q.Schema("t", {"t": q.Int()})
    s = q.Schema("t", {"t": q.Timestamp("ms"), "a.b": q.ObjectId(), "a.c": q.Any(), "l": q.List(q.Int()), "d": q.Struct({"x": q.Float(), "y": q.Bool()})})
    assert s.expand("a") == ["a.b", "a.c"] and s.get_any_fields() == ["a.c"]
    assert q.Schema.from_spec(json.loads(json.dumps(s.to_spec()))) == s
    assert q.Struct({"x": q.Int(), "y": q.String()}) == q.Struct({"y": q.String(), "x": q.Int()}) and len({q.Any(), q.Any(), q.List(q.Int()), q.List(q.Int())}) == 2
    with pytest.raises(ValueError):
        s.expand("z")


def test_boundaries_and_slices(sensors):
    n = lambda f, **o: sensors.find(f).to_df(**o).count()
    at = T0 + 3 * HOUR
    assert [n({"t": {op: at}}) for op in ("$lte", "$lt", "$gt", "$gte", "$eq")] == [4, 3, 26, 27, 1]
    assert n({}, start_date=T0 + HOUR, end_date=T0 + 3 * HOUR) == 2
    assert n({}, start_date=dt.date(2024, 1, 16)) == 6
    assert n({}, start_date="2024-01-15T01:00:00+01:00") == 30
    with pytest.raises(ValueError):
        n({}, start_date="2024-01-15T01:00:00")
    with pytest.raises(TypeError):
        n({}, start_date=5)


def test_projection_sort_limit(sensors):
    assert sensors.find({}, {"t": 1, "meta": 1}).to_df().columns == ["t", "meta.device", "meta.n"]
    assert sensors.find({}, {"value": 0}).to_df().columns == ["t", "meta.device", "meta.n"]
    for bad in ({"value": 1}, {"t": 0}, {"t": 1, "value": 0}):
        with pytest.raises(ValueError):
            sensors.find({}, bad).to_df()
    with pytest.raises(ValueError):
        sensors.find({}, {"t": 1}, sort=[("value", 1)]).to_df()
    found = sensors.find({}).sort("meta", -1).skip(2).limit(3).to_df().collect()
    assert [(r["meta.device"], r["meta.n"]) for r in found] == [("c", 23), ("c", 17), ("c", 14)]
    last = sensors.find({}).sort([("meta.device", 1), ("meta.n", 1)]).to_df().collect()
    assert last[-1]["meta.device"] is None and sensors.find({}).sort("meta.device", -1).to_df().collect()[-1]["meta.device"] is None
    with pytest.raises(ValueError):
        sensors.find({}, limit=-1)
    with pytest.raises(ValueError):
        sensors.find({}).sort("$natural").to_df()


def test_iteration(sensors):
    cursor = sensors.find({"value": {"$lt": 3}}).sort("value")
    first = next(cursor)
    assert first["value"] == -1.0 and len(cursor.to_list()) == 3
    with pytest.raises(RuntimeError):
        cursor.limit(3)
    batches = list(sensors.find({}).sort("value", -1).to_dataframe_batches(batch_size=8))
    assert [len(b) for b in batches] == [8, 8, 8, 7] and batches[0]["value"].iloc[0] == 29.0
    assert sensors.find_one({"value": 7})["meta.n"] == 7 and sensors.find_one({"value": 1000}) is None
    assert sensors.count_documents({"meta.device": None}) == 6 and sorted(sensors.distinct("meta.device")) == ["a", "b", "c"]
    with pytest.raises(NotImplementedError):
        sensors.insert_one({})


def test_results_are_kept_by_source_and_schema(spark, sensors, tmp_path):
    root = str(tmp_path)
    with pytest.raises(ValueError, match="source"):
        sensors.find({}).cached(root)  # a frame has no name to keep results by
    sensors = q.Collection(sensors.df, sensors.schema, source="sensors of this test")
    cursor = sensors.find({"value": {"$gte": 0}})
    assert cursor.cached(root).count() == 30
    other = q.Collection(sensors.df.limit(0), sensors.schema, source="others")
    assert other.find({"value": {"$gte": 0}}).cached(root).count() == 0
    key = fingerprint(sensors.source, sensors.schema, {"a": 1, "b": T0})
    assert key == fingerprint(sensors.source, sensors.schema, {"b": T0, "a": 1}) != fingerprint("x", sensors.schema, {"a": 1, "b": T0})
    part = ResultCache(spark, root, "partial")
    part.write(sensors.df)
    assert part.statistics()["total_rows"] == 31
    (tmp_path / "partial" / "_SUCCESS").unlink()
    assert not part.exists()
    with pytest.raises(FileNotFoundError):
        part.read()
    part.clean()
    assert not (tmp_path / "partial").exists()


def test_buckets_and_callbacks(sensors):
    seen = []
    found = sensors.find({}).stream_to_callback(lambda table, meta: seen.append((meta["partition_values"]["meta.device"], table.num_rows, meta["row_count"])), partition_time_delta=dt.timedelta(hours=10), partition_by="meta.device")
    assert found["total_rows"] == 30 and found["skipped_partitions"] == 1 and found["total_partitions"] == len(seen) == 12
    assert all(a == b for _, a, b in seen) and any(k is None for k, _, _ in seen)
    with pytest.raises(RuntimeError, match="partition"):
        sensors.find({}).stream_to_callback(lambda *_: 1 / 0, partition_time_delta=dt.timedelta(days=1))
    for bad in ({"limit": 3}, {"sort": [("value", 1)]}):
        with pytest.raises(ValueError):
            sensors.find({}, **bad).stream_to_callback(print, partition_time_delta=HOUR)
    with pytest.raises(ValueError):
        sensors.find({}).stream_to_callback(print, partition_time_delta=HOUR, partition_by="t")
    with pytest.raises(ValueError):
        buckets.seconds_of(dt.timedelta(milliseconds=5))


def keeping(folder):
    """A callback that keeps what it gets in files."""

    def keep(table, about):
        with open(f"{folder}/{about['partition_index']}", "xb") as f:
            pickle.dump((table.combine_chunks(), about), f)

    return keep, lambda: [pickle.loads((folder / str(i)).read_bytes()) for i in range(len(list(folder.iterdir())))]


def test_callbacks_on_executors(spark, tmp_path):
    rows = [(T0 + (k * 7 % 30) * HOUR, k * 7 % 30, "abc"[k % 3] if k % 5 else None, (k, "x"), k, k % 2) for k in range(30)] + [(None, -1, "a", None, 99, 0)]
    df = spark.createDataFrame(rows, "t timestamp_ntz, n long, `meta.device` string, s struct<a: long, b: string>, _bucket long, _index long")
    c, got = q.Collection(df.repartition(3), time_field="t", name="odd"), []
    for by in ("meta.device", ["meta.device", "n"], None):
        out = []
        for on_executors in (False, True):
            folder = tmp_path / f"{on_executors}-{len(got)}-{by}"
            folder.mkdir()
            keep, kept = keeping(folder)
            found = c.find({}).stream_to_callback(keep, partition_time_delta=dt.timedelta(hours=10), partition_by=by, on_executors=on_executors)
            out.append(({k: n for k, n in found.items() if not k.endswith("_s")}, kept()))
        (sums, parts), (other_sums, other_parts) = out
        assert sums == other_sums and sums["total_rows"] == 30 and sums["skipped_partitions"] == 1 and sums["total_partitions"] == len(parts) == len(other_parts)
        for (table, about), (other, other_about) in zip(parts, other_parts, strict=True):
            assert about == other_about and about["row_count"] == table.num_rows and table.column_names == df.columns
            assert table.equals(other)
        got.append(sums["total_partitions"])
    assert got == [12, 30, 3]
    with pytest.raises(RuntimeError, match="partition 1 .*ZeroDivisionError"):
        c.find({}).stream_to_callback(lambda _, about: about["partition_index"] == 1 and 1 / 0, partition_time_delta=dt.timedelta(hours=10), on_executors=True)
    assert c.find({"n": {"$gt": 99}}).stream_to_callback(print, partition_time_delta=HOUR, on_executors=True)["total_partitions"] == 0


def test_wide_partitions_on_executors_are_in_order(spark, tmp_path):
    """Places of partition and time beyond 63 bits are coarser than the times."""
    df = spark.range(4000).selectExpr("timestamp_ntz'2024-01-15' + make_dt_interval(0, 0, 0, (id * 7919) % 4000 / 1000) AS t", "id % 800 AS k", "id")
    folder = tmp_path / "kept"
    folder.mkdir()
    keep, kept = keeping(folder)
    q.Collection(df, time_field="t", name="wide").find({}).stream_to_callback(keep, partition_time_delta=dt.timedelta(days=100_000), partition_by="k", on_executors=True)
    parts = [(about["partition_values"]["k"], table["k"].to_pylist(), table["t"].to_pylist()) for table, about in kept()]
    assert [k for k, _, _ in parts] == list(range(800)) and all(ks == [k] * 5 and ts == sorted(ts) for k, ks, ts in parts)


def test_partitioned_write(spark, sensors, tmp_path):
    buckets.write_partitioned(sensors.frame().select("t", "value"), str(tmp_path / "out"), "t", dt.timedelta(days=1))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 31


def test_explain(sensors):
    out = sensors.find({"t": {"$gte": T0, "$lt": T0 + 48 * HOUR}, "$or": [{"meta.n": 1}, {"meta.n": 2}]}, limit=3).explain()
    assert out["mode"] == "parallel" and out["estimated_chunks"] == 2 and out["branches"] == 2 and "Physical Plan" in out["plan"]
    assert sensors.find({"meta.n": 1}).explain(plan=False)["mode"] == "single"
    some = sensors.find({"t": {"$gte": T0, "$lt": T0 + 15 * 24 * HOUR}}).explain(plan=False, max_workers=10, chunking_granularity=dt.timedelta(days=7))
    assert some["estimated_chunks"] == some["settings"]["workers"] == 3
    with pytest.raises(ValueError):
        sensors.find({}).to_dataframe(chunking_granularity=dt.timedelta(0))


def test_mixed_values(spark):
    given = [None, True, 3, 2**40, 2.5, "a", b"\x00\xff", {"k": [1]}, [1, "x"], T0]
    rows = [(k, T0, encode_value(v)) for k, v in enumerate(given)]
    df = spark.createDataFrame(rows, q.Schema("t", {"id": q.Int(), "t": q.Timestamp("us", None), "v": q.Any()}).to_struct())
    c = q.Collection(df, time_field="t")
    out = c.find({}).to_dataframe().sort_values("id")["v"].tolist()
    assert out == given
    assert decode_value(None) is None
    strings = [r["v"] for r in c.find({}).sort("id").to_df(any_type_strategy="string").collect()]
    assert strings[1:6] == ["true", "3", str(2**40), "2.5", "a"] and strings[9].startswith("2024-01-15T00:00:00")
    floats = [r["v"] for r in c.find({}).sort("id").to_df(any_type_strategy="float").collect()]
    assert floats[:5] == [None, 1.0, 3.0, float(2**40), 2.5] and floats[5:] == [None] * 5
    order = [r["id"] for r in c.find({}).sort("v").to_df().collect()]
    assert order == [0, 4, 2, 3, 5, 7, 8, 6, 1, 9]
    assert [r["id"] for r in c.find({}).sort("v", -1).to_df().collect()] == order[::-1]
    assert {r["id"] for r in c.find({"v": {"$gt": 2.6}}).to_df().collect()} == {2, 3}
    assert {r["id"] for r in c.find({"v": None}).to_df().collect()} == {0}
    assert len(sort_keys(F.col("v"))) == 11
    with pytest.raises(ValueError):
        c.find({}).to_df(any_type_strategy="other")


#: Equal numbers of different types, and whole numbers that no double tells apart.
NUMBERS = [5, 4, 5.0, 2**40, 5, float(2**40), 2**53, 2**53 + 1, float(2**53), 2**63 - 1, float(2**63), 2**63 - 2, -(2**63), -float(2**63), -(2**53) - 1, 0, -0.0, 0.0]


def mixed_order(spark, way):
    """Ids of NUMBERS sorted by value, ties by id; as they come and as they should."""
    df = spark.createDataFrame([(k, T0, encode_value(v)) for k, v in enumerate(NUMBERS)], q.Schema("t", {"id": q.Int(), "t": q.Timestamp("us", None), "v": q.Any()}).to_struct())
    got = q.Collection(df, time_field="t").find({}).sort([("v", way), ("id", 1)]).to_df().collect()
    return [r["id"] for r in got], sorted(range(len(NUMBERS)), key=lambda k: (NUMBERS[k] * way, k))


def test_equal_numbers_of_other_types_tie(spark):
    got, want = mixed_order(spark, 1)
    assert got == want


def test_equal_numbers_of_other_types_tie_downwards(spark):
    got, want = mixed_order(spark, -1)
    assert got == want


def test_json_source(spark, tmp_path):
    path = tmp_path / "docs.json"
    path.write_text('{"t": "2024-01-01T00:00:00Z", "meta": {"id": "5f", "n": 3}, "extra": 1}\n{"t": "2024-01-02T00:00:00Z", "meta": {"n": null}}\n')
    schema = q.Schema("t", {"t": q.Timestamp(), "meta.id": q.ObjectId(), "meta.n": q.Int()})
    c = q.Collection.from_json(spark, str(path), schema)
    assert c.find({"meta.n": {"$gte": 3}}).to_df().columns == ["t", "meta.id", "meta.n"]
    assert c.count_documents({"meta.n": None}) == 1 and c.count_documents({"meta.id": {"$type": "objectId"}}) == 1


def test_streams(spark, tmp_path):
    from docquarry.streaming import incremental

    source = str(tmp_path / "in")
    spark.createDataFrame([(T0 + k * HOUR, "a" if k % 2 else "b") for k in range(48)], "t timestamp_ntz, k string").write.parquet(source)
    stream = spark.readStream.schema("t timestamp_ntz, k string").parquet(source)
    incremental.append_to(stream, str(tmp_path / "out"), str(tmp_path / "c1"), {"k": "a"}).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 24
    counts = incremental.bucket_counts(stream, "t", dt.timedelta(days=1), ["k"], query={"k": {"$ne": "z"}})
    counts.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start().awaitTermination(60)
    assert sorted(r["n"] for r in spark.table("counted").collect()) == [12] * 4


def test_frames_without_a_source_never_share_results(spark, tmp_path):
    first, second = (spark.range(k, k + 3).selectExpr("id", "timestamp_ntz'2024-01-01' AS t") for k in (0, 100))
    with pytest.raises(ValueError, match="source"):
        q.Collection(second, time_field="t").find({}).cached(str(tmp_path))
    found = [sorted(r["id"] for r in q.Collection(df, time_field="t", source=str(k)).find({}).cached(str(tmp_path)).collect()) for k, df in enumerate((first, second))]
    assert found == [[0, 1, 2], [100, 101, 102]]


def test_changed_files_are_read_again(spark, tmp_path):
    path, root = str(tmp_path / "data"), str(tmp_path / "kept")
    for n in (3, 5):
        spark.range(n).selectExpr("id", "timestamp_ntz'2024-01-01' AS t").write.mode("overwrite").parquet(path)
        assert q.Collection.from_parquet(spark, path, "t").find({}).cached(root).count() == n


@pytest.mark.parametrize("strategy", ["keep_struct", "float", "string"])
def test_kept_results_stay_sorted(spark, tmp_path, strategy):
    given = [2.5, None, 7, "b", 2**53 + 1, 2**53, True, "a"]
    rows = [(k, T0, encode_value(v)) for k, v in enumerate(given)]
    df = spark.createDataFrame(rows, q.Schema("t", {"id": q.Int(), "t": q.Timestamp("us", None), "v": q.Any()}).to_struct()).repartition(5)
    cursor = q.Collection(df, time_field="t", source="values").find({}).sort("v")
    for _ in range(2):
        assert cursor.to_arrow(any_type_strategy=strategy, cache_root=str(tmp_path))["id"].to_pylist() == [1, 0, 2, 5, 4, 7, 3, 6]


def test_expressions_never_cross_classes(spark):
    df = spark.createDataFrame([(1, "7", 4, 0, [1, 2]), (2, None, 0, 2, None), (3, "false", -4, None, [])], "id long, s string, n long, m long, xs array<long>")
    found = lambda e: [r["id"] for r in where(df, {"$expr": e}).orderBy("id").collect()]
    assert found({"$gt": ["$s", 5]}) == [1, 3] and found({"$eq": ["$s", 7]}) == [] and found({"$lt": ["$s", 5]}) == [2]
    assert found("$s") == [1, 3] and found("$n") == [1, 3] and found({"$literal": "false"}) == [1, 2, 3]
    assert found({"$eq": [{"$divide": ["$n", "$m"]}, None]}) == [1, 3] and found({"$eq": [{"$mod": ["$n", "$m"]}, 0]}) == [2]
    assert found({"$eq": [{"$add": ["$n", "$s"]}, None]}) == [1, 2, 3] and found({"$in": ["$n", [4, "x", None]]}) == [1]
    assert found({"$eq": [{"$arrayElemAt": ["$xs", -1]}, 2]}) == [1] and found({"$gt": [{"$size": "$xs"}, 0]}) == [1]
    assert found({"$gt": ["$xs", {"$literal": "z"}]}) == [1, 3] and found({"$eq": ["$nowhere", None]}) == [1, 2, 3]
    for wrong in ({"$cond": [True, 1, "x"]}, {"$eq": ["$n", {"a": 1, "b": 2}]}):
        with pytest.raises(InvalidQuery):
            found(wrong)


def test_parents_of_columns(spark):
    df = spark.createDataFrame([(1, 5, "x"), (2, None, None), (3, None, "y")], "id long, `m.d` long, `m.e` string")
    found = lambda f: [r["id"] for r in where(df, f).orderBy("id").collect()]
    assert found({"m": None}) == [2] and found({"m": {"$ne": None}}) == [1, 3] and found({"m": {"$in": [None, 3]}}) == [2]
    assert found({"m": {"d": 5, "e": "x"}}) == [1] and found({"m": {"e": "x", "d": 5}}) == [] and found({"m": {"$type": "object"}}) == [1, 3]
    assert found({"m": 5}) == [] and found({"m": {"$exists": False}}) == [2] and found({"m": {"$not": {"$eq": None}}}) == [1, 3]
    with pytest.raises(InvalidQuery):
        found({"m": {"$gt": 5}})
