import duckdb
import pytest
from helpers import DATA, rows_of

from docquarry.plans import catalogue


@pytest.mark.parametrize("name", list(catalogue.CATALOGUE))
def test_query_matches_its_sql(spark, duck, name):
    run, sql = catalogue.CATALOGUE[name]
    got, want = run(spark, DATA).toPandas(), duck.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", ["any_sort", "any_sort_desc"])
def test_mixed_order_of_whole_numbers_of_64_bits(spark, duck, tmp_path, name):
    run, sql = catalogue.CATALOGUE[name]
    duck.execute(f"COPY (SELECT * REPLACE (value // 10 AS value, CASE WHEN event_id % 3 = 0 THEN user_id + 4294967296 ELSE value::BIGINT // 10 END AS user_id) FROM events) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    want = duckdb.connect().execute(f"WITH events AS (FROM '{tmp_path}/events.parquet') {sql}").df()
    assert rows_of(run(spark, str(tmp_path)).toPandas()) == rows_of(want)


def test_positions_over_many_ranges(spark, duck):
    run, sql = catalogue.CATALOGUE["any_sort_desc"]
    changed = {"spark.sql.shuffle.partitions": "700", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    kept = {k: spark.conf.get(k) for k in changed}
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        got = run(spark, DATA)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert rows_of(got.toPandas()) == rows_of(duck.execute(sql).df())


def sent_to_driver(spark, run):
    """Bytes of task results, less 10,000 of each task, while run() does."""

    def stages():
        gateway = spark.sparkContext._gateway
        none = gateway.jvm.java.util.ArrayList()
        found = spark.sparkContext._jsc.sc().statusStore().stageList(none, False, False, gateway.new_array(gateway.jvm.double, 0), none)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        return {(s.stageId(), s.attemptId()): max(0, s.resultSize() - 10_000 * s.numCompleteTasks()) for s in (found.apply(i) for i in range(found.size()))}

    before = stages()
    run()
    stages()
    return sum(n for k, n in stages().items() if k not in before)


def test_callbacks_on_executors_leave_rows_there(spark, duck, tmp_path):
    duck.execute(f"COPY (SELECT * REPLACE (event_id + 1000 * k AS event_id) FROM events, range(100) AS t(k)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    found = []
    sent = sent_to_driver(spark, lambda: found.extend(catalogue.CATALOGUE["cb_summary"][0](spark, str(tmp_path)).collect()))
    assert {r["what"]: r["n"] for r in found}["total_rows"] == duck.execute(f"SELECT count(*) FROM '{tmp_path}/events.parquet'").fetchone()[0]
    assert sent < 100_000


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
