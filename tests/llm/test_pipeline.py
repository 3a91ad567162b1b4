import zlib

import corpus_pipeline
from helpers import DATA


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    before = {r["doc_id"]: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns
        rows = docs.collect()
        if name == "language_id":
            assert len(rows) == len(before)
        elif name == "line_dedup":
            seen = {}
            for r in sorted(before.values(), key=lambda r: r["doc_id"]):
                for k in {x.strip(" \t\n\v\f\r").lower() for x in r["text"].split("\n")}:
                    seen.setdefault(k, r["doc_id"])
            plain = {i: "\n".join(x for x in r["text"].split("\n") if len(k := x.strip(" \t\n\v\f\r").lower()) < 10 or seen[k] == i) for i, r in before.items()}
            assert {r["doc_id"]: r["text"] for r in rows} == plain
        elif name == "simhash_dedup":
            assert len({r["doc_id"] for r in rows}) == len(rows) < len(before)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in rows}
    loads = {}
    for r in packed:
        assert len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) >= 0
        loads[r["sequence_id"]] = loads.get(r["sequence_id"], 0) + r["length"]
    assert max(loads.values()) <= 4096


def test_run_is_registered(spark):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert corpus_pipeline.run(spark, DATA).count() > 0
