"""Nulls, empty and long texts, ties, repeated rows, clashing names and empty tables; and large groups."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.llm import additive_quantisation, best_fit_packing, common, kd_sharding, language_id, line_dedup, matroska, quotation_links, secret_scan, simhash_dedup, source_mixing


def test_language_id(odd, empty):
    clashing = odd.withColumn("score", F.lit("clash")).withColumn("rejected", F.lit("clash")).withColumn("lang_pred", F.lit("clash"))
    found = language_id.identify(clashing, clashing.columns)
    assert found.columns == ["kept", "lang_pred", "score", "rejected"] and found.select("kept.*").columns == clashing.columns
    rows = found.select("kept.doc_id", F.col("kept.score").alias("own"), "lang_pred", "rejected").collect()
    assert len(rows) == 10 and {r["doc_id"]: r["lang_pred"] for r in rows if r["doc_id"] in (3, 4, 5)} == dict.fromkeys((3, 4, 5), "und")
    assert all(r["rejected"] == (r["lang_pred"] == "und") for r in rows if r["doc_id"] in (3, 4, 5)) and {r["own"] for r in rows} == {"clash"}
    assert language_id.identify(empty, ["doc_id", "text"]).count() == 0


def test_foreign_texts_are_rejected(spark):
    known = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_id.fit(known.select(F.col("doc_id").cast("string").alias("id"), "text", "lang"))
    given = spark.createDataFrame([(1, "世界人民大团结万岁 " * 50), (2, "Привет как дела сегодня хорошая погода " * 20)], "doc_id long, text string")
    assert all(r["rejected"] for r in language_id.identify(given, ["doc_id", "text"], model).collect())


def test_secret_scan(spark, odd, empty):
    model = secret_scan.train(secret_scan.random_strings(spark, 500), secret_scan.ordinary_words(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")))
    found = secret_scan.spans(odd.withColumn("found", F.lit("clash")), model, ["doc_id", "found"])
    assert len(found.collect()) == 10 and found.select("kept.*").columns == ["doc_id", "found"]
    text = "see Kx9fQ2mZr7Lp0Wv8Tn3BaYc5 and TOKEN: 'theoningandereshing', token=secret: theoninganderesh; theordinaryonesareshown"
    given = spark.createDataFrame([(1, f"é🙂 {text}")], "doc_id long, text string")
    found = secret_scan.spans(given, model, ["doc_id"]).collect()[0]["found"]
    full = f"é🙂 {text}"
    assert [(secret_scan.KINDS[s["kind"]], full[s["start"] : s["end"]]) for s in found] == [("markov", "Kx9fQ2mZr7Lp0Wv8Tn3BaYc5"), ("assign", "TOKEN: 'theoningandereshing")]
    assert secret_scan.spans(empty, model, ["doc_id"]).count() == 0


def test_kd_shards(spark, odd, empty):
    rows = kd_sharding.kd_shards(odd, odd.columns).collect()
    assert len(rows) == 10 and sum(r["size"] == 1 for r in rows) == 2 and {r["kept"]["size"] for r in rows} == {"clash"}
    assert kd_sharding.kd_shards(empty, ["doc_id"]).count() == 0
    hot = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.lit("same text " * 20)).otherwise(F.concat(F.lit("text "), F.col("id"), F.repeat(F.lit(" x"), (F.col("id") % 90).cast("int")))).alias("text"), F.lit("en").alias("lang"), F.lit(None).cast("string").alias("source"))
    sums = [r["b"] for r in kd_sharding.kd_shards(hot, ["doc_id"]).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sums) == 8 and max(sums) / min(sums) < 1.03
    assert {r["shard"] for r in kd_sharding.kd_shards(hot, ["doc_id"], target_bytes=sum(sums) // 3 + 1).select("shard").distinct().collect()} == {0, 1, 2}


def test_line_dedup(spark, odd, empty):
    few = odd.where("doc_id is null or doc_id < 6").withColumn("n_lines", F.lit("clash")).withColumn("h1", F.lit("clash"))
    found = line_dedup.dedup_lines(few)
    assert found.columns == ["kept", "text", "n_lines", "n_dropped"] and found.select("kept.*").columns == few.columns
    got = {(r["kept"]["doc_id"], r["n_lines"], r["n_dropped"], r["text"], r["kept"]["n_lines"]) for r in found.collect()}
    assert got == {
        (1, 2, 0, "A line that is long enough\nAnother line of the text", "clash"), (2, 2, 1, "something else here", "clash"), (None, 2, 1, "no id here at all", "clash"),
        (3, 1, 0, None, "clash"), (4, 1, 0, "", "clash"), (5, 2, 0, " \t\n", "clash"),
    }
    assert line_dedup.dedup_lines(empty).count() == 0
    folder = spark.range(1).select(F.lit("x").alias("text"), F.lit(1).alias("doc_id"))
    before = {t.name for t in spark.catalog.listTables()}
    line_dedup.dedup_lines(folder).collect()
    assert {t.name for t in spark.catalog.listTables()} == before


def test_line_keys_and_marks(spark):
    lines = [" \t\x0b\f\rÉA b\xa0 ", "ABC xyz", "\u0130I ", "", " \r"]
    df = spark.createDataFrame([(x,) for x in lines], "line string").select(line_dedup.line_key(F.col("line")).alias("key"))
    plain = [x.strip(" \t\n\x0b\f\r").translate({c: c + 32 for c in range(65, 91)}) for x in lines]
    assert [r["key"] for r in df.collect()] == plain
    marks = spark.createDataFrame([([0],), ([2, 3, 6],), ([1],)], "places array<int>").select(line_dedup.marks(F.col("places")).alias("m"))
    assert [[k for k, x in enumerate(r["m"]) if x] for r in marks.collect()] == [[0], [2, 3, 6], [1]]


def test_line_dedup_of_very_many_lines(spark):
    """Texts of 200,000 lines, all of them lost in the second: linear work."""
    text = "\n".join(f"line number {k:09d}" for k in range(200_000))
    df = spark.createDataFrame([(1, text), (2, text), (2, "a line of its own"), (2, "a line of its own")], "doc_id long, text string")
    got = sorted((r["kept"]["doc_id"], r["n_lines"], r["n_dropped"], len(r["text"])) for r in line_dedup.dedup_lines(df).collect())
    assert got == [(1, 200_000, 0, len(text)), (2, 1, 0, 17), (2, 1, 0, 17), (2, 200_000, 200_000, 0)]


def test_simhash(spark, odd, empty):
    rows = simhash_dedup.near_duplicates(odd).collect()
    assert len(rows) == 10 and all(r["print"] == 0 and r["component_id"] == 3 for r in rows if r["doc_id"] in (3, 4, 5))
    assert {r["component_id"] for r in rows if r["doc_id"] in (6, 7)} == {6}
    kept = simhash_dedup.dedup(odd)
    assert kept.columns == odd.columns and sorted(str(r["doc_id"]) for r in kept.select("doc_id").collect()) == ["1", "2", "3", "6", "8", "None"]
    assert simhash_dedup.near_duplicates(empty).count() == 0 and simhash_dedup.dedup(empty).count() == 0


def test_covering_masks_miss_no_pair():
    masks = simhash_dedup.covering_masks()
    rng = np.random.default_rng(3)
    for _ in range(3000):
        bits = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(not bits & m for m in masks)


@pytest.mark.parametrize("large", [8192, 5])
def test_links_of_dense_groups(spark, large):
    """Members by the hundred within few bits, with and without the way for large buckets."""
    rng = np.random.default_rng(5)
    prints = set()
    for centre in (0, -1, 1234567890123456789):
        for _ in range(60):
            prints.add(simhash_dedup.signed((centre % 2**64) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False))))
    df = spark.createDataFrame([(p,) for p in sorted(prints)], "print long")
    ws = common.Workspace(spark, "test")
    edges = simhash_dedup.links(ws, df, large=large)
    labels = {r["a"]: r["b"] for r in simhash_dedup.components(ws, edges).collect()}
    parent = {p: p for p in prints}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    ordered = sorted(prints)
    for k, a in enumerate(ordered):
        for b in ordered[k + 1 :]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 4:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert {p: labels.get(p, p) for p in prints} == {p: root(p) for p in prints}


@pytest.mark.parametrize("most", [1_000_000, 30])
def test_components_of_long_chains(spark, most):
    """Chains of shuffled ids over several partitions: right in one task or by stars, and in few jobs if one task can take them."""
    rng = np.random.default_rng(11)
    chains = rng.permutation(np.concatenate((np.arange(-150, 150), [-(2**63), 2**63 - 1]))).reshape(2, -1)
    pairs = [(int(max(x, y)), int(min(x, y))) for chain in chains for x, y in zip(chain, chain[1:], strict=False)]
    edges = spark.createDataFrame([pairs[i] for i in rng.permutation(len(pairs))], "a long, b long").repartition(8)
    context = spark.sparkContext
    context.setJobGroup("components", "")
    found = simhash_dedup.components(common.Workspace(spark, "test"), edges, *[most] * (most < 1_000_000))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(map(tuple, found.collect())) == sorted((int(x), int(min(chain))) for chain in chains for x in chain if x != min(chain))
    if most == 1_000_000:
        assert 0 < len(context.statusTracker().getJobIdsForGroup("components")) <= 6


def test_components_of_no_edges(spark):
    assert simhash_dedup.components(common.Workspace(spark, "test"), spark.createDataFrame([], "a long, b long")).count() == 0


def test_packing(odd, empty):
    path = best_fit_packing.tokenizer_path()
    rows = best_fit_packing.pack(odd, path).collect()
    assert {r["doc_id"] for r in rows} == {1, 2, 3, 4, 5, 6, 7, 8, None}
    assert [r["payload"] for r in rows if r["doc_id"] == 3] == [b"\x01\0\0\0"] and sum(r["doc_id"] == 2 for r in rows) == 2
    assert max(r["piece"] for r in rows if r["doc_id"] == 6) >= 10 and all(len(r["payload"]) == 4 * r["length"] for r in rows)
    assert best_fit_packing.pack(empty, path).count() == 0


def test_encoder_equals_the_tokenizer():
    encoder = best_fit_packing.Encoder(best_fit_packing.tokenizer_path())
    texts = ["", " ", "Word, word. WORD!! don't it's", "a\x1cb\tc\r\nd", "İstanbul ΣΑΣ ς é", "é É.", "a.b,c ..., x_. y", ".start ,", "日本語、テスト。", "w" * 300 + ", end.", "<|endoftext|> 123 4.5"]
    for _ in range(2):
        assert encoder.encode(texts) == encoder.ids(texts)
    best_fit_packing.CACHED, before = 3, best_fit_packing.CACHED
    try:
        assert encoder.encode(texts) == encoder.ids(texts) and encoder.encode(texts[::-1]) == encoder.ids(texts[::-1])
    finally:
        best_fit_packing.CACHED = before


def test_encoder_keeps_a_large_vocabulary(monkeypatch):
    encoder = best_fit_packing.Encoder(best_fit_packing.tokenizer_path())
    texts = [" ".join(f"w{k}" for k in range(low, low + 5000)) for low in range(0, 240_000, 5000)]
    before = [encoder.encode([t]) for t in texts]
    again = []
    monkeypatch.setattr(encoder, "learn", lambda words: again.extend(words) or dict.fromkeys(words, b""))
    assert [encoder.encode([t]) for t in texts] == before and not again


def test_mixing(odd, empty, spark):
    rows = source_mixing.systematic_mix(odd).collect()
    assert len(rows) == 10 and all(0 <= r["copies"] <= 2 for r in rows) and {r["kept"]["target"] for r in rows} == {"clash"}
    sums = {r["kept"]["source"]: (r["source_size"], r["target"]) for r in rows}
    assert abs(sum(t for _, t in sums.values()) - 1.5 * sum(n for n, _ in sums.values())) < 1e-6
    assert source_mixing.systematic_mix(empty, keep=["doc_id"]).count() == 0
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert sorted(source_mixing.mixed(docs).collect()) == sorted(source_mixing.mixed(docs.repartition(7)).collect())
    alike = spark.range(200).select(F.lit(None).cast("long").alias("doc_id"), F.lit("some words").alias("text"), F.lit("a").alias("source"), F.col("id").alias("other"))
    once, again = (sorted(r["kept"]["other"] for r in source_mixing.systematic_mix(d).where("copies > 1").collect()) for d in (alike, alike.repartition(5).orderBy(F.desc("other"))))
    assert once == again  # rows that differ in a kept column alone


def test_matroska(spark, odd, empty):
    stored = matroska.store(odd)
    assert matroska.payloads(stored).count() == 10 and matroska.packets(empty.select("doc_id", F.lit(b"").alias("media"))).count() == 0
    found = matroska.packets(stored).where("doc_id = 6").collect()
    cues = matroska.cues(stored).where("doc_id = 6").collect()
    assert len({r["cluster"] for r in found}) == len(cues) > 1 and {r["lacing"] for r in found} >= {1, 2}
    whole = matroska.write(b"x" * 9000)
    broken = spark.createDataFrame([(1, b"no file"), (2, None), (3, whole[:-50]), (4, whole), (4, whole)], "doc_id long, media binary").withColumn("track", F.lit("clash")).withColumn("error", F.lit("clash"))
    assert sorted({(r["doc_id"], r["error"] is None) for r in matroska.packets(broken).collect()}) == [(1, False), (3, False), (4, True)]
    back = {(r["doc_id"], r["payload"], r["error"] is None, r["feature"] is None) for r in matroska.payloads(broken.withColumn("n_bytes", F.lit(0).cast("long"))).collect()}
    assert back == {(1, None, False, True), (2, None, False, True), (3, None, False, True), (4, b"x" * 9000, True, False)}
    assert matroska.cues(broken).select("doc_id").distinct().count() == 1 and matroska.payloads(matroska.store(empty)).count() == 0


#: A file put together by hand from the format's description, apart from the writer here: an EBML header, one segment of unknown
#: size, scale 500,000 ns, track 2 of 10 ms frames; a cluster at 3 with a simple block (+1, key, EBML lacing: 2, 3 and 1 bytes), a
#: block group with a reference (no key frame) and one block of Xiph lacing (1 and 4 bytes); cues that name the cluster.
BY_HAND = bytes.fromhex(
    "1A45DFA3 84 428281 6D"  # header with a document type of one byte
    "18538067 01FFFFFFFFFFFFFF"
    "1549A966 87 2AD7B1 83 07A120"  # scale
    "1654AE6B 8F AE 8D D781 02 8381 11 23E383 83 989680"  # track 2, 10 ms
    "1F43B675 A4 E781 03"  # cluster, 36 bytes
    "A38D 82 0001 86 02 82 C0 AAAA BBBBBB CC"  # EBML lacing: 3 frames, first 2, then +1
    "A090 A18B 82 FFFF 02 01 01 DD EEEEEEEE FB81 FF"
    "1C53BB6B 8E BB8C B381 03 B787 F781 02 F182 0020"
)


def test_matroska_reads_a_file_made_by_hand():
    file = matroska.parse(BY_HAND)
    got = [(p.track, p.timestamp_ns, p.keyframe, p.lacing, BY_HAND[p.start : p.start + p.size].hex()) for p in file.packets]
    assert got == [
        (2, 2_000_000, True, 3, "aaaa"), (2, 12_000_000, True, 3, "bbbbbb"), (2, 22_000_000, True, 3, "cc"),
        (2, 1_000_000, False, 1, "dd"), (2, 11_000_000, False, 1, "eeeeeeee"),
    ]
    assert file.scale == 500_000 and len(file.clusters) == 1 and file.cues == [(1_500_000, 2, file.clusters[0])]
    assert BY_HAND[file.clusters[0] :].startswith(bytes.fromhex("1F43B675"))


def test_matroska_says_what_it_does_not_undo():
    m = matroska
    track = m.element(m.TRACKS, m.element(m.TRACK_ENTRY, m.unsigned(m.TRACK_NUMBER, 1) + m.element(m.CONTENT_ENCODINGS, b"")))
    cluster = m.element(m.CLUSTER, m.unsigned(m.TIMESTAMP, 0) + m.block(1, 0, [b"abc"], m.NO_LACING))
    assert m.played(m.element(m.EBML, b"") + m.element(m.SEGMENT, track + cluster), 1)[2] == "track 1 has content encodings"
    hidden = m.element(m.CLUSTER, m.element(m.ENCRYPTED_BLOCK, b"abc"))
    assert "encrypted" in m.played(m.element(m.EBML, b"") + m.element(m.SEGMENT, hidden), 1)[2]
    assert m.played(m.element(m.EBML, b""), 1) == (b"", "packets=0;clusters=0;cues=0;last_ms=0;lacing=0/0/0/0;mean=none;peak=none", None)


def test_matroska_lacing_and_unknown_sizes():
    m = matroska
    frames = [b"a" * 300, b"b" * 10, b"", b"c" * 700, b"d" * 5]
    for kind in (m.XIPH, m.EBML_LACING):
        body = m.unsigned(m.TIMESTAMP, 7) + m.block(1, -2, frames, kind) + m.element(m.BLOCK_GROUP, m.element(m.BLOCK, b"\x82\x00\x03\x00zz") + m.unsigned(m.REFERENCE_BLOCK, 1))
        cluster = m.CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + body
        data = m.element(m.EBML, b"") + m.SEGMENT.to_bytes(4, "big") + b"\xff" + cluster + m.element(m.CLUSTER, m.unsigned(m.TIMESTAMP, 9))
        file = m.parse(data)
        assert [data[p.start : p.start + p.size] for p in file.packets] == [*frames, b"zz"]
        assert [(p.track, p.timestamp_ns, p.keyframe) for p in file.packets[-2:]] == [(1, 5_000_000, True), (2, 10_000_000, False)] and len(file.clusters) == 2


def test_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(k, [float(v) for v in rng.normal(size=8)]) for k in range(300)]
    rows += [(1000 + k, [3.0] * 8) for k in range(400)] + [(40, rows[40][1]), (60, [9.0] * 8), (2000, None), (2020, [0.0] * 8), (2040, [float("nan")] * 8), (2060, [None] * 8), (None, [1.0] * 8), (2080, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = additive_quantisation.search(df).toPandas()
    assert set(got.query_id) == {*range(0, 300, 20), *range(1000, 1400, 20)}
    good = {(k, tuple(v)) for k, v in rows if k is not None and k < 2000}
    asked = {q: min(v for k, v in good if k == q) for q in set(got.query_id)}
    for q, g in got.groupby("query_id"):
        want = sorted((-float(np.dot(asked[q], v)), k) for k, v in good if k != q)[:20]
        assert [k for _, k in want] == list(g.sort_values("rank").vec_id)
    assert additive_quantisation.search(df.limit(0)).count() == 0
    assert additive_quantisation.search(df.where("vec_id in (0, 1)")).count() == 1
    assert additive_quantisation.search(df.where("vec_id in (1, 2)")).count() == 0
    mixed = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0]), (2, [0.0, 1.0, 5.0])], "vec_id long, embedding array<float>").withColumn("unit", F.lit("clash")).withColumn("score", F.lit("clash"))
    assert [(r["vec_id"], r["score"]) for r in additive_quantisation.search(mixed).orderBy("rank").collect()] == [(2, 2.0), (1, 1.0)]


def test_quotation_links(spark):
    rows = [
        (1, 0, "user", "Hello there, how does this work?\nSecond line of the first message."),
        (1, 1, "assistant", "> Hello there, how does this work?\nIt works by the well known mechanism."),
        (1, 2, "user", ">> Hello there, how does this\n>> work?\n> It works by the well known mechanism.\nThanks a lot for this answer."),
        (1, 3, "assistant", "Unrelated remark that quotes nothing."),
        (1, 4, "user", "> second   line of the first message.\nI meant this line here, please."),
        (1, 5, "user", "> Unrelated remark\n> that quotes nothing.\nNo: parted otherwise, yet the same."), (1, 6, "user", "Yes."), (1, 7, "user", "> yes.\nShort messages are linked whole."),
        (2, 0, None, None), (2, 1, "x", ""), (None, 0, "a", "> > >"), (None, 0, "a", "> > >"), (None, None, "a", "no turn at all here"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("position", F.lit(1)).withColumn("unit", F.lit(1))
    got = quotation_links.link(df).collect()
    first = sorted((r["position"], r["turn"], r["reply_to"], r["text"]) for r in got if r["conv_id"] == 1)
    assert [x[1:3] for x in first] == [(0, None), (1, 0), (4, 0), (2, 1), (3, None), (5, 3), (6, None), (7, 6)]
    assert first[3][3] == "Thanks a lot for this answer."
    assert sorted(r["position"] for r in got if r["conv_id"] is None) == [0, 1, 2]
    assert quotation_links.link(df.limit(0)).count() == 0


def test_fixed_values():
    assert zlib.crc32(b"") == 0 and re.compile(common.WORD).findall("a\x0bb\x1cc") == ["a", "b\x1cc"]
