"""Cases in which an operator once did less than the whole job."""

import re

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from helpers import DATA, rows_of
from pyspark.sql import functions as F

from docquarry.llm import additive_quantisation, common, jaccard_dedup, kd_sharding, language_id, quotation_links, secret_scan, simhash_dedup


def recall(scores, found):
    return np.mean([len(set(np.argsort(-s)[:20]) & set(f)) / 20 for s, f in zip(scores, found, strict=True)])


def test_search_answers_through_its_codes():
    """30,000 clustered and isotropic vectors: 0.3 % of them are reranked; without the codes' order recall is lost."""
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(size=(20_000, 64)), rng.normal(size=(100, 64)).repeat(100, 0) + 0.5 * rng.normal(size=(10_000, 64))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    books = additive_quantisation.train(x[rng.permutation(len(x))[:8192]], n_books=16)
    table = pa.table([pa.array(list(x), pa.list_(pa.float64())), pa.array([[k] for k in range(len(x))])], names=["vector", "members"])
    rows = pa.Table.from_batches(additive_quantisation.encode_rows(books)(table.combine_chunks().to_batches()))
    codes, scale = np.frombuffer(b"".join(rows["codes"].to_pylist()), np.uint8).reshape(len(x), -1), rows["scale"].to_numpy()
    q = x[:: len(x) // 150]
    scores = q @ x.T
    depth = additive_quantisation.RERANK
    query, row, near = additive_quantisation.scan(q, codes, scale, books, depth)
    found = [row[query == k] for k in range(len(q))]
    plain = (additive_quantisation.decode(codes, books) * scale[:, None]) @ q.T.astype(np.float32)
    assert all(len(f) == depth for f in found) and np.allclose(near, plain[row, query], atol=1e-4)
    assert all(plain[f, k].min() >= np.sort(plain[:, k])[-depth] - 1e-4 for k, f in enumerate(found))  # no row is cut too early
    assert recall(scores, found) >= 0.9
    query, row, _ = additive_quantisation.scan(q, codes[rng.permutation(len(x))], scale, books, depth)
    assert recall(scores, [row[query == k] for k in range(len(q))]) < 0.1


def test_grid_grows_with_the_pairs():
    for n, q in ((1, 1), (500, 25), (51_282, 2565), (10**8, 5 * 10**6)):
        rows, queries = additive_quantisation.grid(n, q)
        assert 1 <= rows <= n and 1 <= queries <= q and n * q / (rows * queries) <= additive_quantisation.CELL


def shingle_set(text):
    words = text.encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def test_pipeline_keeps_one_of_each_similar_group(spark):
    """Copies with a few changed words, on both sides of a similarity of 0.8, against brute force."""
    rng = np.random.default_rng(4)
    rows, i = [], 0
    for n_changes in (1, 1, 2, 2, 3, 3, 4, 6) * 6:
        base = [f"w{x}" for x in rng.integers(0, 10**6, 150)]
        for _ in range(3):
            words = list(base)
            for at in rng.choice(150, n_changes, replace=False):
                words[at] = f"Changed{rng.integers(10**6)}"
            rows.append((i, " ".join(words)))
            i += 1
    rows += [(1000 + k, t) for k, t in enumerate(["", " ", "two words", "TWO  words", "other words", "a b c d e"])] + [(1010, None), (None, "a b c d e")]
    sets = [shingle_set(t or "") for _, t in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for k in range(len(rows)):
        for o in range(k):
            both = len(sets[k] & sets[o])
            if sets[k] == sets[o] or both * 5 >= 4 * (len(sets[k] | sets[o])):
                x, y = sorted((root(k), root(o)))
                parent[y] = x
    want = [rows[k][0] for k in range(len(rows)) if root(k) == k]
    assert 40 < len(want) < len(rows) - 20
    docs = spark.createDataFrame([(d, t, "en", "a", 0) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [r["doc_id"] for r in corpus_pipeline.dedup_documents(spark, docs, DATA).collect()]
    assert sorted(got) == sorted(want)


def test_pipeline_links_by_fingerprints_too(spark):
    """Texts that share a passage many times have near fingerprints, but sets of a similarity far under 0.8."""
    rng = np.random.default_rng(6)
    rows = []
    for _ in range(6):
        passage = " ".join(f"p{x}" for x in rng.integers(0, 10**6, 40))
        rows += [" ".join([*[passage] * 40, *(f"t{x}" for x in rng.integers(0, 10**6, 80))]) for _ in range(3)]
        base = [f"w{x}" for x in rng.integers(0, 10**6, 150)]
        rows += [" ".join([*base[:at], "other", *base[at + 1 :]]) for at in (20, 70, 120)]
    rows += [rows[0].upper(), "", None, "two words"]
    n = len(rows)
    prints, sets = [simhash_dedup.fingerprint(t) for t in rows], [shingle_set(t or "") for t in rows]
    by_print = [[(prints[a] ^ prints[b]) % 2**64 for b in range(n)] for a in range(n)]
    by_print = [[x.bit_count() <= 4 for x in line] for line in by_print]
    by_set = [[sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) for b in range(n)] for a in range(n)]

    def kept(near):
        label = list(range(n))
        for _ in range(n):
            for a in range(n):
                label[a] = min(label[b] for b in range(n) if near[a][b])
        return sorted(set(label))

    want = kept([[x or y for x, y in zip(*lines, strict=True)] for lines in zip(by_print, by_set, strict=True)])
    assert set(want) < set(kept(by_print)) and set(want) < set(kept(by_set))
    docs = spark.createDataFrame([(k, t, "en", "a", 0) for k, t in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.dedup_documents(spark, docs, DATA).collect()) == want
    linked = {r["doc_id"]: r["component_id"] for r in simhash_dedup.near_duplicates(docs).collect()}
    assert len({linked[k] for k in want}) == len(want)  # one at most of each of op4's components


@pytest.mark.parametrize("cell", [10**6, 1500])
def test_links_of_a_group_about_the_threshold(spark, cell):
    """Copies of one text with changes of their own, many pairs of which are just under 0.8, in one cell and in blocks."""
    rng = np.random.default_rng(9)
    base, rows = [f"w{x}" for x in range(120)], []
    for i in range(120):
        words = list(base)
        for at in rng.choice(120, int(rng.integers(1, 5)), replace=False):
            words[at] = f"c{rng.integers(10**6)}"
        rows.append((i, " ".join(words)))
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for k in range(len(rows)):
        for o in range(k):
            both = len(sets[k] & sets[o])
            if both * 5 >= 4 * len(sets[k] | sets[o]):
                x, y = sorted((root(k), root(o)))
                parent[y] = x
    ws = common.Workspace(spark, "group")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = [r["text"] for r in docs.collect()]
    found = [jaccard_dedup.shingles(t) for t in texts]
    prints = [int(np.uint64(xxhash.xxh64_intdigest(s.tobytes())).view(np.int64)) for s in found]
    frame = spark.createDataFrame([(k, p, len(s), jaccard_dedup.band_keys(s).tolist(), t) for k, (p, s, t) in enumerate(zip(prints, found, texts, strict=True))], "_rid long, print long, size int, keys array<long>, text string")
    edges = jaccard_dedup.links(ws, ws.save(frame, "frame"), cell)
    labels = {r["a"]: r["b"] for r in simhash_dedup.components(ws, edges).collect()}
    got = [labels.get(p, p) for p in prints]
    assert {tuple(k for k in range(120) if got[k] == g) for g in set(got)} == {tuple(k for k in range(120) if root(k) == g) for g in {root(k) for k in range(120)}}
    assert 1 < len(set(got)) < 120


def test_ordinary_words_come_from_all_documents(spark):
    docs = spark.range(4100).selectExpr("id AS doc_id", "concat('word', id) AS text")
    assert secret_scan.ordinary_words(docs).distinct().count() == 4100


def test_large_buckets_lose_no_link_at_an_odd_radius(spark):
    p, q = 0b111100000, 0b111100111  # for each of their midpoints a smaller member is too far from one of them
    prints = [p, q, *(p ^ 1 << i ^ 0b110000000 for i in range(3)), *(q ^ 1 << i ^ 0b001100000 for i in range(3))]
    ws = common.Workspace(spark, "odd")
    members = spark.createDataFrame([(0, p) for p in prints], "v int, print long")
    edges = simhash_dedup.midpoint_edges(ws, members, [~0b111111111 % 2**64], 3)
    found = {r["print"]: r["print"] for r in members.collect()} | {r["a"]: r["b"] for r in simhash_dedup.components(ws, edges).collect()}
    parent = {p: p for p in prints}
    for _ in prints:
        for a in prints:
            for b in prints:
                if (a ^ b).bit_count() <= 3:
                    parent[a] = parent[b] = min(parent[a], parent[b])
    assert found == parent


def test_secret_scan_of_very_many_matches(spark):
    """100,000 keys in one text: linear work."""
    text = " ".join(f"{k:016x}" for k in range(100_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = secret_scan.spans(df, [0.0] * 128**2, ["doc_id"]).selectExpr("size(found) AS n", "found[99999] AS last").first()
    assert found["n"] == 100_000 and (found["last"]["start"], found["last"]["end"]) == (99_999 * 17, 99_999 * 17 + 16)


def test_added_secrets_are_those_of_a_plain_scorer(spark, duck):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = secret_scan.train(secret_scan.random_strings(spark), secret_scan.ordinary_words(docs))
    extra = ["see Kx9fQ2mZr7Lp0Wv8Tn3BaYc5 and some_ordinary_identifier_here", "x7Kq/Zt+9LmPw3Rv_Bn5Yc8D", "password: Kx9fQ2mZr7Lp0Wv8Tn3BaYc5 zZ9qQ7xX1vV3bB5nN8mM"]
    more = spark.createDataFrame([(-k, t) for k, t in enumerate(extra, 1)], "doc_id long, text string")
    texts = dict(duck.execute("SELECT doc_id, text FROM documents").fetchall()) | {-k: t for k, t in enumerate(extra, 1)}
    got = {r["doc_id"]: r["found"] for r in secret_scan.spans(docs.select("doc_id", "text").unionAll(more), model, ["doc_id"]).select("kept.doc_id", "found").collect()}
    flagged = 0
    for i, text in texts.items():
        base = [(s["start"], s["end"]) for s in got[i] if s["base"]]
        want = set()
        for m in re.finditer(secret_scan.CANDIDATE, text):
            codes = [0, *map(ord, m[0])]
            nats = sum(model[a * 128 + b] for a, b in zip(codes, codes[1:], strict=False))
            near = (nats - secret_scan.LEAST_NATS, nats - secret_scan.LEAST_RATE * len(m[0]))
            if min(near) >= 0 and not any(a < m.end() and m.start() < b for a, b in base):
                want.add((m.start(), m.end()))
        assert {(s["start"], s["end"]) for s in got[i] if not s["base"]} == want
        flagged += len(want)
    assert flagged >= 3


def test_language_id_is_the_nearest_centroid(spark, duck):
    """Predictions against a plain classifier over dense vectors, from the fitted centroids."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = language_id.fit(docs.selectExpr("cast(doc_id AS string) AS id", "text", "lang"))
    features = language_id.Features()
    got = {r["doc_id"]: r for r in language_id.identify(docs, ["doc_id", "text"], model).select("kept.doc_id", "lang_pred", "score").collect()}
    for i, text in duck.execute("SELECT doc_id, text FROM documents").fetchall():
        at, n = features.counts(text)
        dense = np.zeros(language_id.DIMENSIONS)
        dense[at] = np.log1p(n) * model.idf[at]
        cosines = dense @ model.centroids / np.linalg.norm(dense) / np.linalg.norm(model.centroids, axis=0)
        assert abs(got[i]["score"] - cosines.max()) < 1e-4
        if np.sort(cosines)[-1] - np.sort(cosines)[-2] > 1e-4:
            assert got[i]["lang_pred"] == model.languages[model.of[np.argmax(cosines)]]


def test_language_id_learns_every_language(spark):
    """600 languages of a few documents each, and a hot one."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(f"{k}-{i}", " ".join(letters[(k * 7 + j * (1 + k % 11)) % 26] + letters[(k + j) % 26] + letters[k // 26 % 26] for j in range(40)), f"l{k:03d}") for k in range(600) for i in range(2)]
    learn = spark.createDataFrame(rows + [(None, "the same text again", "hot")] * 3000, "id string, text string, lang string")
    model = language_id.fit(learn, per_language=50)
    assert len(model.languages) == 601


def shares(rows, leaves):
    """A plain k-d tree's leaf weights, for groups (weight, keys) of which none is heavy."""
    if leaves == 1:
        return [sum(w for w, _ in rows)]
    axis = max(range(3), key=lambda a: (max(k[a] for _, k in rows) - min(k[a] for _, k in rows)) / shares.full[a])
    half, run, low = leaves // 2 / leaves * sum(w for w, _ in rows), 0, []
    ordered = sorted(rows, key=lambda r: r[1][axis])
    while ordered and run + ordered[0][0] / 2 < half:
        run += ordered[0][0]
        low.append(ordered.pop(0))
    return shares(low, leaves // 2) + shares(ordered, leaves - leaves // 2)


def test_sharding_is_a_small_plain_tree(spark):
    docs = spark.range(6000).selectExpr("id AS doc_id", "repeat(concat('word', id, ' '), cast(1 + id % 13 AS int)) AS text", "concat('s', id % 5) AS source", "concat('l', id % 3) AS lang")
    rows = kd_sharding.measured(docs, ["doc_id"])
    plain = [(r["size"], (r["k_size"], r["k_source"], r["k_lang"])) for r in rows.collect()]
    shares.full = [max(k[a] for _, k in plain) - min(k[a] for _, k in plain) for a in range(3)]
    got = [r["b"] for r in kd_sharding.kd_shards(docs, ["doc_id"]).groupBy("shard").agg(F.sum("size").alias("b")).orderBy("shard").collect()]
    want = shares(plain, 8)
    assert len(got) == 8 and all(abs(g - w) <= 0.01 * w for g, w in zip(got, want, strict=True))


def test_sharding_on_both_sides_of_the_cut(spark):
    """Equal texts of under half a shard stay together; those of more are cut, so that sizes can be equal."""
    for share, together in ((0.05, True), (0.3, False)):
        docs = spark.range(4000).selectExpr("id AS doc_id", f"CASE WHEN id < {int(4000 * share)} THEN 'one and the same text' ELSE concat('a text of its own ', 1000 + id) END AS text", "'a' AS source", "'en' AS lang")
        got = kd_sharding.kd_shards(docs, ["doc_id"]).select("kept.doc_id", "size", "shard").toPandas()
        sums = got.groupby("shard")["size"].sum()
        assert sums.max() / sums.min() < 1.03 and (got[got.doc_id < int(4000 * share)].shard.nunique() == 1) == together


def test_quotes_at_several_depths(spark):
    """Conversations in which turns quote earlier ones, one of them hot, against the query's SQL on the same rows."""
    import duckdb

    said = spark.read.parquet(f"{DATA}/conversations.parquet").where("text is not null").select(F.regexp_replace("text", "\n", " ").alias("text")).distinct().orderBy(F.xxhash64("text")).limit(400)
    texts = [r["text"] for r in said.collect()]
    rows, n = [], 0
    for conv in range(40):
        own = []
        for turn in range(120 if conv == 0 else 8):
            text, n = f"{texts[n % len(texts)]} {n}", n + 1
            if turn % 4 == 1:  # a long thread answers its first turn
                text = f"> {own[0].upper()}\n{text}"
            elif turn % 4 == 2:
                text = f">> {own[turn - 2].splitlines()[-1]}\n> {own[turn - 1].splitlines()[-1]}\n{text}\n\n> Nobody has said this before.\nEnd {n}."
            elif turn % 4 == 3 and turn > 4:
                text = f"{text}\n> > {own[turn - 3].splitlines()[-1]}"
            own.append(text)
            rows.append((conv, turn, ("user", "assistant")[turn % 2], text))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = quotation_links.link(df).toPandas()
    con = duckdb.connect()
    con.register("conversations", df.toPandas())
    want = con.execute(quotation_links.SQL).df()
    assert rows_of(got.fillna({"reply_to": -1}).astype({"reply_to": int})) == rows_of(want.fillna({"reply_to": -1}).astype({"reply_to": int}))
    assert got.n_linked.max() >= 2 and got.reply_to.notna().sum() > 150


def test_the_whole_pipeline_on_odd_rows(odd, empty, spark, tmp_path):
    clashing = odd.withColumns({c: F.lit("clash") for c in ("score", "rejected", "n_lines", "n_dropped", "copies", "taken", "source_size", "lost", "tie")})
    for given, name in ((clashing, "odd"), (clashing.limit(0), "none")):
        docs = given
        for k, (stage, f) in enumerate(corpus_pipeline.STAGES[:-1]):
            f(spark, docs, DATA).write.parquet(f"{tmp_path}/{name}{k}")
            docs = spark.read.parquet(f"{tmp_path}/{name}{k}")
            assert docs.columns == given.columns, stage
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
        assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in docs.collect()} and bool(packed) == (name == "odd")
