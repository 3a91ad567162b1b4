"""Every operator's query against SQL or a plain version, on the small tables."""

import array
import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash
from helpers import DATA, rows_of

from docquarry.llm import additive_quantisation, best_fit_packing, kd_sharding, language_id, matroska, registry, secret_scan, simhash_dedup


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_query_matches_its_sql(spark, duck, name):
    got = registry.queries()[name](spark, DATA).toPandas()
    want = duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows_of(got) == rows_of(want)


def test_language_id_on_held_out_documents(spark, duck):
    got = language_id.query(spark, DATA).toPandas()
    lang = dict(duck.execute("SELECT doc_id, lang FROM documents").fetchall())
    assert set(got.doc_id) == set(lang) and (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    held = got[got.held_out]
    assert sum(lang[r.doc_id] == r.lang_pred for r in held.itertuples()) >= 0.95 * len(held)
    assert got.score.between(0, 1).all() and not got.rejected.any()


def base_spans(text):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found)


def test_secret_scan_base(spark, texts):
    got = secret_scan.query(spark, DATA).toPandas()
    for r in got.itertuples():
        found = base_spans(texts[r.doc_id])
        listed = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in found)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == j for _, k, _ in found) for j in range(3)]
        assert set(filter(None, listed.split(","))) <= set(r.spans.split(","))


def test_kd_shards(spark, texts):
    got = kd_sharding.query(spark, DATA).toPandas()
    assert {r.doc_id: (r.size, r.text_crc32) for r in got.itertuples()} == {i: (len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in texts.items()}
    sums = got.groupby("shard")["size"].sum()
    assert list(sums.index) == list(range(8)) and sums.max() / sums.min() < 1.05
    assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard")["slot"])
    assert (got.groupby(["size", "text_crc32"])["shard"].nunique() == 1).all()


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.translate({c: c + 32 for c in range(65, 91)}))
    hashed = [xxhash.xxh64_intdigest(" ".join(words[k : k + 4]).encode(), seed=42) for k in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashed) * 2 > len(hashed))


def components(ids, prints, radius):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


def test_simhash_components(spark, texts):
    got = simhash_dedup.query(spark, DATA).toPandas()
    prints = {i: plain_print(t) for i, t in texts.items()}
    assert {r.doc_id: int(r.fingerprint, 16) for r in got.itertuples()} == prints
    assert dict(zip(got.doc_id, got.component_id, strict=True)) == components(sorted(prints), prints, 4)


def test_matroska_round_trip(spark, texts):
    for r in matroska.query(spark, DATA).toPandas().itertuples():
        n, payload = matroska.padded(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    got = best_fit_packing.query(spark, DATA).toPandas()
    tokenizer = Tokenizer.from_file(best_fit_packing.tokenizer_path())
    want = {}
    for i, t in texts.items():
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            want[i, k // 4096] = (k, len(ids[k : k + 4096]), zlib.crc32(array.array("I", ids[k : k + 4096]).tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got.itertuples()} == want
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 4096
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 4096) + 1


def test_search_recall(spark, duck):
    got = additive_quantisation.query(spark, DATA).toPandas()
    e = duck.execute("SELECT vec_id, embedding FROM embeddings ORDER BY vec_id").df()
    ids, x = e.vec_id.to_numpy(), np.stack(e.embedding).astype(float)
    hits = 0
    for q, g in got.groupby("query_id"):
        scores = x @ x[ids == q][0]
        others = [(-s, i) for s, i in zip(scores, ids, strict=True) if i != q]
        hits += len({i for _, i in sorted(others)[:20]} & set(g.vec_id))
        g = g.sort_values("rank")
        assert list(g["rank"]) == list(range(1, 21)) and np.allclose(g.score, [scores[ids == i][0] for i in g.vec_id], rtol=0, atol=1e-12)
        assert sorted(zip(-g.score, g.vec_id, strict=True)) == list(zip(-g.score, g.vec_id, strict=True))
    assert set(got.query_id) == {i for i in ids if i % 20 == 0} and hits >= 0.9 * len(got)


def test_plans_pack_any_histogram():
    rng = np.random.default_rng(1)
    for n in (1, 30, 3000):
        counts = collections.Counter(int(x) for x in np.clip(rng.lognormal(6.5, 1, n), 1, 4096))
        plan = best_fit_packing.plan_packing(dict(counts))
        loads = collections.Counter()
        for length, low, high, first, _ in plan.places:
            for k in range(high - low):
                loads[first + k] += length
        assert not any(plan.left.values()) and max(loads.values()) <= 4096 and sum(loads.values()) == sum(k * v for k, v in counts.items())
        assert plan.sequences <= -(-sum(loads.values()) // 4096) * 1.02 + 1
