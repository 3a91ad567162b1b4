"""Near-duplicates by SimHash, as simhash_dedup links them, and by exact Jaccard similarity of five-word shingles.

Documents of equal shingle sets are one node. First come simhash_dedup's links of fingerprints, all of
them; then those of similar sets, most of which fingerprints miss. For these, a MinHash signature of
BANDS * WIDTH values picks the candidates: two nodes meet if all WIDTH values of a band are equal, so a
pair of similarity 0.8 is missed with a chance of (1 - 0.8 ** WIDTH) ** BANDS, about 3 in a million, and a
closer one with less. Each candidate is confirmed by the sets themselves: each node of a bucket is held
against the bucket's smallest; then, in buckets that all links so far leave in several components, all
nodes of different components meet, in tasks of about CELL shingles that return links alone, no more
than a tree of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.llm import simhash_dedup
from docquarry.llm.common import BROADCAST_ROWS, Workspace, hot_join, slices, with_row_id
from docquarry.llm.simhash_dedup import components, fingerprint, linked

SHINGLE, BANDS, WIDTH = 5, 32, 5
#: Similarity of a link, at least: 4 / 5.
PARTS, OF = 4, 5
#: Shingles that meet in a task, about: buckets of more are split into blocks, and their blocks meet in pairs.
CELL = 1_000_000
_made = np.random.default_rng(42)
FACTORS = _made.integers(0, 2**31, (BANDS * WIDTH, 1), np.uint32) * np.uint32(2) + np.uint32(1)
TERMS = _made.integers(0, 2**32, (BANDS * WIDTH, 1), np.uint32)
MIX = np.uint64(0x9E3779B97F4A7C15)


def fold(hashed: np.ndarray, more: np.ndarray) -> np.ndarray:
    mixed = (hashed ^ (hashed >> np.uint64(29))) * MIX + more
    return mixed ^ (mixed >> np.uint64(32))


def shingles(text: str | None) -> np.ndarray:
    """Sorted hashes of the different shingles; words as in simhash_dedup. A text of fewer words is one shingle."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    size = min(SHINGLE, len(words))
    n = len(words) - size + 1
    hashed = each[:n]
    for k in range(1, size):
        hashed = fold(hashed, each[k : k + n])
    return np.unique(fold(hashed, np.uint64(size)))


def band_keys(found: np.ndarray) -> np.ndarray:
    """A key for each band, none for an empty set."""
    if not len(found):
        return np.zeros(0, np.int64)
    short = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * WIDTH, 2**32 - 1, np.uint32)
    for low in range(0, len(short), 2048):
        np.minimum(least, (short[low : low + 2048] * FACTORS + TERMS).min(1), out=least)
    values, keys = least.astype(np.uint64).reshape(BANDS, WIDTH), np.zeros(BANDS, np.uint64)
    for k in range(WIDTH):
        keys = fold(keys, values[:, k])
    return keys.view(np.int64)


def add_keys(text_at: int, names: list[str]):
    def run(batches):
        for batch in slices(batches):
            sets = [shingles(t.as_py()) for t in batch.column(text_at)]
            prints = pa.array([int(np.int64(np.uint64(xxhash.xxh64_intdigest(s.tobytes())).view(np.int64))) for s in sets], pa.int64())
            keys = [band_keys(s) for s in sets]
            marks = pa.array([fingerprint(t.as_py()) for t in batch.column(text_at)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, prints, pa.array([len(s) for s in sets], pa.int32()), pa.array(keys, pa.list_(pa.int64())), marks], names)

    return run


def as_sets(batches):
    """(print, text) to (print, found): the hashes of the shingles."""
    for batch in slices(batches):
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t.as_py()).tobytes() for t in batch.column(1)], pa.binary())], ["print", "found"])


def similar(a: bytes, b: bytes) -> bool:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return OF * both >= PARTS * (len(x) + len(y) - both)


def confirmed(batches):
    """(a, b, in_a, in_b) to the pairs (a, b) that are similar."""
    for batch in batches:
        good = [similar(x.as_py(), y.as_py()) for x, y in zip(batch.column("in_a"), batch.column("in_b"), strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def fingerprint_links(ws: Workspace, rows: DataFrame) -> DataFrame:
    """Edges (a, b), a > b, over prints that connect what simhash_dedup links; rows has print and mark, its fingerprint, saved.

    The smallest print of each fingerprint stands for it.
    """
    each = ws.save(rows.select("print", "mark").distinct(), "marks")
    first = ws.save(each.groupBy("mark").agg(F.min("print").alias("first"), F.count(F.lit(1)).alias("n")), "first_prints")
    equal = hot_join(each, first, ["mark"], "n", each.count()).select("print", "first")
    near = simhash_dedup.links(ws, first.select(F.col("mark").alias("print")))
    uses = near.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    of_b = first.select(F.col("mark").alias("b"), F.col("first").alias("to")).join(uses, "b")
    of_a = first.select(F.col("mark").alias("a"), F.col("first").alias("print"))
    joined = hot_join(near, of_b, ["b"], "n", near.count()).join(of_a, "a").select("print", F.col("to").alias("first"))
    pairs = equal.unionAll(joined).where("print <> first")
    out = ws.save(pairs.select(F.greatest("print", "first").alias("a"), F.least("print", "first").alias("b")).distinct(), "fingerprint_links")
    ws.drop("marks", "first_prints", "buckets", "members", "middles", "edges")
    return out


def verify(ws: Workspace, pairs: DataFrame, texts: DataFrame, name: str) -> DataFrame:
    """Those of the saved pairs (a, b) that are similar; texts has _rid, print and text, and one row of each print is used."""
    needed = pairs.select(F.col("a").alias("print")).unionAll(pairs.select("b")).distinct()
    one = texts.select("_rid", "print").join(needed, "print", "left_semi").groupBy("print").agg(F.min("_rid").alias("_rid")).select("_rid")
    sets = ws.save(texts.join(one.hint("shuffle_hash"), "_rid", "left_semi").select("print", "text").mapInArrow(as_sets, "print long, found binary"), f"{name}_sets")
    counts = pairs.groupBy(F.col("b").alias("print")).agg(F.count(F.lit(1)).alias("n"))
    left = sets.select(F.col("print").alias("a"), F.col("found").alias("in_a")).join(pairs.hint("shuffle_hash"), "a")
    right = sets.join(counts.hint("shuffle_hash"), "print").select(F.col("print").alias("b"), F.col("found").alias("in_b"), "n")
    out = ws.save(hot_join(left, right, ["b"], "n", pairs.count()).select("a", "b", "in_a", "in_b").mapInArrow(confirmed, "a long, b long"), f"{name}_links")
    ws.drop(f"{name}_sets")
    return out


def tree(table: pa.Table) -> pa.Table:
    """(a, b), a > b, of links that join the components (label) of a cell's nodes (print, label, found), as far as they are similar."""
    table = table.sort_by("print").combine_chunks()
    prints, (_, of) = table["print"].to_numpy(), np.unique(table["label"].to_numpy(), return_inverse=True)
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["found"].combine_chunks()]
    sizes = np.array([len(x) for x in sets])
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    _, tokens = np.unique(np.concatenate(sets), return_inverse=True)
    mark, edges = np.zeros(tokens.max() + 1, np.int32), []
    for i in range(len(prints) - 1):
        if (of == of[0]).all():
            break
        if not (of[i + 1 :] != of[i]).any():
            continue
        own = tokens[starts[i] : starts[i] + sizes[i]]
        mark[own] = 1
        both = np.add.reduceat(mark[tokens[starts[i + 1] :]], starts[i + 1 :] - starts[i + 1])
        mark[own] = 0
        near = OF * both >= PARTS * (sizes[i] + sizes[i + 1 :] - both)
        for j in np.flatnonzero(near) + i + 1:
            if of[j] != of[i]:
                edges.append((int(prints[j]), int(prints[i])))
                of[of == of[j]] = of[i]
    return pa.table([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], names=["a", "b"])


def meetings(ws: Workspace, open_: DataFrame, cell: int = CELL) -> DataFrame:
    """v, key, low, high, print and label of the nodes that meet in each cell; open_ has v, key, print, size and label, saved.

    A bucket of few shingles is one cell. In others, the nodes of the largest component need not meet
    each other: blocks of the others meet all blocks, those of the largest one only the others'.
    """
    parts = open_.groupBy("v", "key", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("w"))
    tops = parts.groupBy("v", "key").agg(F.max_by("label", "w").alias("top"), F.max("w").alias("w_top"), F.sum("w").alias("w_all"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("labels"))
    tops = ws.save(tops.where("labels > 1").drop("labels"), "tops")
    placed = hot_join(open_, tops, ["v", "key"], "n", open_.count())
    blocks = lambda w: F.ceil(w * 2 / cell).cast("int")
    ours = F.greatest(blocks(F.col("w_top")), F.lit(1)).alias("ours")
    others = F.greatest(blocks(F.col("w_all") - F.col("w_top")), F.lit(1)).alias("others")
    placed = placed.select("v", "key", "print", "label", (F.col("w_all") <= cell).alias("one"), (F.col("label") == F.col("top")).alias("is_top"), ours, others)
    at = F.when(F.col("is_top"), F.pmod(F.xxhash64("print"), "ours")).otherwise(F.col("ours") + F.pmod(F.xxhash64("print"), "others")).cast("int")
    placed = placed.withColumn("block", F.when(F.col("one"), F.lit(0)).otherwise(at))
    last = F.col("ours") + F.col("others") - 1
    met = F.when(F.col("one"), F.array(F.lit(0))).when(F.col("is_top"), F.sequence(F.col("ours"), last)).otherwise(F.sequence(F.lit(0), last))
    return placed.select("v", "key", "print", "label", "block", F.explode(met).alias("other")).select("v", "key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "print", "label")


def links(ws: Workspace, texts: DataFrame, cell: int = CELL, known: DataFrame | None = None) -> DataFrame:
    """Edges (a, b), a > b, that connect what is similar; texts has _rid, print, size, keys and text, saved. Known edges are among them."""
    nodes = ws.save(texts.groupBy("print").agg(F.first("size").alias("size"), F.first("keys").alias("keys")), "sets")
    rows = nodes.select("print", "size", F.posexplode("keys").alias("v", "key"))
    buckets = rows.groupBy("v", "key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("print", "size")).alias("b"))
    buckets = ws.save(buckets.where("n > 1").select("v", "key", "n", F.col("b.print").alias("b"), F.col("b.size").alias("b_size")), "buckets")
    more = F.broadcast(buckets) if buckets.count() <= BROADCAST_ROWS else buckets
    members = ws.save(rows.join(more, ["v", "key"]), "members")
    could = lambda x, y: (F.least(x, y) * OF >= F.greatest(x, y) * PARTS)  # noqa: E731  sets of other sizes can't be similar
    pairs = ws.save(members.where("print > b").where(could(F.col("size"), F.col("b_size"))).select(F.col("print").alias("a"), "b").distinct(), "pairs")
    edges = verify(ws, pairs, texts, "first")
    edges = components(ws, edges.unionAll(known) if known else edges)
    labels = edges.select(F.col("a").alias("print"), F.col("b").alias("label"))
    open_ = members.where("n > 2").select("v", "key", "print", "size").join(labels, "print", "left").withColumn("label", F.coalesce("label", "print"))
    open_ = ws.save(open_, "open")
    met = ws.save(meetings(ws, open_, cell), "met")
    uses = met.groupBy("print").agg(F.count(F.lit(1)).alias("n"))
    one = texts.select("_rid", "print").join(uses.hint("shuffle_hash"), "print").groupBy("print").agg(F.min("_rid").alias("_rid"), F.first("n").alias("n"))
    found = texts.join(one.select("_rid").hint("shuffle_hash"), "_rid", "left_semi").select("print", "text").mapInArrow(as_sets, "print long, found binary")
    found = ws.save(found.join(one.select("print", "n").hint("shuffle_hash"), "print"), "met_sets")
    cells = hot_join(met, found, ["print"], "n", met.count())
    more = cells.groupBy("v", "key", "low", "high").applyInArrow(tree, "a long, b long").distinct()
    out = ws.save(edges.unionAll(more), "edges")
    ws.drop("sets", "buckets", "members", "pairs", "open", "tops", "met", "met_sets", "stars", "first_links", "fingerprint_links")
    return out


def dedup(docs: DataFrame, ws: Workspace | None = None) -> DataFrame:
    """docs with one row of each component of documents linked by fingerprints or similar sets: the first of its smallest doc_id.

    docs needs doc_id and text. Null and blank texts have one empty set, similar to no other, and fingerprint 0.
    """
    ws = ws or Workspace(docs.sparkSession, "dedup")
    names = [f"_{i}" for i in range(len(docs.columns))]
    named = docs.select(*[docs[c].alias(n) for c, n in zip(docs.columns, names, strict=True)])
    schema = T.StructType([*named.schema.fields, T.StructField("print", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("mark", T.LongType())])
    kept = ws.save(with_row_id(named.mapInArrow(add_keys(docs.columns.index("text"), schema.names), schema)), "documents")
    known = fingerprint_links(ws, kept)
    edges = links(ws, kept.select("_rid", "print", "size", "keys", F.col(names[docs.columns.index("text")]).alias("text")), known=known)
    prints = kept.select("_rid", F.col(names[docs.columns.index("doc_id")]).alias("doc_id"), "print")
    chosen = linked(ws, prints, edges=edges).select(F.col("keep").alias("_rid")).distinct()
    return kept.join(chosen.hint("shuffle_hash"), "_rid", "left_semi").select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)])
