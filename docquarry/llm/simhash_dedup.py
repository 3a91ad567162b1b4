"""Near-duplicates by SimHash with covering locality-sensitive hashing.

Every bit of a fingerprint has a non-zero vector of RADIUS + 1 bits; for each such vector v there is
a table that keeps the bits whose vector has an odd inner product with v. The vectors of RADIUS
differing bits can't span the space, so some v is orthogonal to all of them: its table drops just
these bits and the pair collides there. Hence no link is lost. Equal fingerprints are one node. A
bucket of two is a candidate pair; a larger one is turned into a spanning forest of its links, never
into all pairs. Of buckets above LARGE, members meet at shared midpoints: two fingerprints differ in at
most 2 * h bits just if flipping at most h bits of each can make them equal, so every midpoint links
its members to its smallest one, in linear work without a bucket-sized task.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.llm.common import BROADCAST_ROWS, Workspace, hot_join, slices, with_row_id

NAME = "op4_simhash_dedup"
SQL = None  # SQL has no XXH64: held against brute force in the tests

SHINGLE, RADIUS, BITS = 4, 4, 64
#: The most members of a bucket that one task links directly.
LARGE = 8192
#: The most edges whose components one task finds.
FOREST = 1_000_000


def covering_masks(bits: int = BITS, radius: int = RADIUS) -> list[int]:
    vectors = 2 ** (radius + 1) - 1
    odd = [[i for i in range(bits) if ((1 + i % vectors) & v).bit_count() & 1] for v in range(1, vectors + 1)]
    return [sum(1 << i for i in kept) for kept in odd]


def signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """bytes.lower() and bytes.split() know exactly the letters and the white space of ASCII."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashed, digest = [], xxhash.xxh64_intdigest
    ones, n = np.zeros(BITS, np.int64), max(1, len(words) - shingle + 1)
    for low in range(0, n, 65536):
        hashed = [digest(b" ".join(words[i : i + shingle]), 42) for i in range(low, min(n, low + 65536))]
        ones += np.unpackbits(np.array(hashed, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def add_fingerprints(text_at: int, names: list[str]):
    def run(batches):
        for batch in slices(batches):
            prints = pa.array([fingerprint(t.as_py()) for t in batch.column(text_at)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, prints], names)

    return run


def with_fingerprint(docs: DataFrame, text_at: int, name: str = "_print") -> DataFrame:
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())])
    return docs.mapInArrow(add_fingerprints(text_at, schema.names), schema)


def spanning_forest(prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(member, smallest member) of each linked set: a search that only looks at members not yet reached."""
    rest, edges = np.unique(prints), []
    while len(rest) > 1:
        root, rest, queue = rest[0], rest[1:], [rest[0]]
        while queue and len(rest):
            near = np.bitwise_count((rest ^ queue.pop()).view(np.uint64)) <= radius
            if near.any():
                found = rest[near]
                rest = rest[~near]
                queue += list(found)
                edges += [(int(x), int(root)) for x in found]
    return edges


def bucket_edges(radius: int):
    def run(batches):
        for batch in batches:
            edges = {e for prints in batch.column(0) for e in spanning_forest(prints.values.to_numpy(zero_copy_only=False), radius)}
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def links(ws: Workspace, nodes: DataFrame, radius: int = RADIUS, large: int = LARGE) -> DataFrame:
    """Edges (a, b), a > b, over different fingerprints (column print) that connect what is linked within radius."""
    spark = ws.spark
    masks = covering_masks(BITS, radius)
    tables = F.posexplode(F.array(*[F.lit(signed(m)) for m in masks])).alias("v", "mask")
    rows = nodes.select("print", tables).select("v", F.col("print").bitwiseAND(F.col("mask")).alias("key"), "print")
    buckets = rows.groupBy("v", "key").agg(F.count(F.lit(1)).alias("n"), F.min("print").alias("b"), F.max("print").alias("a"))
    buckets = ws.save(buckets.where("n > 1"), "buckets")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    edges = buckets.where("n = 2").where(near).select("a", "b")
    n_more, most = buckets.where("n > 2").agg(F.count(F.lit(1)), F.max("n")).first()
    if n_more:
        more = buckets.where("n > 2").select("v", "key", "n")
        more = F.broadcast(more) if n_more <= BROADCAST_ROWS else more
        members = ws.save(rows.join(more, ["v", "key"]), "members")
        lists = members.where(F.col("n") <= large).groupBy("v", "key").agg(F.collect_list("print").alias("prints"))  # large at most
        edges = edges.unionAll(lists.select("prints").mapInArrow(bucket_edges(radius), "a long, b long"))
        if most > large:
            edges = edges.unionAll(midpoint_edges(ws, members.where(F.col("n") > large), masks, radius))
    return ws.save(edges.distinct(), "edges")


def midpoint_edges(ws: Workspace, members: DataFrame, masks: list[int], radius: int) -> DataFrame:
    """Edges of the members (v, print) of large buckets, whose pairs differ in no bit that v's table keeps."""
    flips = []
    for v, mask in enumerate(masks):
        free = [1 << i for i in range(BITS) if not mask >> i & 1]
        flips.append((v, [signed(sum(c)) for k in range(-(-radius // 2) + 1) for c in combinations(free, k)]))
    each = ws.spark.createDataFrame(flips, "v int, flips array<long>")  # a row for each table
    middles = members.select("v", "print").join(F.broadcast(each), "v").select("print", F.explode("flips").alias("flip"))
    middles = ws.save(middles.select("print", F.col("print").bitwiseXOR(F.col("flip")).alias("middle")).distinct(), "middles")
    # one side of a link flips floor(radius / 2) bits, so that all members of a midpoint are within radius of b
    close = F.bit_count(F.col("print").bitwiseXOR(F.col("middle"))) <= radius // 2
    meet = middles.groupBy("middle").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(close, F.col("print"))).alias("b")).where("n > 1")
    met = hot_join(middles, meet, ["middle"], "n", middles.count()).where("print <> b").select(F.greatest("print", "b").alias("a"), F.least("print", "b").alias("b"))
    return met.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def star(edges: DataFrame, total: int, large: bool) -> DataFrame:
    """One large-star or small-star step on edges (a, b), a > b; the result has the same form."""
    pairs = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        pairs = pairs.unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    joined = hot_join(pairs, least, ["u"], "n", 2 * total)
    if large:
        moved = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def forest(edges: list[pa.RecordBatch]) -> pa.RecordBatch:
    """(a, b) for every node but the smallest of its component among these edges (a, b), which b is."""
    a, b = (np.concatenate([x.column(k).to_numpy() for x in edges]) for k in (0, 1))
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while len(x):
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        np.minimum.at(root, high, low)
        while (root != (further := root[root])).any():
            root = further
        apart = root[x] != root[y]
        x, y = x[apart], y[apart]
    moved = root != np.arange(len(nodes))
    return pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[root[moved]])], ["a", "b"])


def forests(most: int):
    """Edges to the forests of each run of them: one forest for each task, if it has no more than `most`."""

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n > most:
                yield forest(held)
                held, n = [], 0
        if n:
            yield forest(held)

    return run


def components(ws: Workspace, edges: DataFrame, most: int = FOREST) -> DataFrame:
    """(a, b) for every node but the smallest of its component, which b is.

    Each task turns its edges into a forest. If no more than `most` are left, one task joins these;
    else alternating large and small stars do, in many more stages.
    """

    def signature(df: DataFrame):
        n, check = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0))).first()
        return n, check

    edges = ws.save(edges.select("a", "b").mapInArrow(forests(most), "a long, b long"), "stars/forests")
    now, k = signature(edges), 0
    if now[0] <= most:
        return ws.save(edges.coalesce(1).mapInArrow(forests(most), "a long, b long"), "stars/joined")
    while now[0]:
        moved = ws.save(star(edges, now[0], large=True), f"stars/large{k}")
        edges = ws.save(star(moved, now[0], large=False), f"stars/small{k}")
        before, now, k = now, signature(edges), k + 1
        if now == before:
            break
    return edges


def linked(ws: Workspace, prints: DataFrame, radius: int = RADIUS, edges: DataFrame | None = None) -> DataFrame:
    """A row for each fingerprint: print, n, component_id (smallest doc_id), keep (row of that document).

    prints has _rid, doc_id and print, saved. Edges (a, b), a > b, take the place of the links within radius.
    """
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_rid")
    nodes = ws.save(prints.groupBy("print").agg(F.count(F.lit(1)).alias("n"), F.min(first).alias("first")), "nodes")
    labels = components(ws, links(ws, nodes, radius) if edges is None else edges).select(F.col("a").alias("print"), F.col("b").alias("label"))
    labelled = ws.save(nodes.join(labels, "print", "left").withColumn("label", F.coalesce("label", "print")), "labelled")
    sums = labelled.groupBy("label").agg(F.min("first").alias("chosen"), F.count(F.lit(1)).alias("members"))
    out = hot_join(labelled, sums, ["label"], "members", labelled.count())
    out = ws.save(out.select("print", "n", F.col("chosen.doc_id").alias("component_id"), F.col("chosen._rid").alias("keep")), "linked")
    ws.drop("nodes", "buckets", "members", "middles", "edges", "stars", "labelled")
    return out


def near_duplicates(docs: DataFrame, radius: int = RADIUS, ws: Workspace | None = None) -> DataFrame:
    """doc_id, print (signed 64-bit fingerprint) and component_id of every row of docs.

    docs needs doc_id and text; other columns are not looked at. Null and blank texts have fingerprint
    0, which links like any other. component_id is the smallest id of the component, null ids
    being the last. Repeated rows are kept; an empty table gives no rows.
    """
    ws = ws or Workspace(docs.sparkSession, "simhash")
    named = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))
    prints = with_fingerprint(named, 1, "print").select("doc_id", "print")
    prints = ws.save(with_row_id(prints), "prints")
    return hot_join(prints, linked(ws, prints, radius), ["print"], "n", prints.count()).select("doc_id", "print", "component_id")


def dedup(docs: DataFrame, radius: int = RADIUS, ws: Workspace | None = None) -> DataFrame:
    """docs with one row of each component: the first of its smallest doc_id."""
    ws = ws or Workspace(docs.sparkSession, "dedup")
    named = docs.select(*[docs[c].alias(f"_{i}") for i, c in enumerate(docs.columns)])
    kept = ws.save(with_row_id(with_fingerprint(named, docs.columns.index("text"), "print")), "documents")
    prints = kept.select("_rid", F.col(f"_{docs.columns.index('doc_id')}").alias("doc_id"), "print")
    chosen = linked(ws, prints, radius).select(F.col("keep").alias("_rid")).distinct()
    return kept.join(chosen.hint("shuffle_hash"), "_rid", "left_semi").select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
