"""Sharding by a k-d tree over metadata, with leaves of near equal bytes.

Rows of equal text form one group with the metadata of its smallest doc_id. The tree splits the
groups at weighted medians, each time along the dimension that is widest in the node, until every
leaf has its share of the bytes. Medians are found by rounds of distributed histograms; the driver
sees a few counts a round, however many rows there are. Groups that weigh much for a leaf, of which
there are at most a fixed number, are placed whole, and the median of the others makes up for it. A
group of more than half a leaf is cut into pieces first, or sizes could not be equal.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.common import Workspace, ranked, with_row_id

NAME = "op3_kd_sharding"
SQL = None  # rounds of medians: held against properties and small cases in the tests

SHARDS = 8
#: A group is heavy from a leaf's bytes (or rows) divided by this; so there are at most 2 * SHARDS * this many.
HEAVY = 100
#: Pieces that a leaf's bytes of a cut group make.
PIECES = 64
#: Buckets of a histogram round; part of a leaf's bytes that a median may be off.
BUCKETS, EXACT = 1024, 5000
#: Cells that the rows of a shard are numbered in, at least, and about how many of them one may get.
SALTS, CELL_ROWS = 256, 500_000
GROUP = ["text_hash", "text_crc32", "size"]
AXES = ("k_size", "k_source", "k_lang")


@dataclass
class Node:
    first: int
    leaves: int
    heavy: list = field(default_factory=list)
    axis: str = ""
    cut: int = 0
    below: Node | None = None
    above: Node | None = None


def axis_key(coordinate: Column, tie: Column) -> Column:
    """A coordinate of 32 bits, then 31 bits of the text's hash, so that equal coordinates can be told apart."""
    return F.shiftleft(coordinate.cast("long"), 31).bitwiseOR(tie.bitwiseAND(F.lit(0x7FFFFFFF)))


def category(column: Column) -> Column:
    """Values have no order that matters: a fixed hash spreads them, and null lies at 0."""
    return F.when(column.isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(column), F.lit(2**32)))


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    text = F.coalesce(docs["text"], F.lit(""))
    size, tie = (F.octet_length(text) + 1).cast("long"), F.xxhash64(text)
    rows = docs.select(
        F.struct(*[docs[c].alias(c) for c in keep]).alias("kept"),
        docs["doc_id"].alias("id"),
        size.alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        tie.alias("text_hash"),
        axis_key(F.floor(F.log2(size) * 2.0**26), tie).alias("k_size"),
        axis_key(category(docs["source"]), tie).alias("k_source"),
        axis_key(category(docs["lang"]), tie).alias("k_lang"),
    )
    return with_row_id(rows)


def settle(low: list, high: list, half: float, light: int) -> None:
    """Moves heavy units between the sides until the light ones can make up for what is missing."""

    def cost(weight: float) -> float:
        return max(0.0, weight - half, half - light - weight)

    weight = sum(u["w"] for u in low)
    while True:
        moves = [(cost(weight - u["w"]), low, high, u) for u in low] + [(cost(weight + u["w"]), high, low, u) for u in high]
        best = min(moves, key=lambda m: (m[0], m[3]["w"]), default=None)
        if best is None or best[0] >= cost(weight):
            return
        _, source, to, unit = best
        source.remove(unit)
        to.append(unit)
        weight += unit["w"] if to is low else -unit["w"]


def node_of(node: Node, level_nodes: dict) -> Column:
    """The number in level_nodes of the node that a light group lies in."""
    if node.below is None:
        return F.lit(level_nodes[node.first])
    return F.when(F.col(node.axis) < node.cut, node_of(node.below, level_nodes)).otherwise(node_of(node.above, level_nodes))


def histogram(light: DataFrame, where: Column, ranges: dict[int, tuple[str, int, int]]) -> dict[int, list]:
    """For each node, given its axis and range, the weights of BUCKETS equal parts of the range."""
    bucket = F.lit(None).cast("long")
    for k, (axis, low, high) in ranges.items():
        step = max(1, -(-(high - low) // BUCKETS))
        inside = (F.col("_node") == k) & (F.col(axis) >= low) & (F.col(axis) < high)
        bucket = F.when(inside, F.expr(f"({axis} - {low}L) div {step}L")).otherwise(bucket)
    counts = light.withColumn("_node", where).withColumn("_bucket", bucket).where("_bucket is not null").groupBy("_node", "_bucket").agg(F.sum("w").alias("w"))
    out: dict[int, list] = {k: [] for k in ranges}
    for r in counts.collect():  # at most BUCKETS for each node
        out[r["_node"]].append((r["_bucket"], r["w"]))
    return {k: sorted(v) for k, v in out.items()}


def grow(light: DataFrame, root: Node, exact: float) -> list[Node]:
    """Splits the tree level by level, with a few rounds of one aggregate over the groups each, and returns its leaves."""
    level, full = [root], None
    while any(n.leaves > 1 for n in level):
        at = {n.first: n.first for n in level}
        where = node_of(root, at)
        sums = [F.sum("w").alias("w"), *[f(a).alias(f"{name}_{a}") for a in AXES for name, f in (("min", F.min), ("max", F.max))]]
        stats = {r["_node"]: r for r in light.withColumn("_node", where).groupBy("_node").agg(*sums).collect()}
        spans, totals = {}, {}
        for n in level:
            r = stats.get(n.first)
            totals[n.first] = r["w"] if r else 0
            for a in AXES:
                ends = [r[f"min_{a}"], r[f"max_{a}"]] if r else []
                ends += [u[a] for u in n.heavy]
                spans[n.first, a] = (min(ends), max(ends)) if ends else (0, 0)
        if full is None:  # widths are relative to the whole range of the dimension
            full = {a: max(1, spans[root.first, a][1] - spans[root.first, a][0]) for a in AXES}
        todo, wanted, done = {}, {}, {}
        split = [n for n in level if n.leaves > 1]
        for n in split:
            n.axis = max(AXES, key=lambda a: (spans[n.first, a][1] - spans[n.first, a][0]) / full[a])
            low, high = spans[n.first, n.axis]
            todo[n.first] = (n.axis, low, high + 1)
        shares = {n.first: (n.leaves // 2) / n.leaves * (totals[n.first] + sum(u["w"] for u in n.heavy)) for n in split}
        first = histogram(light, where, todo)
        sides = {}
        for n in split:  # the plain median tells on which side a heavy group is
            axis, low, high = todo[n.first]
            step, half = max(1, -(-(high - low) // BUCKETS)), shares[n.first]
            marks = sorted([(low + b * step, w) for b, w in first[n.first]] + [(u[axis], u["w"]) for u in n.heavy])
            run, median = 0, high
            for at_key, w in marks:
                if run + w / 2 >= half:
                    median = at_key
                    break
                run += w
            below = [u for u in n.heavy if u[axis] < median]
            above = [u for u in n.heavy if u[axis] >= median]
            settle(below, above, half, totals[n.first])
            sides[n.first] = (below, above)
            wanted[n.first] = min(max(half - sum(u["w"] for u in below), 0), totals[n.first])
        counts = first
        while todo:
            for k, (axis, low, high) in list(todo.items()):
                step, run, found = max(1, -(-(high - low) // BUCKETS)), 0, None
                for b, w in counts[k]:
                    if run + w >= wanted[k]:
                        found = (b, w)
                        break
                    run += w
                if found is None or step == 1 or found[1] <= exact:
                    if found is None:
                        done[k] = high
                    else:  # the nearer end of the bucket
                        done[k] = low + (found[0] + (wanted[k] - run > found[1] / 2)) * step
                    del todo[k]
                else:
                    todo[k] = (axis, low + found[0] * step, min(high, low + (found[0] + 1) * step))
                    wanted[k] -= run
            if todo:
                counts = histogram(light, where, todo)
        following = []
        for n in level:
            if n.leaves == 1:
                following.append(n)
                continue
            left = n.leaves // 2
            below, above = sides[n.first]
            n.cut = done[n.first]
            n.below, n.above = Node(n.first, left, below), Node(n.first + left, n.leaves - left, above)
            following += [n.below, n.above]
        level = following
    return level


def kd_shards(docs: DataFrame, keep: list[str], shards: int = SHARDS, target_bytes: int | None = None, ws: Workspace | None = None) -> DataFrame:
    """kept (a struct of the kept columns) of docs with size, text_crc32, shard and slot (gapless from 0 within a shard).

    docs needs doc_id, text, source and lang. A row weighs its text's UTF-8 bytes plus 1 (null: as an
    empty text). With target_bytes, there are as many shards as the bytes need. Rows of equal text
    (null counts as empty) come into one shard, if they are at most half a shard. Null metadata is a
    value of its own; equal rows are all placed; an empty table gives no rows; kept columns may have
    any names.
    """
    spark = docs.sparkSession
    ws = ws or Workspace(spark, "kd")
    rows = ws.save(measured(docs, keep), "rows")
    rep = F.min(F.struct("id", "k_size", "k_source", "k_lang")).alias("rep")
    groups = rows.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("w"), rep)
    groups = ws.save(groups.select(*GROUP, "n", "w", *[f"rep.{a}" for a in AXES]), "groups")
    total, n_rows = groups.agg(F.coalesce(F.sum("w"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    shards = max(1, -(-total // target_bytes)) if target_bytes else shards
    leaf = max(1.0, total / shards)
    is_heavy = (F.col("w") * (HEAVY * shards) >= F.lit(total)) | (F.col("n") * (HEAVY * shards) >= F.lit(n_rows))
    heavy = [r.asDict() for r in groups.where(is_heavy).collect()]  # at most 2 * HEAVY * shards
    light = groups.where(~is_heavy)
    for u in heavy:
        u["pieces"] = min(u["n"], -(-u["w"] * PIECES // int(leaf))) if u["w"] > leaf / 2 else 1
    kinds = "text_hash long, text_crc32 long, size long, pieces int"
    cut = spark.createDataFrame([(*[u[c] for c in GROUP], int(u["pieces"])) for u in heavy], kinds)
    piece = F.when(F.col("pieces") > 1, F.pmod(F.xxhash64("_rid"), F.col("pieces"))).otherwise(F.lit(0)).cast("int")
    of_heavy = rows.join(F.broadcast(cut), GROUP).withColumn("piece", piece).drop("pieces")
    units = [u | {"piece": 0} for u in heavy if u["pieces"] == 1]
    if len(units) < len(heavy):
        large = {tuple(u[c] for c in GROUP): u for u in heavy if u["pieces"] > 1}
        counted = of_heavy.join(F.broadcast(cut.where("pieces > 1").select(*GROUP)), GROUP, "left_semi").groupBy(*GROUP, "piece").agg(F.sum("size").alias("w"))
        units += [large[tuple(r[c] for c in GROUP)] | {"piece": r["piece"], "w": r["w"]} for r in counted.collect()]  # about PIECES a shard
    units.sort(key=lambda u: tuple(u[c] for c in (*GROUP, "piece")))
    root = Node(0, shards, units)
    leaves = grow(light, root, leaf / EXACT)
    places = [(*[u[c] for c in GROUP], u["piece"], n.first) for n in leaves for u in n.heavy]
    place = spark.createDataFrame(places, "text_hash long, text_crc32 long, size long, piece int, shard int")
    shard = node_of(root, {n.first: n.first for n in leaves}).cast("int").alias("shard")
    out = ["kept", *GROUP, "_rid", "shard"]
    heavy_rows = of_heavy.join(F.broadcast(place), [*GROUP, "piece"]).select(*out)
    light_rows = rows.drop(*AXES).join(F.broadcast(cut.select(*GROUP)), GROUP, "left_anti").join(light.select(*GROUP, *AXES), GROUP).select("kept", *GROUP, "_rid", shard)
    placed = ws.save(heavy_rows.unionByName(light_rows).withColumn("salt", F.pmod(F.xxhash64("_rid"), F.lit(max(SALTS, n_rows // CELL_ROWS))).cast("int")), "placed")
    ws.drop("rows", "groups")
    return ranked(placed, ["shard"], ["salt"], ["_rid"], "slot").select("kept", "size", "text_crc32", "shard", "slot")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = kd_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
    return placed.select("kept.doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
