"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, target over source size. The
expected copies are summed up over the source's documents in a fixed order, from a random offset,
and a document is emitted once for each integer that the sum crosses at it. Documents are ordered by
falling size, so the words taken miss a target by no more than the size of a document or so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docquarry.llm.common import WORD, Workspace, attach, cell_offsets, ranked, with_row_id, word_count

NAME = "op9_source_mixing"

#: Weights of the sources by code point, repeating; share of all words to take; most copies of a source.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
#: Cells that the documents of a source and a size band are dealt to, at least, and about how many rows one may get.
SALTS, CELL_ROWS = 64, 500_000


def size_band(size: Column) -> Column:
    """Rises as sizes fall, with 32 bands for each power of two: the length in bits, then the five bits after the first."""
    bits = F.bin(size)
    head = F.conv(F.substring(F.rpad(bits, 6, "0"), 1, 6), 2, 10).cast("int")
    return F.when(size <= 0, F.lit(0)).otherwise(-(F.length(bits) * 64 + head)).cast("int")


def source_targets(ws: Workspace, sized: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """One row per source: source_null, source_key, source_size, target.

    Sources are numbered after a range partitioning and filled up by rounds of aggregates, so no task
    or driver holds them all.
    """
    sums = sized.groupBy("source_null", "source_key").agg(F.sum("size").alias("source_size"))
    dealt = ws.save(sums.repartitionByRange("source_null", "source_key").withColumn("part", F.spark_partition_id()), "sources")
    parts = cell_offsets(dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("all", F.lit(0)), ["all"], ["part"])
    inner = Window.partitionBy("part").orderBy("source_null", "source_key")
    numbered = dealt.join(parts.select("part", "base"), "part").withColumn("i", F.col("base") + F.row_number().over(inner) - 1)
    weight = F.lit(float(weights[-1]))
    for k, w in enumerate(weights[:-1]):
        weight = F.when(F.col("i") % len(weights) == k, F.lit(float(w))).otherwise(weight)
    weighed = ws.save(numbered.select("source_null", "source_key", "source_size", weight.alias("weight"), (F.col("source_size") * most).alias("cap")), "weighed")
    total = share * (weighed.agg(F.sum("source_size")).first()[0] or 0)
    level, seen = 0.0, -1
    while True:  # each round gives the excess of the full sources to the others
        full = F.col("cap") <= F.col("weight") * level
        n, capped, free = weighed.agg(F.count_if(full), F.sum(F.when(full, F.col("cap")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if n == seen or not free:
            break
        seen, level = n, max(level, (total - capped) / free)
    return weighed.select("source_null", "source_key", "source_size", F.least(F.col("cap"), F.col("weight") * level).alias("target"))


def number_of(text: Column) -> Column:
    """The first 32 bits of a text's MD5."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def offset(source: Column) -> Column:
    """The random start of a source in [0, 1)."""
    return number_of(F.coalesce(source, F.lit(""))).cast("double") / 2.0**32


def systematic_mix(docs: DataFrame, keep: list[str] | None = None, weights=WEIGHTS, share=SHARE, most=MOST, ws: Workspace | None = None) -> DataFrame:
    """kept (a struct of the kept columns) of all documents with size, source_size, target, copies and taken.

    docs needs doc_id, text and source. size is the number of words (null text: 0). A null source is
    a source of its own, the last. Null ids come first among equal sizes; rows that are alike in all
    kept columns are interchangeable. An empty table gives no rows; a source without words has
    target 0 and no copies. Kept columns may have any names, but no maps.
    """
    ws = ws or Workspace(docs.sparkSession, "mix")
    keep = docs.columns if keep is None else keep
    wide = "text" in keep
    rows = with_row_id(docs.select(F.struct(*[docs[c].alias(c) for c in keep]).alias("kept"), docs["text"].alias("text"), docs["source"].alias("source"), docs["doc_id"].alias("id")))
    if wide:  # texts stay where they are until the copies are known
        rows = ws.save(rows.drop("text"), "rows").withColumn("text", F.col("kept.text"))
    sized = rows.select(
        *(["_rid"] if wide else ["kept"]),
        word_count(F.col("text")).alias("size"),
        F.col("source").isNull().alias("source_null"),
        F.coalesce("source", F.lit("")).alias("source_key"),
        "id",
        number_of(F.coalesce(F.col("id").cast("string"), F.col("text"), F.lit(""))).alias("dealt"),
        F.xxhash64("kept").alias("tie"),
    )
    sized = ws.save(sized, "sized")
    targets = source_targets(ws, sized, weights, share, most)
    salts = max(SALTS, -(-sized.count() // CELL_ROWS))
    cells = sized.withColumn("band", size_band(F.col("size"))).withColumn("salt", (F.col("dealt") % salts).cast("int"))
    order = [F.col("size").desc(), F.col("id").asc_nulls_first(), "tie"]
    i = ranked(cells, ["source_null", "source_key"], ["band", "salt"], order, "i")
    joined = i.join(targets, ["source_null", "source_key"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    start = offset(F.when(~F.col("source_null"), F.col("source_key")))
    copies = (F.floor(rate * (F.col("i") + 1) + start) - F.floor(rate * F.col("i") + start)).cast("long")
    out = joined.select("_rid" if wide else "kept", "size", "source_size", "target", copies.alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))
    return (attach(rows.select("_rid", "kept"), out).drop("_rid") if wide else out).select("kept", "size", "source_size", "target", "copies", "taken")


def mixed(docs: DataFrame, ws: Workspace | None = None) -> DataFrame:
    """The mix itself: the columns of docs, a row for each copy taken."""
    taken = systematic_mix(docs, ws=ws).where("copies > 0")
    return taken.select("kept", F.explode(F.expr("sequence(1L, copies)"))).select("kept.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return systematic_mix(docs, keep=["doc_id"]).select("kept.doc_id", "size", "source_size", "target", "taken")


SQL = rf"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, sum(size)::BIGINT * 2.0::DOUBLE AS cap,
    CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight
  FROM sized GROUP BY source
), levels AS (
  SELECT 0 AS k, 0.0::DOUBLE AS level
  UNION ALL
  SELECT k + 1, greatest(level, (SELECT (1.5 * sum(source_size) - sum(CASE WHEN cap <= weight * level THEN cap ELSE 0 END)) / nullif(sum(CASE WHEN cap <= weight * level THEN 0 ELSE weight END), 0) FROM sources))
  FROM levels WHERE k < 40
), targets AS (
  SELECT source, source_size, least(cap, weight * (SELECT max(level) FROM levels)) AS target FROM sources
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY
      CASE WHEN size <= 0 THEN 0 ELSE -(length(bin(size)) * 64 + ('0b' || substr(rpad(bin(size), 6, '0'), 1, 6))::INT) END,
      ('0x' || substr(md5(coalesce(doc_id::VARCHAR, text, '')), 1, 8))::BIGINT % {SALTS}, size DESC, doc_id NULLS FIRST) - 1 AS i
  FROM sized
), rated AS (
  SELECT doc_id, size, source_size, target, i, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    ('0x' || substr(md5(coalesce(r.source, '')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS start
  FROM ranked r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, ((floor(rate * (i + 1) + start) - floor(rate * i + start)) * size)::BIGINT AS taken FROM rated
"""
