"""Line dedup with levelled sorted runs of line hashes.

Documents come in batches by rising doc_id. A batch's line keys, as 128-bit hashes, are reduced to
one row each and merge-joined with the sorted runs of earlier batches: a key that a run holds
belongs to the document noted there, the others (the anti-join) belong to the batch's smallest
doc_id and become a run of level 0. FANOUT runs of a level are compacted into one run of the next.
Runs are tables bucketed and sorted by hash, so a merge never shuffles them again. Lines are known
by their places in a text, and what a text loses is one list of marks, so the work on a text of any
number of lines is linear.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.common import Workspace, hot_join

NAME = "op8_line_dedup"

#: Code points of the shortest key that counts; batches of a one-off run; runs of a level before compaction.
LEAST, BATCHES, FANOUT = 10, 4, 2
HASH = ["h1", "h2"]
WHITE, LARGE, SMALL = " \t\n\x0b\f\r", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, its letters A-Z lower-cased and no others."""
    key = F.btrim(line, F.lit(WHITE))
    return F.when(F.octet_length(key) == F.length(key), F.lower(key)).otherwise(F.translate(key, LARGE, SMALL))


def hashed_lines(docs: DataFrame, least: int, batch: Column) -> DataFrame:
    """(doc_id, text_hash, pos, h1, h2, batch) of every line whose key has at least `least` code points; pos counts from 0."""
    hashed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")  # once for a text, not for each of its lines
    each = hashed.select("doc_id", "text_hash", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keyed = each.where(F.length("line") >= least).select("doc_id", "text_hash", "pos", line_key(F.col("line")).alias("key"))
    return keyed.where(F.length("key") >= least).select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), batch.alias("batch"))


def marks(places: Column) -> Column:
    """Sorted places, from 0, to a list of booleans that is true at each of them and ends with the last."""
    before = F.slice(F.concat(F.array(F.lit(-1)), places), F.lit(1), F.size(places))
    steps = F.arrays_zip(places.alias("here"), before.alias("before"))
    return F.flatten(F.transform(steps, lambda s: F.concat(F.array_repeat(F.lit(False), s["here"] - s["before"] - 1), F.array(F.lit(True)))))


class Runs:
    """The levelled runs: bucketed tables of (h1, h2, owner, n, fresh), of which the fresh rows are the run. They lie in the workspace's folder."""

    def __init__(self, ws: Workspace):
        self.ws, self.spark, self.prefix, self.made = ws, ws.spark, f"line_runs_{ws.root[-32:]}", 0
        self.buckets = int(ws.spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]

    def write(self, df: DataFrame) -> str:
        name = f"{self.prefix}_{self.made}"
        self.made += 1
        df.write.option("compression", "zstd").option("path", f"{self.ws.root}/runs/{name}").bucketBy(self.buckets, *HASH).sortBy(*HASH).saveAsTable(name)
        return name

    def owners(self, name: str) -> DataFrame:
        return self.spark.table(name).where("fresh").select(*HASH, "owner")

    def mark(self, keys: DataFrame) -> DataFrame:
        """The owner of each key of a batch: from a run, or else the batch's first document."""
        marked, found = keys, []
        for k, name in enumerate(x for level in self.levels for x in level):
            run = self.owners(name).select(*HASH, F.col("owner").alias(f"o{k}"), F.lit(True).alias(f"in{k}"))
            marked = marked.join(run.hint("merge"), HASH, "left")
            found.append(k)
        old = F.coalesce(*[F.col(f"in{k}") for k in found], F.lit(False))
        owner = F.coalesce(*[F.col(f"o{k}") for k in found], F.col("first_id"))
        return marked.select(*HASH, owner.alias("owner"), "n", (~old).alias("fresh"))

    def add(self, name: str) -> None:
        self.levels[0].append(name)
        for level in range(len(self.levels)):
            if len(self.levels[level]) < FANOUT:
                continue
            if level + 1 == len(self.levels):
                self.levels.append([])
            parts = [self.spark.table(x).where("fresh") for x in self.levels[level]]
            merged = parts[0]
            for p in parts[1:]:
                merged = merged.unionAll(p)
            self.levels[level + 1].append(self.write(merged.repartition(self.buckets, *HASH)))
            self.levels[level] = []

    def close(self) -> None:
        for k in range(self.made):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.prefix}_{k}")
        self.ws.drop("runs")


def lost_lines(ws: Workspace, named: DataFrame, least: int, batches: int) -> DataFrame:
    """(doc_id, text_hash, n_lost, lost) of every text that loses lines; lost are its marks. Saved."""
    ends = named.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1000)).first()[0] or []
    batch = F.lit(batches - 1)
    for k, end in reversed(list(enumerate(sorted(set(ends))))):  # ends need not be exact: any order of batches by doc_id is right
        batch = F.when(F.col("doc_id") <= end, F.lit(k)).otherwise(batch)
    lines = ws.save(hashed_lines(named, least, batch), "lines", partition_by="batch")
    total, runs, candidates = lines.count(), Runs(ws), None
    try:
        for k in range(batches):
            keys = lines.where(F.col("batch") == k).groupBy(*HASH).agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
            name = runs.write(runs.mark(keys))
            again = ws.spark.table(name).where("n > 1 or not fresh").select(F.lit(k).alias("batch"), *HASH, "owner", "n")
            candidates = again if candidates is None else candidates.unionAll(again)
            if k + 1 < batches:
                runs.add(name)
        lost = hot_join(lines, candidates, ["batch", *HASH], "n", total, share=1000 * batches).where(~F.col("doc_id").eqNullSafe(F.col("owner")))
        places = lost.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("pos")).alias("places"))  # no more than a text's lines
        return ws.save(places.select("doc_id", "text_hash", F.size("places").alias("n_lost"), marks(F.col("places")).alias("lost")), "lost")
    finally:
        runs.close()
        ws.drop("lines")


def dedup_lines(docs: DataFrame, keep: list[str] | None = None, least: int = LEAST, batches: int = BATCHES, ws: Workspace | None = None) -> DataFrame:
    """kept (a struct of the kept columns of docs as they were), text (without repeated lines), n_lines and n_dropped.

    docs needs doc_id and text. Rows of one doc_id are one document, and so are those without an id,
    which come last. A null text is one empty line and stays null. A document that loses all its lines
    stays, with an empty text. An empty table gives no rows. Kept columns may have any names.
    """
    ws = ws or Workspace(docs.sparkSession, "lines")
    keep = docs.columns if keep is None else keep
    named = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))
    lost = lost_lines(ws, named, least, batches).select(F.col("doc_id").alias("lost_id"), F.col("text_hash").alias("lost_hash"), "n_lost", "lost")
    rows = docs.select(F.struct(*[docs[c].alias(c) for c in keep if c != "text"]).alias("others"), docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))
    joined = rows.join(lost, F.col("doc_id").eqNullSafe(F.col("lost_id")) & (F.xxhash64("text") == F.col("lost_hash")), "left")
    left = F.array_join(F.filter(F.split("text", "\n", -1), lambda line, i: ~F.coalesce(F.get("lost", i), F.lit(False))), "\n")
    return joined.select(
        F.struct(*[F.col("text") if c == "text" else F.col("others").getField(c).alias(c) for c in keep]).alias("kept"),
        F.when(F.col("n_lost").isNull(), F.col("text")).otherwise(left).alias("text"),
        F.coalesce(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(1)).cast("long").alias("n_lines"),
        F.coalesce("n_lost", F.lit(0)).cast("long").alias("n_dropped"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
    return kept.select("kept.doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


SQL = rf"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), owners AS (
  SELECT k, min(doc_id) AS owner FROM keyed WHERE length(k) >= {LEAST} GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT keyed.*, owner IS NOT NULL AND doc_id <> owner AS gone FROM keyed LEFT JOIN owners USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
