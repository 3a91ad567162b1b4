"""What the operators of this subpackage share: tables in the shared folder, ranks, joins on uneven keys."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A word, as all word counts here take it.
WORD = r"[^\x20\x09-\x0D]+"

#: The most rows that a broadcast table may have; larger ones are shuffled.
BROADCAST_ROWS = 100_000


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one in local mode only."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="docquarry-")
        context.setCheckpointDir(root)
        root = context.getCheckpointDir()
    return root.rstrip("/")


class Workspace:
    """Written tables that cut lineage. They survive lost executors, and go when the application ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def save(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        path = f"{self.root}/{name}"
        writer = df.write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.root}/{name}")

    def close(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the session may be gone by then
            pass

    def _delete(self, path: str) -> None:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


def narrow(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that other columns of any name can't clash with computed ones."""
    return docs.select(*[docs[n] for n in names])


def with_row_id(df: DataFrame, name: str = "_rid") -> DataFrame:
    """A number for each row. It holds only within one plan or after the frame has been saved."""
    return df.withColumn(name, F.monotonically_increasing_id())


def slices(batches, n: int = 1000):
    """Arrow batches in pieces of n rows, so that what is made of long texts stays small."""
    for batch in batches:
        for low in range(0, batch.num_rows, n):
            yield batch.slice(low, n)
        pool = pa.default_memory_pool()
        pool.release_unused()


def attach(rows: DataFrame, found: DataFrame, on: str = "_rid") -> DataFrame:
    """rows with the columns of found, a row for each number of rows at most. Only the narrow side is hashed; wide rows are not sorted."""
    return rows.join(found.hint("shuffle_hash"), on)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cell_offsets(cells: DataFrame, group: list[str], order: list[str], count: str = "n") -> DataFrame:
    """Adds to each cell of a group how many rows its group has in earlier cells (base).

    With two columns of order, the first one's sums are added up over the group and the cells within
    each of its values, so no task gets all cells of a group.
    """
    inner = Window.partitionBy(*group, *order[:-1]).orderBy(order[-1]).rowsBetween(Window.unboundedPreceding, -1)
    within = cells.withColumn("base", F.coalesce(F.sum(count).over(inner), F.lit(0)))
    if len(order) == 1:
        return within
    outer = cells.groupBy(*group, *order[:-1]).agg(F.sum(count).alias(count))
    above = cell_offsets(outer, group, order[:-1], count).withColumnRenamed("base", "_above").drop(count)
    return within.join(above, [*group, *order[:-1]]).withColumn("base", F.col("base") + F.col("_above")).drop("_above")


def ranked(rows: DataFrame, group: list[str], cell: list[str], order: list, name: str) -> DataFrame:
    """A gapless 0-based number within each group, without one task for a hot group.

    A group's rows lie in the cells that the cell columns (not null) make, in their order; a cell is
    numbered in one task, by order, and starts at the number of rows in the group's earlier cells.
    """
    keys = [*group, *cell]
    offsets = cell_offsets(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), group, cell).drop("n")
    inner = Window.partitionBy(*keys).orderBy(*order)
    placed = rows.withColumn("_in_cell", F.row_number().over(inner) - 1)
    return placed.join(offsets, keys).withColumn(name, (F.col("base") + F.col("_in_cell")).cast("long")).drop("base", "_in_cell")


def hot_join(rows: DataFrame, table: DataFrame, on: list[str], n: str, total: int, share: int = 1000, how: str = "inner") -> DataFrame:
    """rows joined with a table of one row per key, n of which is the key's number of rows.

    Keys with at least total / share of the rows, of which there can be no more than share, are
    broadcast; the others are shuffled, and none of them is large. how: inner or left.
    """
    least = max(2, total // share)
    hot, cold = table.where(F.col(n) >= least).drop(n), table.where(F.col(n) < least).drop(n)
    among = F.broadcast(hot)
    return rows.join(among, on, "inner").unionByName(rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on, how))
