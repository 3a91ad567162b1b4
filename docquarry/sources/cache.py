"""Results kept as Parquet under a fingerprint of what they are results of."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import tempfile

from pyspark.sql import DataFrame, SparkSession

from docquarry.schema import Schema


def canonical(value: object) -> object:
    """A form of query documents that JSON can write: times as ISO strings, keys sorted, lists in order."""
    if isinstance(value, dict):
        return {str(k): canonical(v) for k, v in sorted(value.items(), key=lambda kv: str(kv[0]))}
    if isinstance(value, (list, tuple)):
        return [canonical(v) for v in value]
    if isinstance(value, (set, frozenset)):
        return sorted((canonical(v) for v in value), key=repr)
    if isinstance(value, dt.datetime):
        return {"$time": (value if value.tzinfo else value.replace(tzinfo=dt.UTC)).astimezone(dt.UTC).isoformat()}
    return value if value is None or isinstance(value, (bool, int, float, str)) else f"{type(value).__name__}:{value}"


def fingerprint(source: str, schema: Schema, query: object, projection: object = None, sort: object = None) -> str:
    """Two results may share a folder only if source, schema, filter, projection and sort are all the same."""
    parts = [source, schema.to_spec(), query or {}, projection, [list(s) for s in sort or ()]]
    return hashlib.sha256(json.dumps(canonical(parts), sort_keys=True).encode()).hexdigest()


def state_of(spark: SparkSession, source: str) -> list:
    """What changes when the files of a source do: their bytes and number, and when the folder was last written."""
    kind, _, path = source.partition(":")
    if kind not in ("parquet", "json"):
        return []
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):  # a pattern
        return []
    summary = fs.getContentSummary(at)
    return [summary.getLength(), summary.getFileCount(), fs.getFileStatus(at).getModificationTime()]


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names for all executors; in local mode, a temporary one if it names none."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root and not context.master.startswith("local[") and context.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return root or tempfile.mkdtemp(prefix="docquarry-")


class ResultCache:
    def __init__(self, spark: SparkSession, root: str, key: str):
        self.spark, self.path = spark, f"{root.rstrip('/')}/{key}"

    def _at(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        """Only a finished write counts."""
        path, fs = self._at("_SUCCESS")
        return fs.exists(path)

    def write(self, df: DataFrame) -> None:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path)

    def read(self) -> DataFrame:
        if not self.exists():
            raise FileNotFoundError(f"no complete result in {self.path}")
        return self.spark.read.parquet(self.path)

    def clean(self) -> None:
        path, fs = self._at()
        fs.delete(path, True)

    def statistics(self) -> dict:
        path, fs = self._at()
        files = [s for s in fs.listStatus(path) if s.getPath().getName().endswith(".parquet")]
        df = self.read()
        return {"file_count": len(files), "total_rows": df.count(), "total_size_mb": sum(s.getLen() for s in files) / 2**20, "schema_fields": df.columns, "cache_dir": self.path}
